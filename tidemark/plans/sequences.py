"""History of a sensor: previous values, spikes, runs, folds, limits, timing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.functions import guards
from tidemark.operators import events, folds, history, metrics, sketches
from tidemark.plans.base import COOLDOWN, DEDUP, FRESH, READINGS, SPIKES, THROTTLE, THRESHOLDS_SQL, Registry, thresholds
from tidemark.sources import readings

query = Registry()
KEYS, ORDER = ["sensor_id"], ["t", "sequence"]
S = 1_000_000


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.event_readings(spark, sf_dir)


#: The range of a sensor is that of its critical rule.
_RANGES = f"{THRESHOLDS_SQL}, rg AS (SELECT c.sensor_id, c.low, c.high, w.low AS warning_min, w.high AS warning_max FROM th c JOIN th w ON c.sensor_id = w.sensor_id AND c.id % 10 = 2 AND w.id % 10 = 1)"


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.col("id") % 10
    pick = lambda n, c, name: F.max(F.when(rule == n, F.col(c))).alias(name)
    return thresholds(spark, sf_dir).groupBy("sensor_id").agg(pick(2, "low", "low"), pick(2, "high", "high"), pick(1, "low", "warning_min"), pick(1, "high", "warning_max"))


_OUT = "(coalesce(value < low, false) OR coalesce(value > high, false))"
_PREVIOUS = f"""{READINGS}, {_RANGES}, a AS (SELECT r.*, low, high, warning_min, warning_max, {_OUT} AS out_ FROM r LEFT JOIN rg USING (sensor_id)),
    b AS (SELECT *, last_value(CASE WHEN NOT out_ THEN value END IGNORE NULLS) OVER w AS pv FROM a WINDOW w AS (PARTITION BY sensor_id ORDER BY t, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    c AS (SELECT *, last_value(CASE WHEN NOT out_ AND pv IS DISTINCT FROM value THEN t END IGNORE NULLS) OVER w AS pt FROM b WINDOW w AS (PARTITION BY sensor_id ORDER BY t, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    prev AS (SELECT *, CASE WHEN t - pt <= {FRESH * S} THEN pv END AS previous_value, CASE WHEN t - pt <= {FRESH * S} THEN pt END AS previous_t FROM c)"""


def _previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _readings(spark, sf_dir).join(ranges(spark, sf_dir), "sensor_id", "left")
    return events.with_previous(r, guards.below_or_above(F.col("value"), F.col("low"), F.col("high")), FRESH)


@query(f"WITH {_PREVIOUS} SELECT sequence, previous_value, previous_t FROM prev")
def previous_reading_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _previous(spark, sf_dir).select("sequence", "previous_value", "previous_t")


def _spike_sql(floor_abs: str, floor_rel: str, least: float) -> str:
    hits = ", ".join(f"CASE WHEN {x} >= {SPIKES[k]} THEN '{k}' END" for k, x in (("abs_delta", "d"), ("rel_delta", "rel"), ("abs_slope", f"CASE WHEN s >= {least} THEN d / s END")))
    return f"""{_PREVIOUS}, m AS (SELECT *, abs(value - previous_value) AS d, CASE WHEN abs(previous_value) > 1e-6 THEN abs(abs(value - previous_value) / nullif(previous_value, 0)) ELSE 0.0 END AS rel,
        CASE WHEN (t - previous_t) / 1000000.0::DOUBLE <= 0 THEN 0.001 ELSE (t - previous_t) / 1000000.0::DOUBLE END AS s FROM prev),
        spike AS (SELECT *, CASE WHEN previous_value IS NULL THEN NULL WHEN d < {floor_abs} AND rel < {floor_rel} THEN [] ELSE list_filter([{hits}], lambda x: x IS NOT NULL) END AS triggered FROM m)"""


def _floor(place: int) -> str:
    return "CASE sensor_type " + " ".join(f"WHEN '{k}' THEN {v[place]}" for k, v in K.NOISE_FLOORS.items() if k != "default") + f" ELSE {K.NOISE_FLOORS['default'][place]} END"


_TYPED = _spike_sql(_floor(0), _floor(1), 0.0)


@query(f"WITH {_TYPED} SELECT sequence, array_to_string(triggered, ',') AS triggered FROM spike")
def delta_spike_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.with_spike(_previous(spark, sf_dir), SPIKES).select("sequence", F.array_join("triggered", ",").alias("triggered"))


@query(f"WITH {_spike_sql('0.1', '0.01', 1.0)} SELECT sequence, array_to_string(triggered, ',') AS triggered FROM spike")
def delta_spike_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.with_spike(_previous(spark, sf_dir), SPIKES, typed=False).select("sequence", F.array_join("triggered", ",").alias("triggered"))


@query(f"""WITH {READINGS}, i AS (SELECT *, sum(CASE WHEN value > 60 THEN 0 ELSE 1 END) OVER (PARTITION BY sensor_id ORDER BY t, sequence ROWS UNBOUNDED PRECEDING) AS g FROM r)
    SELECT sequence, CASE WHEN value > 60 THEN count(*) FILTER (WHERE value > 60) OVER (PARTITION BY sensor_id, g ORDER BY t, sequence ROWS UNBOUNDED PRECEDING) ELSE 0 END AS consecutive FROM i""")
def consecutive_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.consecutive(_readings(spark, sf_dir), KEYS, ORDER, F.col("value") > 60).select("sequence", "consecutive")


def _spaced_sql(source: str, keys: str, gap: int) -> str:
    """The chain of accepted rows of each key, by recursion over rows in order."""
    same = " AND ".join(f"n.{k.strip()} IS NOT DISTINCT FROM acc.{k.strip()}" for k in keys.split(","))
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY t, sequence) AS n FROM {source}),
        acc AS (SELECT {keys}, sequence, t, n, t AS held, true AS accepted FROM o WHERE n = 1
            UNION ALL SELECT {', '.join('n.' + k.strip() for k in keys.split(','))}, n.sequence, n.t, n.n, CASE WHEN n.t - acc.held >= {gap * S} THEN n.t ELSE acc.held END, n.t - acc.held >= {gap * S} FROM acc JOIN o n ON {same} AND n.n = acc.n + 1)"""


@query(f"WITH RECURSIVE {READINGS}, {_spaced_sql('r', 'sensor_id', THROTTLE)} SELECT sequence, accepted FROM acc")
def throttle_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.spaced(_readings(spark, sf_dir), KEYS, "t", THROTTLE, ORDER).select("sequence", "accepted")


@query(f"WITH RECURSIVE {READINGS}, {_spaced_sql('r', 'sensor_id, k', DEDUP)} SELECT sequence, accepted FROM acc")
def dedup_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.spaced(_readings(spark, sf_dir), ["sensor_id", "k"], "t", DEDUP, ORDER).select("sequence", "accepted")


@query(f"WITH {READINGS} SELECT sensor_id, k, min(sequence) AS sequence FROM r GROUP BY sensor_id, k")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _readings(spark, sf_dir).groupBy("sensor_id", "k").agg(F.min("sequence").alias("sequence"))


_SPIKES_ONLY = f"{_TYPED}, hit AS (SELECT * FROM spike WHERE len(triggered) > 0)"


@query(f"WITH RECURSIVE {_SPIKES_ONLY}, {_spaced_sql('hit', 'sensor_id', COOLDOWN)} SELECT sequence, accepted FROM acc")
def spike_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = events.with_spike(_previous(spark, sf_dir), SPIKES).where("size(triggered) > 0")
    return folds.spaced(hits, KEYS, "t", COOLDOWN, ORDER).select("sequence", "accepted")


@query(f"WITH RECURSIVE {READINGS}, e AS (SELECT * FROM r WHERE event_type = 'error'), {_spaced_sql('e', 'sensor_id', 48 * 3600)} SELECT sensor_id, sequence FROM acc WHERE accepted")
def event_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.spaced(_readings(spark, sf_dir).where("event_type = 'error'"), KEYS, "t", 48 * 3600, ORDER).where("accepted").select("sensor_id", "sequence")


_IOT = f"""{_TYPED}, q AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY t, sequence) >= 10 AS open_ FROM spike),
    i AS (SELECT *, sum(CASE WHEN out_ THEN 0 ELSE 1 END) OVER (PARTITION BY sensor_id ORDER BY t, sequence ROWS UNBOUNDED PRECEDING) AS g FROM q WHERE open_),
    v AS (SELECT sequence, CASE WHEN out_ THEN count(*) FILTER (WHERE out_) OVER (PARTITION BY sensor_id, g ORDER BY t, sequence ROWS UNBOUNDED PRECEDING) ELSE 0 END AS cons FROM i),
    z AS (SELECT q.*, coalesce(v.cons, 0) AS cons, coalesce((warning_min IS NOT NULL OR warning_max IS NOT NULL) AND NOT coalesce(value < warning_min, false) AND NOT coalesce(value > warning_max, false), false) AS band FROM q LEFT JOIN v USING (sequence)),
    hit AS (SELECT * FROM z WHERE open_ AND NOT out_ AND NOT band AND coalesce(len(triggered), 0) > 0), {_spaced_sql('hit', 'sensor_id', COOLDOWN)},
    iot AS (SELECT z.*, CASE WHEN NOT open_ THEN 'warming_up' WHEN out_ THEN CASE WHEN cons >= 3 THEN 'out_of_range' ELSE 'out_of_range_pending' END WHEN band THEN 'warning_band' WHEN acc.accepted THEN 'spike' WHEN acc.accepted IS NOT NULL THEN 'spike_cooldown' ELSE 'clean' END AS reason
        FROM z LEFT JOIN acc USING (sequence))"""


def _iot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.iot_classified(_readings(spark, sf_dir), ranges(spark, sf_dir), SPIKES, FRESH, COOLDOWN)


@query(f"WITH RECURSIVE {_IOT} SELECT sequence, reason, CASE reason WHEN 'out_of_range' THEN 'ALERT' WHEN 'spike' THEN 'WARNING' ELSE 'ML_PREDICTION' END AS class FROM iot")
def iot_classify_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _iot(spark, sf_dir).select("sequence", "reason", "class")


@query(f"WITH RECURSIVE {_IOT} SELECT reason, CASE reason WHEN 'out_of_range' THEN 'ALERT' WHEN 'spike' THEN 'WARNING' ELSE 'ML_PREDICTION' END AS class, count(*) AS n FROM iot GROUP BY ALL")
def iot_classify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _iot(spark, sf_dir).groupBy("reason", "class").agg(F.count(F.lit(1)).alias("n"))


_LIMIT = f"""x AS (SELECT *, t // {86400 * S} AS b FROM {{source}}), y AS (SELECT *, row_number() OVER (PARTITION BY {{key}}, b ORDER BY t, sequence) AS n FROM x),
    sz AS (SELECT {{key}}, b + 1 AS b, count(*) AS prev FROM x GROUP BY ALL), lim AS (SELECT y.*, CAST(floor(coalesce(prev, 0) * (1 - (t - y.b * {86400 * S}) / {86400.0 * S}::DOUBLE)) + n AS BIGINT) AS approx FROM y LEFT JOIN sz USING ({{key}}, b))"""


@query(f"WITH {READINGS}, {_LIMIT.format(source='r', key='sensor_id')} SELECT sequence, approx, approx <= 3 AS allowed FROM lim")
def rate_limit_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.rate_limited(_readings(spark, sf_dir), KEYS, "t", ORDER, 3, 86400).select("sequence", "approx", "allowed")


@query(f"""WITH {READINGS}, ip AS (SELECT *, sensor_id % 7 AS ip FROM r), l1 AS (WITH {_LIMIT.format(source='ip', key='ip')} SELECT * FROM lim), ok1 AS (SELECT sensor_id, value, t, sequence, sensor_id % 20 AS device FROM l1 WHERE approx <= 60),
    l2 AS (WITH {_LIMIT.format(source='ok1', key='device')} SELECT * FROM lim), ok2 AS (SELECT sensor_id, value, t, sequence FROM l2 WHERE approx <= 20), l3 AS (WITH {_LIMIT.format(source='ok2', key='sensor_id')} SELECT * FROM lim)
    SELECT r.sequence, CASE WHEN l1.approx > 60 THEN 'ip' WHEN l2.approx > 20 THEN 'device' WHEN l3.approx > 3 THEN 'sensor' END AS denied_by FROM r JOIN l1 USING (sequence) LEFT JOIN l2 USING (sequence) LEFT JOIN l3 USING (sequence)""")
def rate_limit_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _readings(spark, sf_dir).select("sensor_id", "t", "sequence", (F.col("sensor_id") % 7).alias("ip"), (F.col("sensor_id") % 20).alias("device"))
    r = r.withColumn("denied_by", F.lit(None).cast("string"))
    for level, key, limit in (("ip", "ip", 60), ("device", "device", 20), ("sensor", "sensor_id", 3)):  # a call counts at a level if none before denied it
        told = history.rate_limited(r, [key], "t", ORDER, limit, 86400, counts=F.col("denied_by").isNull())
        r = told.withColumn("denied_by", F.coalesce("denied_by", F.when(~F.col("allowed"), level))).drop("approx", "allowed")
    return r.select("sequence", "denied_by")


_ARRIVAL = f"{READINGS}, ar AS (SELECT sensor_id, CASE WHEN k % 10 = 9 THEN NULL ELSE t END AS sent, t + k * 5000 AS received, sequence, sequence // 8 * 8 + (sequence * 5) % 8 AS arrival FROM r)"


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _readings(spark, sf_dir)
    s = F.col("sequence")
    return r.select("sensor_id", F.when(F.col("k") % 10 != 9, F.col("t")).alias("sent"), (F.col("t") + F.col("k") * 5000).alias("received"), "sequence", (F.expr("sequence div 8") * 8 + (s * 5) % 8).alias("arrival"))


_TIMED = f"""{_ARRIVAL}, tm AS (SELECT *, (received - sent) / 1000.0::DOUBLE AS lag_ms, (sent - last_value(sent IGNORE NULLS) OVER w) / 1000.0::DOUBLE AS delta_ms, coalesce(sequence <= last_value(sequence IGNORE NULLS) OVER w, false) AS out_of_order
    FROM ar WINDOW w AS (PARTITION BY sensor_id ORDER BY arrival, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.timing_rows(_arrivals(spark, sf_dir), KEYS, ["arrival", "sequence"], "sent", "received", "sequence")


@query(f"WITH {_TIMED} SELECT sequence, lag_ms, delta_ms, out_of_order, abs(delta_ms - 1000.0) <= 100.0 AS on_time FROM tm")
def timing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed(spark, sf_dir).select("sequence", "lag_ms", "delta_ms", "out_of_order", "on_time")


_STATS = f"""{_TIMED}, l AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY arrival DESC, sequence DESC) AS place FROM tm),
    st AS (SELECT sensor_id, count(delta_ms) AS n, avg(delta_ms) AS avg_delta_ms, min(delta_ms) AS min_delta_ms, max(delta_ms) AS max_delta_ms, stddev_samp(delta_ms) AS stdev_delta_ms, avg(lag_ms) AS avg_lag_ms, max(lag_ms) AS max_lag_ms, count(*) FILTER (WHERE out_of_order) AS out_of_order, count(*) AS readings FROM l WHERE place <= 100 GROUP BY sensor_id)"""
_ROUNDED = ("avg_delta_ms", "stdev_delta_ms", "avg_lag_ms")


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.timing_stats(_timed(spark, sf_dir), KEYS, [F.desc("arrival"), F.desc("sequence")])


@query(f"WITH {_STATS} SELECT * REPLACE (round(avg_delta_ms, 2) AS avg_delta_ms, round(stdev_delta_ms, 2) AS stdev_delta_ms, round(avg_lag_ms, 2) AS avg_lag_ms) FROM st")
def timing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).withColumns({c: F.round(c, 2) for c in _ROUNDED})


@query(f"WITH {_STATS} SELECT count(*) AS sensors, sum(readings)::BIGINT AS readings, round(sum(avg_delta_ms * n) / sum(n), 2) AS avg_delta_ms, max(max_lag_ms) AS max_lag_ms, sum(out_of_order)::BIGINT AS out_of_order FROM st")
def timing_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).agg(F.count(F.lit(1)).alias("sensors"), F.sum("readings").alias("readings"), F.round(F.sum(F.col("avg_delta_ms") * F.col("n")) / F.sum("n"), 2).alias("avg_delta_ms"), F.max("max_lag_ms").alias("max_lag_ms"), F.sum("out_of_order").alias("out_of_order"))


@query(f"WITH {_STATS} SELECT sensor_id, CASE WHEN out_of_order::DOUBLE / readings > 0.01 THEN 'FAIL' WHEN coalesce(max_lag_ms > 200, false) THEN 'WARN' ELSE 'OK' END AS verdict, concat_ws(',', CASE WHEN max_lag_ms > 200 THEN 'lag' END, CASE WHEN out_of_order::DOUBLE / readings > 0.01 THEN 'out_of_order' END) AS reasons FROM st")
def health_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, why = metrics.verdict(F.col("max_lag_ms"), F.col("out_of_order"), F.col("readings"))
    return _stats(spark, sf_dir).select("sensor_id", v.alias("verdict"), F.array_join(why, ",").alias("reasons"))


_DAY = 86400 * S


def _timing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each sensor by day, from which any span of days follows."""
    return sketches.buckets(_timed(spark, sf_dir), KEYS, "received", "delta_ms", _DAY)


@query(f"""WITH {_TIMED} SELECT sensor_id, received // {7 * _DAY} AS week, count(*) AS readings, count(delta_ms) AS n, CAST(round(sum(delta_ms) * 1000) AS BIGINT) AS total_us, round(stddev_samp(delta_ms), 2) AS stdev, min(delta_ms) AS least, max(delta_ms) AS greatest FROM tm GROUP BY ALL""")
def timing_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between readings by week, merged from days."""
    weeks = sketches.statistics(sketches.coarser(_timing_days(spark, sf_dir), KEYS, 7))
    return weeks.select("sensor_id", F.col("bucket").alias("week"), "readings", "n", F.round(F.col("mean") * F.col("n") * 1000).cast("long").alias("total_us"), F.round("stdev", 2).alias("stdev"), "least", "greatest")


@query(f"""WITH {_TIMED} SELECT sensor_id, count(*) AS readings, count(delta_ms) AS n, CAST(round(sum(delta_ms) * 1000) AS BIGINT) AS total_us, round(stddev_samp(delta_ms), 2) AS stdev, min(delta_ms) AS least, max(delta_ms) AS greatest FROM tm GROUP BY ALL""")
def timing_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between readings over the whole history, merged from weeks that were merged from days."""
    weeks = sketches.coarser(_timing_days(spark, sf_dir), KEYS, 7)
    whole = sketches.statistics(sketches.merged(weeks, KEYS))
    return whole.select("sensor_id", "readings", "n", F.round(F.col("mean") * F.col("n") * 1000).cast("long").alias("total_us"), F.round("stdev", 2).alias("stdev"), "least", "greatest")


@query(f"""WITH RECURSIVE {READINGS}, o AS (SELECT user_id % 10 AS name, epoch_us(ts) AS t, event_id AS sequence, event_type NOT IN ('error', 'click') AS ok, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS n FROM events),
    s AS (SELECT name, n, sequence, CASE WHEN ok THEN 'CLOSED' ELSE 'CLOSED' END AS mode, CASE WHEN ok THEN 0 ELSE 1 END AS failed, 0 AS won, CASE WHEN ok THEN 0 ELSE t END AS since, CAST('CLOSED' AS VARCHAR) AS breaker FROM o WHERE n = 1
        UNION ALL SELECT name, n, sequence, CASE WHEN turned THEN 'OPEN' WHEN ok THEN CASE WHEN m = 'HALF_OPEN' AND w + 1 < 2 THEN 'HALF_OPEN' ELSE 'CLOSED' END ELSE CASE WHEN m = 'HALF_OPEN' OR failed + 1 >= 3 THEN 'OPEN' ELSE 'CLOSED' END END,
            CASE WHEN turned THEN failed WHEN ok THEN CASE WHEN m = 'HALF_OPEN' AND w + 1 < 2 THEN failed ELSE 0 END ELSE failed + 1 END, CASE WHEN turned THEN w WHEN ok AND m = 'HALF_OPEN' THEN w + 1 ELSE w END, CASE WHEN turned OR ok THEN since ELSE t END,
            CASE WHEN turned THEN 'REJECTED' WHEN ok THEN CASE WHEN m = 'HALF_OPEN' AND w + 1 < 2 THEN 'HALF_OPEN' ELSE 'CLOSED' END ELSE CASE WHEN m = 'HALF_OPEN' OR failed + 1 >= 3 THEN 'OPEN' ELSE 'CLOSED' END END
        FROM (SELECT o.name, o.n, o.sequence, o.ok, o.t, s.failed, s.since, CASE WHEN s.mode = 'OPEN' AND o.t - s.since >= {3600 * S} THEN 'HALF_OPEN' ELSE s.mode END AS m, CASE WHEN s.mode = 'OPEN' AND o.t - s.since >= {3600 * S} THEN 0 ELSE s.won END AS w,
            s.mode = 'OPEN' AND o.t - s.since < {3600 * S} AS turned FROM s JOIN o ON o.name = s.name AND o.n = s.n + 1))
    SELECT sequence, breaker FROM s""")
def circuit_breaker_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _readings(spark, sf_dir).select((F.col("sensor_id") % 10).alias("name"), "t", "sequence", (~F.col("event_type").isin("error", "click")).alias("ok"))
    return folds.breaker(r, ["name"], "t", "ok", ORDER, failures=3, recovery_seconds=3600).select("sequence", "breaker")


@query(f"""WITH RECURSIVE {READINGS}, o AS (SELECT *, CASE WHEN value > 150 THEN 'critical' WHEN value > 90 THEN 'warning' END AS severity, row_number() OVER (PARTITION BY sensor_id ORDER BY t, sequence) AS n FROM r),
    s AS (SELECT sensor_id, n, sequence, CAST('INITIALIZING' AS VARCHAR) AS state FROM o WHERE n = 1
        UNION ALL SELECT o.sensor_id, o.n, o.sequence, CASE WHEN o.n < 10 THEN 'INITIALIZING' WHEN severity = 'critical' THEN 'ALERT' WHEN severity = 'warning' THEN CASE WHEN s.state = 'ALERT' THEN 'ALERT' ELSE 'WARNING' END ELSE 'NORMAL' END
        FROM s JOIN o ON o.sensor_id = s.sensor_id AND o.n = s.n + 1)
    SELECT sequence, state FROM s""")
def state_machine_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _readings(spark, sf_dir).withColumn("severity", F.when(F.col("value") > 150, "critical").when(F.col("value") > 90, "warning"))
    return folds.states(r, KEYS, "severity", ORDER).select("sequence", "state")


@query(f"""WITH {READINGS}, {_RANGES}, g AS (SELECT r.* FROM r LEFT JOIN rg USING (sensor_id) WHERE NOT {_OUT})
    SELECT sequence, coalesce(value = lag(value) OVER (PARTITION BY sensor_id ORDER BY t, sequence), false) AS skipped FROM (SELECT sensor_id, t, sequence, floor(value / 10) AS value FROM g)""")
def prediction_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _readings(spark, sf_dir).join(ranges(spark, sf_dir), "sensor_id", "left").where(~guards.below_or_above(F.col("value"), F.col("low"), F.col("high")))
    r = r.withColumn("value", F.floor(F.col("value") / 10))
    return r.select("sequence", F.coalesce(F.col("value") == F.lag("value").over(history.by(KEYS, ORDER)), F.lit(False)).alias("skipped"))


QUERIES, ORACLE_SQL = query.queries, query.sql
