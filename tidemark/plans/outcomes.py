"""What readings lead to: alerts, warnings, notifications, newest values, predictions, dead letters, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.functions import guards, rules
from tidemark.operators import events, folds, history, predict
from tidemark.plans.base import COOLDOWN, FRESH, NOW, READINGS, SPIKES, THRESHOLDS_SQL, Registry, thresholds
from tidemark.plans.sequences import _IOT, _OUT, _RANGES, _TYPED, _previous, _spaced_sql, ranges
from tidemark.sources import readings, sinks

query = Registry()
KEYS, ORDER = ["sensor_id"], ["t", "sequence"]
S = 1_000_000


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.event_readings(spark, sf_dir)


@query(f"WITH {READINGS} SELECT sensor_id, arg_max(value, (t, sequence)) AS latest_value, max(t) AS latest_t FROM r GROUP BY sensor_id")
def latest_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _readings(spark, sf_dir).select("sensor_id", "t", "sequence", F.col("value").alias("latest_value"), F.col("t").alias("latest_t"))
    return sinks.latest(r, KEYS, ORDER, ["latest_value", "latest_t"])


_VIOLATIONS = f"{READINGS}, {_RANGES}, vio AS (SELECT r.*, sensor_id * 10 + 2 AS threshold_id FROM r JOIN rg USING (sensor_id) WHERE {_OUT})"


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _readings(spark, sf_dir).join(ranges(spark, sf_dir), "sensor_id")
    return r.where(guards.below_or_above(F.col("value"), F.col("low"), F.col("high"))).withColumn("threshold_id", F.col("sensor_id") * 10 + 2)


@query(f"""WITH {_VIOLATIONS} SELECT sensor_id, arg_min(sequence, (t, sequence)) AS alert_id, arg_max(threshold_id, (t, sequence)) AS threshold_id, arg_max(value, (t, sequence)) AS triggered_value, max(t) AS triggered_t,
    'critical' AS severity, 'active' AS status, count(*) AS updates FROM vio GROUP BY sensor_id""")
def active_alert_per_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.active_alerts(_violations(spark, sf_dir))


@query(f"WITH {_VIOLATIONS} SELECT sensor_id, sequence, value, t FROM vio")
def alert_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _violations(spark, sf_dir).select("sensor_id", "sequence", "value", "t")


_BAND = "coalesce((warning_min IS NOT NULL OR warning_max IS NOT NULL) AND NOT coalesce(value < warning_min, false) AND NOT coalesce(value > warning_max, false), false)"
_ELIGIBLE = f"""{_TYPED}, el AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY t, sequence) >= 10 AS open_, {_BAND} AS band FROM spike)"""


def _eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = events.with_spike(_previous(spark, sf_dir), SPIKES)
    n = F.row_number().over(history.by(KEYS, ORDER))
    band = F.coalesce(rules.within_band(F.col("value"), F.col("warning_min"), F.col("warning_max")), F.lit(False))
    out = guards.below_or_above(F.col("value"), F.col("low"), F.col("high"))
    return r.withColumn("open", n >= K.WARM_UP_READINGS).withColumn("band", band).withColumn("out", out).withColumn("spiked", F.coalesce(F.size("triggered"), F.lit(0)) > 0)


@query(f"WITH {_ELIGIBLE} SELECT sequence, CASE WHEN NOT open_ THEN 'blocked' WHEN band THEN 'warning_band' WHEN previous_value IS NULL THEN 'no_recent_history' WHEN coalesce(len(triggered), 0) = 0 THEN 'no_spike' ELSE 'eligible' END AS outcome FROM el")
def warning_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _eligible(spark, sf_dir)
    outcome = F.when(~F.col("open"), "blocked").when(F.col("band"), "warning_band").when(F.col("previous_value").isNull(), "no_recent_history").when(~F.col("spiked"), "no_spike").otherwise("eligible")
    return e.select("sequence", outcome.alias("outcome"))


@query(f"WITH {_ELIGIBLE} SELECT sequence, CASE WHEN out_ THEN 'physical_violation' WHEN NOT open_ THEN 'clean' WHEN previous_value IS NULL THEN 'clean' WHEN len(triggered) > 0 THEN 'spike' ELSE 'clean' END AS outcome FROM el")
def prediction_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _eligible(spark, sf_dir)
    outcome = F.when(F.col("out"), "physical_violation").when(F.col("open") & F.col("previous_value").isNotNull() & F.col("spiked"), "spike").otherwise("clean")
    return e.select("sequence", outcome.alias("outcome"))


_TITLE = "CASE WHEN list_contains(triggered, 'abs_delta') OR list_contains(triggered, 'rel_delta') THEN 'Cambio significativo en valor' WHEN list_contains(triggered, 'abs_slope') THEN 'Cambio rápido detectado' ELSE 'Variación inusual detectada' END"


@query(f"""WITH {_ELIGIBLE}, w AS (SELECT * FROM el WHERE open_ AND NOT band AND coalesce(len(triggered), 0) > 0)
    SELECT sensor_id, arg_min(sequence, (t, sequence)) AS event_id, 'DELTA_SPIKE' AS event_code, 'warning' AS event_type, 'active' AS status, max(t) AS created_t, arg_max({_TITLE}, (t, sequence)) AS title,
        arg_max(array_to_string(triggered, ','), (t, sequence)) AS triggered FROM w GROUP BY sensor_id""")
def active_warning_per_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _eligible(spark, sf_dir).where("open and not band and spiked").withColumn("title", rules.spike_title(F.lit("warning"), F.col("triggered"))).withColumn("joined", F.array_join("triggered", ","))
    a = w.groupBy("sensor_id").agg(F.min_by("sequence", F.struct(*ORDER)).alias("event_id"), F.max(F.struct(*ORDER, "title", "joined")).alias("x"))
    kind = rules.event_type_online(F.lit("warning"))
    return a.select("sensor_id", "event_id", F.lit("DELTA_SPIKE").alias("event_code"), kind.alias("event_type"), F.lit("active").alias("status"), F.col("x.t").alias("created_t"), "x.title", F.col("x.joined").alias("triggered"))


@query(f"WITH RECURSIVE {_VIOLATIONS}, {_spaced_sql('vio', 'sensor_id', 24 * 3600)} SELECT sensor_id, sequence AS source_event_id, '🚨 ALERTA CRÍTICA: Sensor ' || sensor_id AS title, false AS is_read FROM acc WHERE accepted")
def notifications_deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = folds.spaced(_violations(spark, sf_dir), KEYS, "t", 24 * 3600, ORDER).where("accepted")
    # Fixed: the title's words.
    return told.select("sensor_id", F.col("sequence").alias("source_event_id"), F.concat(F.lit("🚨 ALERTA CRÍTICA: Sensor "), "sensor_id").alias("title"), F.lit(False).alias("is_read"))


@query(f"""WITH {READINGS}, sp AS (SELECT sensor_id, t FROM r WHERE event_type = 'error'), ok AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.sensor_id = r.sensor_id AND sp.t BETWEEN r.t - {3600 * S} AND r.t + {3600 * S}))
    SELECT sensor_id, arg_max(value, (t, sequence)) AS value, max(t) AS t FROM ok WHERE t >= {NOW} - {10 * 86400 * S} GROUP BY sensor_id""")
def last_clean_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _readings(spark, sf_dir)
    spikes = r.where("event_type = 'error'").select(F.col("sensor_id").alias("s"), F.col("t").alias("at"))
    # buckets of the interval's width make the range an equality: a spike counts in its bucket and both beside it
    width = 3600 * S
    near = spikes.select("s", "at", F.explode(F.array(*(F.expr(f"at div {width}") + k for k in (-1, 0, 1)))).alias("b"))
    recent = r.where(F.col("t") >= NOW - 10 * 86400 * S).withColumn("b", F.expr(f"t div {width}"))
    clean = recent.join(near, (F.col("sensor_id") == F.col("s")) & (recent.b == near.b) & (F.abs(F.col("t") - F.col("at")) <= width), "left_anti")
    return sinks.latest(clean, KEYS, ORDER, ["value", "t"]).select("sensor_id", "value", "t")


@query(f"""WITH {READINGS}, pr AS (SELECT sensor_id, sequence AS prediction_id, t + {3600 * S} AS target_t FROM r WHERE k < 20)
    SELECT prediction_id, sensor_id, target_t, (SELECT arg_min(value, (r.t, r.sequence)) FROM r WHERE r.sensor_id = pr.sensor_id AND r.t > pr.target_t) AS actual FROM pr""")
def next_actual_after_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _readings(spark, sf_dir)
    made = r.where("k < 20").select("sensor_id", (F.col("t") + 3600 * S).alias("target_t"), F.col("sequence").alias("prediction_id"))
    return history.as_of_forward(made, r, "sensor_id", "target_t", "t", "value", ties="sequence").select("prediction_id", "sensor_id", "target_t", "actual")


_OFFSETS = "off_ AS (SELECT sensor_id, max(sequence) - 20 * (sensor_id % 2) AS last FROM r WHERE sensor_id % 3 <> 0 GROUP BY sensor_id)"


def _offsets(r: DataFrame) -> DataFrame:
    return r.where("sensor_id % 3 <> 0").groupBy("sensor_id").agg((F.max("sequence") - 20 * (F.col("sensor_id") % 2)).alias("last"))


@query(f"WITH {READINGS}, {_OFFSETS}, n AS (SELECT sensor_id, max(sequence) AS newest FROM r GROUP BY sensor_id) SELECT sensor_id, coalesce(last, 0) AS last, newest FROM n LEFT JOIN off_ USING (sensor_id) WHERE newest > coalesce(last, 0)")
def watermark_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _readings(spark, sf_dir)
    return predict.pending(r, _offsets(r))


@query(f"WITH {READINGS}, {_OFFSETS}, n AS (SELECT sensor_id, max(sequence) AS newest FROM r GROUP BY sensor_id) SELECT sensor_id, greatest(coalesce(last, 0), newest) AS last FROM n LEFT JOIN off_ USING (sensor_id)")
def watermark_advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _readings(spark, sf_dir)
    off = _offsets(r)
    return predict.advanced(off, predict.pending(r, off))


_AVERAGE = f"""{READINGS}, tp AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY t DESC, sequence DESC) AS place FROM r), pd AS (SELECT sensor_id, round(avg(value), 6) AS predicted_value, count(*) AS n, count(*) / 60.0::DOUBLE AS confidence FROM tp WHERE place <= 60 GROUP BY sensor_id HAVING count(*) >= 2)"""


def _average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict.moving_average(_readings(spark, sf_dir)).withColumn("predicted_value", F.round("predicted_value", 6))


@query(f"WITH {_AVERAGE} SELECT * FROM pd")
def moving_average_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _average(spark, sf_dir)


_SHORT = _AVERAGE.replace("place <= 60", "place <= 3")


@query(f"""WITH {_SHORT}, {THRESHOLDS_SQL}, b AS (SELECT sensor_id, low AS wl, high AS wh FROM th WHERE id % 10 = 1), f AS (SELECT sensor_id, min(id) AS id FROM th WHERE id % 10 <> 1 OR sensor_id % 3 = 0 GROUP BY sensor_id),
        rc AS (SELECT DISTINCT sensor_id FROM r WHERE event_type = 'error' AND t >= {NOW} - {36 * 3600 * S}),
        x AS (SELECT pd.*, th.id, th.condition_type, th.low, th.high, th.severity FROM pd JOIN f USING (sensor_id) JOIN th ON th.id = f.id)
    SELECT sensor_id, predicted_value, id AS threshold_id, CASE WHEN severity IN ('critical', 'warning') THEN severity ELSE 'notice' END AS event_type, 'PRED_THRESHOLD_BREACH' AS event_code, 'active' AS status
    FROM x LEFT JOIN (SELECT * FROM b WHERE sensor_id % 3 = 0) b USING (sensor_id) WHERE NOT (wl IS NOT NULL AND predicted_value >= wl AND predicted_value <= wh)
        AND CASE condition_type WHEN 'greater_than' THEN predicted_value > low WHEN 'less_than' THEN predicted_value < low ELSE low IS NOT NULL AND high IS NOT NULL AND (predicted_value < low OR predicted_value > high) END
        AND sensor_id NOT IN (SELECT sensor_id FROM rc)""")
def prediction_threshold_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    th = thresholds(spark, sf_dir).where("id % 10 <> 1 or sensor_id % 3 = 0")
    recent = _readings(spark, sf_dir).where("event_type = 'error'").select("sensor_id", F.lit("PRED_THRESHOLD_BREACH").alias("event_code"), F.lit("acknowledged").alias("status"), F.col("t").alias("created_t"))
    short = predict.moving_average(_readings(spark, sf_dir), 3).withColumn("predicted_value", F.round("predicted_value", 6))
    return predict.breaches(short, th, recent, NOW, 36 * 3600)


@query(f"""WITH {READINGS} SELECT sequence AS id, sensor_id, k / 100.0::DOUBLE AS anomaly_score, t + 600000000 AS target_t FROM r WHERE k % 2 = 0 AND k / 100.0 >= 0.8 AND k % 3 <> 0 ORDER BY target_t DESC, id DESC LIMIT 50""")
def anomalies_to_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    made = _readings(spark, sf_dir).select(F.col("sequence").alias("id"), "sensor_id", (k % 2 == 0).alias("is_anomaly"), (k / 100.0).alias("anomaly_score"), (F.col("t") + 600 * S).alias("target_t"), F.when(k % 3 == 0, "known").when(k % 3 == 1, "  ").alias("explanation"))
    return predict.to_explain(made).select("id", "sensor_id", "anomaly_score", "target_t")


@query(f"""WITH {READINGS}, {THRESHOLDS_SQL}, a AS (SELECT sequence AS id, sensor_id, value, k / 100.0::DOUBLE AS anomaly_score FROM r WHERE k % 2 = 0 AND k / 100.0 >= 0.8 AND k % 3 <> 0 ORDER BY t DESC, id DESC LIMIT 50),
        b AS (SELECT sensor_id, low, high FROM th WHERE id % 10 = 2)
    SELECT a.id, a.sensor_id, 'industrial_iot_monitoring' AS context, 'generic' AS metric, value AS observed_value, anomaly_score,
        CASE WHEN low IS NOT NULL AND high IS NOT NULL THEN low || '-' || high WHEN low IS NOT NULL THEN '>= ' || low WHEN high IS NOT NULL THEN '<= ' || high ELSE 'unknown' END AS expected_range FROM a LEFT JOIN b USING (sensor_id) WHERE value IS NOT NULL""")
def explanation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest anomalies without an explanation as requests, read back from their JSON."""
    k = F.col("k")
    made = _readings(spark, sf_dir).select(F.col("sequence").alias("id"), "sensor_id", F.col("value").alias("predicted_value"), (k % 2 == 0).alias("is_anomaly"), (k / 100.0).alias("anomaly_score"), (F.col("t") + 600 * S).alias("target_t"), F.when(k % 3 == 0, "known").when(k % 3 == 1, "  ").alias("explanation"))
    first = thresholds(spark, sf_dir).where("id % 10 = 2").groupBy("sensor_id").agg(F.min_by(F.struct("low", "high"), "id").alias("b"))
    asked = predict.explanation_requests(predict.to_explain(made), first.select("sensor_id", rules.expected_range(F.col("b.low"), F.col("b.high")).alias("expected_range")))
    x = asked.withColumn("x", F.from_json("request", "context string, model_output struct<metric string, observed_value double, expected_range string, anomaly_score double>"))
    return x.select("id", "sensor_id", "x.context", "x.model_output.metric", "x.model_output.observed_value", "x.model_output.anomaly_score", "x.model_output.expected_range")


@query(f"""WITH {READINGS} SELECT sequence, CASE WHEN k % 7 = 0 OR ({NOW} - t) / 1000000.0 > {20 * 86400} THEN 'deleted' WHEN k % 5 >= 3 THEN 'archived' ELSE 'requeued' END AS fate, CASE WHEN NOT (k % 7 = 0 OR ({NOW} - t) / 1000000.0 > {20 * 86400}) AND k % 5 < 3 THEN k % 5 + 1 ELSE k % 5 END AS retry_count FROM r""")
def dlq_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _readings(spark, sf_dir).withColumn("retries", F.col("k") % 5)
    fate = rules.dead_letter_fate(F.col("k") % 7 == 0, F.col("retries"), (F.lit(NOW) - F.col("t")) / 1e6, max_age=20 * 86400)
    return r.select("sequence", fate.alias("fate"), F.when(fate == "requeued", F.col("retries") + 1).otherwise(F.col("retries")).alias("retry_count"))


@query(f"WITH {READINGS} SELECT sequence, sensor_id, value FROM r ORDER BY t DESC, sequence DESC LIMIT 200")
def bounded_stream_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.tail(_readings(spark, sf_dir), [F.desc("t"), F.desc("sequence")], 200).select("sequence", "sensor_id", "value")


_STATUS = f"""{_ELIGIBLE}, al AS (SELECT sensor_id, arg_max(value, (t, sequence)) AS alert_value FROM el WHERE out_ AND t >= {NOW} - {5 * 86400 * S} GROUP BY sensor_id),
    wa AS (SELECT sensor_id, max(t) AS warning_t FROM el WHERE open_ AND NOT band AND coalesce(len(triggered), 0) > 0 AND t >= {NOW} - {15 * 86400 * S} GROUP BY sensor_id),
    pr AS (SELECT sensor_id, count(*) AS n FROM el WHERE NOT out_ GROUP BY sensor_id HAVING count(*) >= 2)"""


@query(f"""WITH {_STATUS} SELECT s.sensor_id, alert_value, warning_t, CASE WHEN al.sensor_id IS NOT NULL THEN 'ALERT' WHEN wa.sensor_id IS NOT NULL THEN 'WARNING' WHEN pr.sensor_id IS NOT NULL THEN 'PREDICTION' ELSE 'UNKNOWN' END AS final_state
    FROM (SELECT DISTINCT sensor_id FROM el) s LEFT JOIN al USING (sensor_id) LEFT JOIN wa USING (sensor_id) LEFT JOIN pr USING (sensor_id)""")
def sensor_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass and one exchange: the newest alert, the newest warning and the predictions of a sensor are aggregates of the same rows."""
    e = _eligible(spark, sf_dir)
    alert = F.col("out") & (F.col("t") >= NOW - 5 * 86400 * S)
    warning = F.col("open") & ~F.col("band") & F.col("spiked") & (F.col("t") >= NOW - 15 * 86400 * S)
    a = e.groupBy("sensor_id").agg(F.max(F.when(alert, F.struct("t", "sequence", "value"))).alias("a"), F.max(F.when(warning, F.col("t"))).alias("warning_t"), F.count_if(~F.col("out")).alias("n"))
    return a.select("sensor_id", F.col("a.value").alias("alert_value"), "warning_t", rules.final_state(F.col("a").isNotNull(), F.col("warning_t").isNotNull(), F.col("n") >= 2).alias("final_state"))


@query(f"WITH {READINGS}, old AS (SELECT sensor_id, min(value) AS value FROM r WHERE sensor_id % 2 = 0 GROUP BY sensor_id), new AS (SELECT sensor_id, max(value) AS value FROM r WHERE sensor_id % 3 = 0 GROUP BY sensor_id) SELECT coalesce(new.sensor_id, old.sensor_id) AS sensor_id, coalesce(new.value, old.value) AS value FROM old FULL JOIN new ON old.sensor_id = new.sensor_id")
def upserted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _readings(spark, sf_dir)
    old = r.where("sensor_id % 2 = 0").groupBy("sensor_id").agg(F.min("value").alias("value"))
    new = r.where("sensor_id % 3 = 0").groupBy("sensor_id").agg(F.max("value").alias("value"))
    return sinks.upserted(old, new, ["sensor_id"])


@query("""SELECT n_name, CASE WHEN s_suppkey % 3 = 0 THEN 'idle' ELSE 'online' END AS device_state, count(*) AS readings, min(l_quantity) AS least, max(l_quantity) AS largest, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS total
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""")
def volume_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest table as readings of devices, joined to their dimensions."""
    li = readings.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity")
    per_device = li.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"))
    s, n = readings.table(spark, sf_dir, "supplier"), readings.table(spark, sf_dir, "nation")
    j = per_device.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    state = F.when(F.col("s_suppkey") % 3 == 0, "idle").otherwise("online")
    return j.groupBy("n_name", state.alias("device_state")).agg(F.sum("n").alias("readings"), F.min("lo").alias("least"), F.max("hi").alias("largest"), F.sum("q").cast("double").alias("total"))


QUERIES, ORACLE_SQL = query.queries, query.sql
