"""Guards, thresholds and lookups over readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.functions import guards, rules
from tidemark.plans.base import NOW, READINGS, THRESHOLDS_SQL, Registry, thresholds
from tidemark.sources import readings

query = Registry()
_LIMITS = ", ".join(f"('{k}', CAST({a!r} AS DOUBLE), CAST({b!r} AS DOUBLE))" for k, (a, b) in K.GUARD_LIMITS.items())
_RANGES = ", ".join(f"('{k}', CAST({a!r} AS DOUBLE), CAST({b!r} AS DOUBLE))" for k, (a, b) in K.MESSAGE_RANGES.items())
GUARDED = f"""{READINGS}, limits (sensor_type, low, high) AS (VALUES {_LIMITS}), x AS (
    SELECT r.*, low, high, r.t + CASE WHEN k = 7 THEN {31 * 86400} * CAST(1000000 AS BIGINT) ELSE 0 END AS moment FROM r LEFT JOIN limits USING (sensor_type)
), g AS (
    SELECT *, CASE WHEN sensor_id IS NULL THEN 'SENSOR_ID_NULL' WHEN sensor_id <= 0 THEN 'SENSOR_ID_INVALID' WHEN value IS NULL THEN 'VALUE_NULL' WHEN isnan(value) THEN 'VALUE_NAN' WHEN isinf(value) THEN 'VALUE_INFINITE'
        WHEN value < low THEN 'VALUE_BELOW_LIMIT' WHEN value > high THEN 'VALUE_ABOVE_LIMIT' WHEN moment > {NOW} + 300000000 THEN 'TIMESTAMP_FUTURE' WHEN moment < {NOW} - 2592000000000 THEN 'TIMESTAMP_TOO_OLD' END AS reason
    FROM x)"""


def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings.event_readings(spark, sf_dir).withColumn("at", F.col("t") + F.when(F.col("k") == 7, F.lit(31 * 86400 * K.SECOND)).otherwise(0))
    return r.withColumn("reason", guards.reading_reason(F.col("sensor_id"), F.col("value"), F.col("at"), NOW, F.col("sensor_type")))


@query(f"WITH {GUARDED} SELECT sequence, reason FROM g")
def guard_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guarded(spark, sf_dir).select("sequence", "reason")


@query(f"WITH {GUARDED} SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS n FROM g GROUP BY ALL")
def guard_reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guarded(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {GUARDED} SELECT substr('reading ' || sequence, 1, 5000) AS payload, reason AS error, 'validation_error' AS error_type, 'http' AS source, moment AS timestamp, 0 AS retry_count FROM g WHERE reason IS NOT NULL")
def dead_letter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = guarded(spark, sf_dir).where("reason is not null")
    return readings.dead_letters(bad, F.concat(F.lit("reading "), F.col("sequence").cast("string")), F.col("reason"), F.lit("validation_error"), "http", F.col("at"))


@query(f"""WITH {READINGS}, m AS (SELECT sequence, k, sensor_id, value, t,
        CASE WHEN k % 10 = 1 THEN 11 ELSE 1 END AS v, CASE WHEN k % 10 = 2 THEN ' ' WHEN k % 10 = 3 THEN 'abc' ELSE CAST(sensor_id AS VARCHAR) END AS s, CASE WHEN k % 10 = 4 THEN 1e12 ELSE value END AS val FROM r)
    SELECT sequence, CASE WHEN k % 10 = 5 THEN 'parse_error' WHEN v > 10 OR trim(s) = '' OR TRY_CAST(trim(s) AS BIGINT) IS NULL OR abs(val) >= 1e12 OR k % 10 = 6 OR t < {NOW} - 86400000000 THEN 'validation_error' END AS error,
        CASE WHEN k % 10 = 5 THEN 'NOT_JSON' WHEN v > 10 THEN 'VERSION_INVALID' WHEN trim(s) = '' THEN 'SENSOR_ID_BLANK' WHEN TRY_CAST(trim(s) AS BIGINT) IS NULL THEN 'SENSOR_ID_NOT_NUMERIC'
            WHEN abs(val) >= 1e12 THEN 'VALUE_OUT_OF_BOUNDS' WHEN k % 10 = 6 THEN 'TIMESTAMP_INVALID' WHEN t < {NOW} - 86400000000 THEN 'TIMESTAMP_TOO_OLD' END AS reason FROM m""")
def mqtt_payload_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, d = readings.event_readings(spark, sf_dir), F.col("k") % 10
    made = F.to_json(F.struct(
        F.when(d == 1, 11).otherwise(1).alias("v"),
        F.when(d == 2, " ").when(d == 3, "abc").otherwise(F.col("sensor_id").cast("string")).alias("sensorId"),
        F.when(d == 4, 1e12).otherwise(F.col("value")).alias("value"),
        F.when(d == 6, "soon").otherwise(F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("timestamp"),
        F.create_map(F.lit("sequence"), F.col("sequence").cast("string")).alias("metadata"),
    ))
    raw = r.select(F.lit("iot/sensors/1/readings").alias("topic"), F.when(d == 5, F.concat(F.lit("{oops "), F.col("sequence").cast("string"))).otherwise(made).alias("payload"))
    out = readings.messages(raw, NOW)
    return out.select(F.coalesce("sequence", F.regexp_extract("payload", r"^\{oops (\d+)$", 1).try_cast("long")).alias("sequence"), "error", "reason")


@query(f"""WITH {READINGS}, ranges (sensor_type, low, high) AS (VALUES {_RANGES})
    SELECT sequence, r.value < coalesce(a.low, u.low) OR r.value > coalesce(a.high, u.high) AS out_of_range FROM r LEFT JOIN ranges a USING (sensor_type), ranges u WHERE u.sensor_type = 'unknown'""")
def physical_range_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings.event_readings(spark, sf_dir)
    return r.select("sequence", guards.out_of_message_range(F.col("value"), F.col("sensor_type")).alias("out_of_range"))


@query(f"""WITH {READINGS} SELECT sequence, CASE WHEN k = 0 THEN 0.0 ELSE value END <= 1e-6 AND (sensor_type IS NULL OR sensor_type IN ('temperature', 'humidity', 'pressure', 'ph')) AS suspicious FROM r""")
def suspicious_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings.event_readings(spark, sf_dir).withColumn("value", F.when(F.col("k") == 0, 0.0).otherwise(F.col("value")))
    return r.select("sequence", guards.suspicious_zero(F.col("value"), F.col("sensor_type")).alias("suspicious"))


_RULED = f"{READINGS}, {THRESHOLDS_SQL}, j AS (SELECT r.sequence, r.value, th.* FROM r JOIN th USING (sensor_id))"
_ONLINE = "coalesce(CASE condition_type WHEN 'greater_than' THEN value > low WHEN 'less_than' THEN value < high ELSE coalesce(value < low, false) OR coalesce(value > high, false) END, false)"
_BATCH = "coalesce(CASE condition_type WHEN 'greater_than' THEN value > low WHEN 'less_than' THEN value < low WHEN 'equal_to' THEN value = low ELSE low IS NOT NULL AND high IS NOT NULL AND (value < low OR value > high) END, false)"


def ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with each rule of their sensor."""
    return readings.event_readings(spark, sf_dir).join(thresholds(spark, sf_dir), "sensor_id")


def _of(f, columns=("condition_type", "low", "high", "value")):
    return f(*map(F.col, columns))


@query(f"WITH {_RULED} SELECT sequence, id, {_ONLINE} AS violated FROM j")
def threshold_rule_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ruled(spark, sf_dir).select("sequence", "id", _of(rules.violates_online).alias("violated"))


@query(f"WITH {_RULED} SELECT sequence, id, {_BATCH} AS violated FROM j")
def threshold_rule_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ruled(spark, sf_dir).select("sequence", "id", _of(rules.violates_batch).alias("violated"))


@query(f"""WITH {_RULED}, v AS (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY CASE WHEN severity = 'critical' THEN 0 ELSE 1 END, id) AS n FROM j WHERE {_ONLINE})
    SELECT sequence, id AS threshold_id, severity FROM v WHERE n = 1""")
def first_violated_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = ruled(spark, sf_dir).where(_of(rules.violates_online))
    first = F.min(F.struct(F.when(F.col("severity") == "critical", 0).otherwise(1).alias("o"), "id", "severity"))
    return hits.groupBy("sequence").agg(first.alias("x")).select("sequence", F.col("x.id").alias("threshold_id"), "x.severity")


@query(f"""WITH {THRESHOLDS_SQL} SELECT sensor_id,
        arg_min(low, id) FILTER (WHERE severity = 'warning' AND condition_type = 'out_of_range' AND low IS NOT NULL) AS warning_min, arg_min(high, id) FILTER (WHERE severity = 'warning' AND condition_type = 'out_of_range' AND low IS NOT NULL) AS warning_max,
        arg_min(low, id) FILTER (WHERE severity = 'critical' AND condition_type = 'out_of_range' AND low IS NOT NULL) AS critical_min, arg_min(high, id) FILTER (WHERE severity = 'critical' AND condition_type = 'out_of_range' AND low IS NOT NULL) AS critical_max
    FROM th GROUP BY sensor_id""")
def canonical_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(thresholds(spark, sf_dir))


def canonical(th: DataFrame) -> DataFrame:
    """One row per sensor: the first warning pair and the first critical pair that have a minimum."""
    def pair(severity: str, column: str):
        where = (F.col("severity") == severity) & (F.col("condition_type") == "out_of_range") & F.col("low").isNotNull()
        return F.min_by(F.when(where, F.col(column)), F.when(where, F.col("id")))

    return th.groupBy("sensor_id").agg(*(pair(s, c).alias(f"{s}_{n}") for s in ("warning", "critical") for c, n in (("low", "min"), ("high", "max"))))


@query(f"""WITH {READINGS}, {THRESHOLDS_SQL}, b AS (SELECT sensor_id, arg_min(low, id) AS low, arg_min(high, id) AS high FROM th WHERE severity = 'warning' AND condition_type = 'out_of_range' GROUP BY sensor_id)
    SELECT sequence, coalesce((low IS NOT NULL OR high IS NOT NULL) AND NOT coalesce(value < low, false) AND NOT coalesce(value > high, false), false) AS within_band FROM r LEFT JOIN b USING (sensor_id)""")
def warning_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = thresholds(spark, sf_dir).where("severity = 'warning' and condition_type = 'out_of_range'").groupBy("sensor_id").agg(F.min_by(F.struct("low", "high"), "id").alias("b"))
    j = readings.event_readings(spark, sf_dir).join(band, "sensor_id", "left")
    return j.select("sequence", F.coalesce(rules.within_band(F.col("value"), F.col("b.low"), F.col("b.high")), F.lit(False)).alias("within_band"))


_PACKETS = f"{READINGS}, u AS (SELECT sequence, 'DEV-' || sensor_id % 10 AS device_uuid, 'SEN-' || sensor_id AS sensor_uuid, value FROM r), s AS (SELECT DISTINCT lower('dev-' || user_id % 10) AS device_uuid, lower('sen-' || user_id) AS sensor_uuid, user_id AS sensor_id FROM events WHERE user_id % 8 <> 0)"


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings.event_readings(spark, sf_dir)
    one = F.struct(F.concat(F.lit("SEN-"), "sensor_id").alias("sensor_uuid"), "value", F.lit(None).cast("double").alias("sensor_ts"), "sequence")
    packets = r.select(F.concat(F.lit("DEV-"), (F.col("sensor_id") % 10).cast("string")).alias("device_uuid"), F.timestamp_micros("t").alias("ts"), F.array(one).alias("readings"))
    sensors = r.where("sensor_id % 8 <> 0").select(F.concat(F.lit("dev-"), (F.col("sensor_id") % 10).cast("string")).alias("device_uuid"), F.concat(F.lit("sen-"), F.col("sensor_id").cast("string")).alias("sensor_uuid"), "sensor_id").distinct()
    return readings.device_packets(packets, sensors, F.lit(NOW))


@query(f"WITH {_PACKETS} SELECT sequence, s.sensor_id FROM u JOIN s ON lower(u.device_uuid) = s.device_uuid AND lower(u.sensor_uuid) = s.sensor_uuid")
def resolve_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).where("sensor_id is not null").select("sequence", "sensor_id")


@query(f"WITH {_PACKETS} SELECT lower(u.sensor_uuid) AS sensor_uuid, count(*) AS n FROM u LEFT JOIN s ON lower(u.device_uuid) = s.device_uuid AND lower(u.sensor_uuid) = s.sensor_uuid WHERE s.sensor_id IS NULL GROUP BY ALL")
def unknown_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).where("sensor_id is null").groupBy("sensor_uuid").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {THRESHOLDS_SQL} SELECT sensor_id, CASE WHEN low IS NOT NULL AND high IS NOT NULL THEN low || '-' || high WHEN low IS NOT NULL THEN '>= ' || low WHEN high IS NOT NULL THEN '<= ' || high ELSE 'unknown' END AS expected_range
    FROM (SELECT sensor_id, arg_min(struct_pack(low := low, high := high), id) AS b FROM th WHERE id % 10 = 2 GROUP BY sensor_id) x, (SELECT 1), LATERAL (SELECT x.b.low AS low, x.b.high AS high)""")
def expected_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = thresholds(spark, sf_dir).where("id % 10 = 2").groupBy("sensor_id").agg(F.min_by(F.struct("low", "high"), "id").alias("b"))
    return first.select("sensor_id", rules.expected_range(F.col("b.low"), F.col("b.high")).alias("expected_range"))


@query(f"""WITH {READINGS}, c AS (SELECT r.*, dense_rank() OVER (ORDER BY sensor_id) AS d FROM r) SELECT sensor_id, 'Sensor ' || sensor_id AS sensor_name, coalesce(s_name, 'Dispositivo ' || (sensor_id % 150 + 1)) AS device_name, arg_max(coalesce(sensor_type, 'unknown'), (t, sequence)) AS sensor_type
    FROM c LEFT JOIN supplier ON s_suppkey = sensor_id % 150 + 1 GROUP BY ALL""")
def sensor_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = readings.event_readings(spark, sf_dir).groupBy("sensor_id").agg(F.max_by(F.coalesce("sensor_type", F.lit("unknown")), F.struct("t", "sequence")).alias("sensor_type"))
    device = (F.col("sensor_id") % 150 + 1).alias("device_id")
    names = readings.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("device_id"), "s_name")
    j = kinds.withColumn("device_id", device).join(names, "device_id", "left")
    return j.select("sensor_id", F.concat(F.lit("Sensor "), "sensor_id").alias("sensor_name"), F.coalesce("s_name", F.concat(F.lit("Dispositivo "), "device_id")).alias("device_name"), "sensor_type")


@query(f"""WITH {READINGS}, n AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY t DESC, sequence DESC) AS place FROM r) SELECT sensor_id, sequence, value, place FROM n WHERE place <= 5""")
def topn_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.history import newest

    return newest(readings.event_readings(spark, sf_dir), ["sensor_id"], [F.desc("t"), F.desc("sequence")], 5).select("sensor_id", "sequence", "value", F.col("place").cast("long"))


@query(f"""WITH {READINGS}, v AS (SELECT sensor_id, sequence, t, CASE WHEN k % 7 <> 0 THEN value END AS value FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY t DESC, sequence DESC) AS place FROM v)
    SELECT sensor_id, row_number() OVER (PARTITION BY sensor_id ORDER BY place DESC) AS nth, coalesce(value, 0.0) AS value, t FROM n WHERE place <= 5""")
def recent_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest five values of each sensor from the oldest to the newest, with 0 for those that are missing: what a prediction is given."""
    from tidemark.operators.history import newest

    r = readings.event_readings(spark, sf_dir).withColumn("value", F.coalesce(F.when(F.col("k") % 7 != 0, F.col("value")), F.lit(0.0)))
    last = newest(r, ["sensor_id"], [F.desc("t"), F.desc("sequence")], 5)
    rising = F.row_number().over(Window.partitionBy("sensor_id").orderBy(F.desc("place")))
    return last.select("sensor_id", rising.cast("long").alias("nth"), "value", "t")


@query(f"""WITH {READINGS} SELECT sequence, count(*) OVER (PARTITION BY sensor_id ORDER BY t RANGE BETWEEN 172800000000 PRECEDING AND CURRENT ROW) AS recent,
        CASE WHEN row_number() OVER (PARTITION BY sensor_id ORDER BY t, sequence) >= 10 THEN 'NORMAL' ELSE 'INITIALIZING' END AS state FROM r""")
def warmup_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("sensor_id").orderBy("t")
    n = F.row_number().over(Window.partitionBy("sensor_id").orderBy("t", "sequence"))
    return readings.event_readings(spark, sf_dir).select("sequence", F.count(F.lit(1)).over(w.rangeBetween(-48 * 3600 * K.SECOND, 0)).alias("recent"), F.when(n >= K.WARM_UP_READINGS, "NORMAL").otherwise("INITIALIZING").alias("state"))


QUERIES, ORACLE_SQL = query.queries, query.sql
