"""Points of several domains: keys, configuration joins, the universal classifier, alerts, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.functions import guards, rules, series
from tidemark.operators import history
from tidemark.plans.base import BOUNDS_SQL, NOW, POINTS, Registry, bounds
from tidemark.sources import readings, sinks

query = Registry()
SERIES, ORDER = ["series_id"], ["t", "sequence"]


def classified(points: DataFrame, config: DataFrame) -> DataFrame:
    """points with violated_constraint, constraint_value, previous_value, classification and confidence.

    config: bounds by (domain, stream_id), one row for each; points without any are normal. Bounds go before changes; the
    value before is the last one that no bound has stopped. A null or NaN value breaks no bound.
    """
    c = points.join(config.withColumn("configured", F.lit(True)), ["domain", "stream_id"], "left")
    bound = rules.violated_bound(F.col("value"), {b: F.col(b) for b in K.BOUNDS[:8]})
    c = c.withColumn("violated_constraint", bound)
    passes = F.col("configured").isNotNull() & F.col("violated_constraint").isNull()
    c = c.withColumn("previous_value", F.when(passes, history.last_where(F.col("value"), passes, history.before(SERIES, ORDER))))
    delta = rules.change_bound(F.col("value"), F.col("previous_value"), F.col("max_abs_delta"), F.col("max_rel_delta"))
    value = F.coalesce(*(F.when(F.col("violated_constraint") == b, F.col(b)) for b in K.BOUNDS[:8]))
    kind = rules.class_of(F.col("violated_constraint"), delta)
    return c.withColumn("constraint_value", value).withColumn("classification", kind).withColumn("confidence", F.when(kind == "anomaly", 0.9).otherwise(1.0)).drop("configured", *K.BOUNDS)


_ZONES = " ".join(f"WHEN value {'<' if s == 'min' else '>'} {z}_{s} THEN '{z}_{s}'" for z in ("physical", "critical", "operational", "warning") for s in ("min", "max"))
_VALUES = " ".join(f"WHEN '{b}' THEN {b}" for b in K.BOUNDS[:8])
CLASSIFIED = f"""{POINTS}, {BOUNDS_SQL}, c AS (
    SELECT p.*, b.* EXCLUDE (domain, stream_id), b.domain IS NOT NULL AS configured, CASE {_ZONES} END AS violated_constraint
    FROM p LEFT JOIN bounds b ON p.domain = b.domain AND p.stream_id = b.stream_id
), w AS (
    SELECT *, CASE WHEN configured AND violated_constraint IS NULL THEN
        last_value(CASE WHEN configured AND violated_constraint IS NULL THEN value END IGNORE NULLS)
            OVER (PARTITION BY series_id ORDER BY t, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS previous_value
    FROM c
), classified AS (
    SELECT series_id, domain, source_id, stream_id, value, t, sequence, previous_value, violated_constraint, CASE violated_constraint {_VALUES} END AS constraint_value,
        CASE WHEN violated_constraint LIKE 'physical%' OR violated_constraint LIKE 'critical%' THEN 'critical' WHEN violated_constraint IS NOT NULL THEN 'warning'
            WHEN abs(value - previous_value) > max_abs_delta OR (previous_value <> 0 AND abs((value - previous_value) / nullif(previous_value, 0)) * 100 > max_rel_delta) THEN 'anomaly'
            ELSE 'normal' END AS classification
    FROM w)"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(readings.event_points(spark, sf_dir), bounds(spark))


@query(f"WITH {CLASSIFIED} SELECT domain, classification, count(*) AS n FROM classified GROUP BY ALL")
def universal_classify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).groupBy("domain", "classification").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CLASSIFIED} SELECT series_id, sequence, value, previous_value, violated_constraint, constraint_value, classification, CASE WHEN classification = 'anomaly' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM classified")
def universal_classify_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("series_id", "sequence", "value", "previous_value", "violated_constraint", "constraint_value", "classification", "confidence")


@query(f"WITH {CLASSIFIED} SELECT series_id, sequence, value, upper(classification) AS severity, violated_constraint AS threshold_violated, true AS is_active FROM classified WHERE classification IN ('critical', 'warning')")
def universal_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _classified(spark, sf_dir).where(rules.should_alert(F.col("classification")))
    return c.select("series_id", "sequence", "value", rules.alert_severity(F.col("classification")).alias("severity"), F.col("violated_constraint").alias("threshold_violated"), F.lit(True).alias("is_active"))


@query(f"WITH {CLASSIFIED} SELECT domain, count(*) AS accepted, count(*) FILTER (WHERE classification IN ('critical', 'warning')) AS alerts, count(*) FILTER (WHERE classification = 'normal') AS published, 0::BIGINT AS rejected, max(sequence) AS acknowledged FROM classified GROUP BY domain")
def ingest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("classification")
    return _classified(spark, sf_dir).groupBy("domain").agg(
        F.count_if(rules.should_persist(k)).alias("accepted"), F.count_if(rules.should_alert(k)).alias("alerts"),
        F.count_if(rules.should_publish(k)).alias("published"), F.count_if(~rules.should_persist(k)).alias("rejected"), F.max("sequence").alias("acknowledged"),
    )


@query(f"""WITH {POINTS}, s AS (SELECT sequence, series_id || ':x:y' AS long FROM p)
    SELECT sequence, split_part(long, ':', 1) AS domain, split_part(long, ':', 2) AS source_id, substr(long, length(split_part(long, ':', 1)) + length(split_part(long, ':', 2)) + 3) AS stream_id,
        'iot:sensor_' || sequence || ':' || sequence AS iot_series, CAST(sequence AS BIGINT) AS sensor_id, false AS is_iot FROM s""")
def series_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = readings.event_points(spark, sf_dir).withColumn("long", F.concat("series_id", F.lit(":x:y")))
    iot = series.of_sensor(F.col("sequence"))
    return p.select("sequence", *(series.part(F.col("long"), k).alias(n) for k, n in ((1, "domain"), (2, "source_id"), (3, "stream_id"))), iot.alias("iot_series"), series.sensor_of(iot).alias("sensor_id"), series.is_iot(F.col("long")).alias("is_iot"))


@query(f"""WITH {POINTS} SELECT sequence, CASE WHEN sequence % 7 = 0 THEN 'rejected' ELSE 'universal' END AS target, CASE WHEN sequence % 7 = 0 THEN 'invalid_domain' END AS error FROM p""")
def domain_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = F.when(F.col("sequence") % 7 == 0, "IoT").otherwise(F.col("domain"))
    ok = guards.not_iot(domain)
    return readings.event_points(spark, sf_dir).select("sequence", F.when(ok, "universal").otherwise("rejected").alias("target"), F.when(~ok, "invalid_domain").alias("error"))


@query(f"""WITH {CLASSIFIED} SELECT series_id, domain, source_id, value, classification, 'http' AS transport, sha256('key-' || domain) AS api_key_hash, substr('key-' || domain, 1, 8) AS key_prefix, t, 'accepted' AS status FROM classified""")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.audit(_classified(spark, sf_dir), F.concat(F.lit("key-"), F.col("domain")), "http")


_WIDE = "SELECT event_id, ts, CASE WHEN event_id % 11 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS stamp, CASE WHEN event_id % 5 = 0 THEN 'x' ELSE CAST(event_id % 97 AS VARCHAR) END AS a, CAST(event_id % 13 AS VARCHAR) AS b FROM events"


@query(f"""WITH w AS ({_WIDE}), l AS (UNPIVOT w ON a, b INTO NAME col VALUE txt)
    SELECT 'plant:file1:m_' || col AS series_id, 'm_' || col AS stream_id, epoch_us(date_trunc('second', ts)) AS t, TRY_CAST(txt AS DOUBLE) AS value FROM l WHERE stamp <> 'bad' AND TRY_CAST(txt AS DOUBLE) IS NOT NULL""")
def csv_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    wide = readings.table(spark, sf_dir, "events").select(
        F.when(e % 11 == 0, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("at"),
        F.when(e % 5 == 0, "x").otherwise((e % 97).cast("string")).alias("a"), (e % 13).cast("string").alias("b"),
    )
    return readings.csv_points(wide, "at", ["a", "b"], "file1", "plant", "m_")


@query("""SELECT k.hash_of AS key_hash, d.domain, s.source_id,
        CASE k.role WHEN 'admin' THEN true WHEN 'source_writer' THEN k.source_id = s.source_id AND list_contains(k.domains, d.domain) ELSE false END AS allowed
    FROM (SELECT sha256(name) AS hash_of, role, source_id, domains FROM (VALUES ('ka', 'admin', NULL, CAST([] AS VARCHAR[])), ('kb', 'source_writer', '3', ['finance', 'health']), ('kc', 'source_writer', '4', CAST([] AS VARCHAR[])), ('kd', 'read_only', NULL, ['finance'])) x(name, role, source_id, domains)) k,
        (VALUES ('infrastructure'), ('finance'), ('health')) d(domain), (SELECT DISTINCT CAST(user_id AS VARCHAR) AS source_id FROM events) s""")
def authz_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [("ka", "admin", None, []), ("kb", "source_writer", "3", ["finance", "health"]), ("kc", "source_writer", "4", []), ("kd", "read_only", None, ["finance"])]
    asked = readings.event_points(spark, sf_dir).select("source_id").distinct().select("source_id", F.explode(F.array(*map(F.lit, ("infrastructure", "finance", "health")))).alias("domain"))
    given = F.array(*(F.struct(F.sha2(F.lit(name), 256).alias("h"), F.lit(role).alias("role"), F.lit(own).cast("string").alias("own"), F.array(*map(F.lit, domains)).cast("array<string>").alias("domains")) for name, role, own, domains in keys))
    from tidemark.functions.access import may_write

    each = asked.select("source_id", "domain", F.explode(given).alias("k"))
    return each.select(F.col("k.h").alias("key_hash"), "domain", "source_id", may_write(F.col("k.role"), F.col("k.own"), F.col("k.domains"), F.col("source_id"), F.col("domain")).alias("allowed"))


@query(f"""WITH d AS (SELECT s_suppkey, s_name, s_acctbal FROM supplier), a AS (SELECT DISTINCT user_id % 40 + 1 AS device FROM events)
    SELECT a.device, CASE WHEN d.s_suppkey IS NULL THEN 'DEVICE_NOT_FOUND' WHEN a.device % 6 = 0 THEN 'INVALID_API_KEY' WHEN a.device % 5 = 0 THEN 'KEY_INACTIVE' WHEN a.device % 7 = 0 THEN 'KEY_REVOKED' WHEN a.device % 4 = 0 THEN 'KEY_EXPIRED' END AS error
    FROM a LEFT JOIN d ON a.device = d.s_suppkey AND d.s_suppkey % 9 <> 0""")
def device_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.functions.access import device_key_error

    asked = readings.event_readings(spark, sf_dir).select((F.col("sensor_id") % 40 + 1).alias("device")).distinct()
    devices = readings.table(spark, sf_dir, "supplier").where("s_suppkey % 9 <> 0").select(F.col("s_suppkey").alias("device"), F.lit(True).alias("found"))
    d = F.col("device")
    keys = devices.where(d % 6 != 0).select(
        "device", F.lit(True).alias("key"), (d % 5 != 0).alias("active"), F.when(d % 7 == 0, F.lit(NOW)).alias("revoked_at"), F.when(d % 4 == 0, F.lit(NOW - 1)).otherwise(F.lit(NOW + 1)).alias("expires_at")
    )
    j = asked.join(devices, "device", "left").join(keys, "device", "left")
    error = device_key_error(F.coalesce("found", F.lit(False)), F.coalesce("key", F.lit(False)), F.col("active"), F.col("revoked_at"), F.col("expires_at"), F.lit(NOW))
    return j.select("device", error.alias("error"))


QUERIES, ORACLE_SQL = query.queries, query.sql
