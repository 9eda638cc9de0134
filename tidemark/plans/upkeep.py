"""Upkeep of reference tables: configuration lookups, models, explanations, last contacts, run summaries, channel-neutral rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.functions import guards, rules, series
from tidemark.operators import metrics
from tidemark.plans.base import READINGS, Registry
from tidemark.sources import readings, sinks

query = Registry()


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.event_readings(spark, sf_dir)


def with_config(points: DataFrame, configs: DataFrame, constraints: DataFrame, defaults: DataFrame) -> DataFrame:
    """points with the constraint of their own stream, else of their domain's default; origin says which.

    configs: (config_id, domain, source_id, stream_id); constraints: (config_id, critical_max), one to one; defaults:
    (domain, default_max).
    """
    exact = configs.join(constraints, "config_id", "left")
    j = points.join(exact, ["domain", "source_id", "stream_id"], "left").join(defaults, "domain", "left")
    origin = F.when(F.col("critical_max").isNotNull(), "stream").when(F.col("default_max").isNotNull(), "domain").otherwise("none")
    return j.select(*points.columns, F.coalesce("critical_max", "default_max").alias("limit"), origin.alias("origin"))


_POINTS = """p AS (SELECT event_id AS sequence, CASE WHEN event_type IN ('view', 'click') THEN 'infrastructure' WHEN event_type = 'purchase' THEN 'finance' ELSE 'health' END AS domain, CAST(user_id AS VARCHAR) AS source_id,
    CASE event_type WHEN 'view' THEN 'cpu' WHEN 'click' THEN 'memory' WHEN 'purchase' THEN 'price' WHEN 'signup' THEN 'bpm' ELSE 'spo2' END AS stream_id, value FROM events)"""


@query(f"""WITH {_POINTS}, c AS (SELECT DISTINCT domain, source_id, stream_id, CAST(source_id AS BIGINT) AS config_id FROM p WHERE CAST(source_id AS BIGINT) % 2 = 0 AND stream_id IN ('cpu', 'price'))
    SELECT sequence, CASE WHEN c.config_id % 3 <> 0 THEN 90.0 + c.config_id ELSE CASE p.domain WHEN 'infrastructure' THEN 95.0 WHEN 'health' THEN 200.0 END END AS "limit",
        CASE WHEN c.config_id % 3 <> 0 THEN 'stream' WHEN p.domain <> 'finance' THEN 'domain' ELSE 'none' END AS origin FROM p LEFT JOIN c USING (domain, source_id, stream_id)""")
def stream_config_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = readings.event_points(spark, sf_dir).select("sequence", "domain", "source_id", "stream_id")
    configs = p.where((F.col("source_id").cast("long") % 2 == 0) & F.col("stream_id").isin("cpu", "price")).select(F.col("source_id").cast("long").alias("config_id"), "domain", "source_id", "stream_id").distinct()
    constraints = configs.where("config_id % 3 <> 0").select("config_id", (F.lit(90.0) + F.col("config_id")).alias("critical_max")).distinct()
    defaults = spark.createDataFrame([("infrastructure", 95.0), ("health", 200.0)], "domain string, default_max double")
    return with_config(p, configs, constraints, defaults).select("sequence", "limit", "origin")


@query(f"""WITH {READINGS}, m AS (SELECT sensor_id, sequence AS id, t AS trained_t, k % 2 = 0 AS is_active FROM r WHERE k < 30), a AS (SELECT sensor_id, arg_max(id, (trained_t, id)) AS model_id FROM m WHERE is_active GROUP BY sensor_id)
    SELECT DISTINCT r.sensor_id, coalesce(model_id, -r.sensor_id) AS model_id, model_id IS NULL AS created FROM r LEFT JOIN a USING (sensor_id)""")
def active_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest active model of each sensor; sensors without one get a new one (here with the sensor's negative number)."""
    r = _readings(spark, sf_dir)
    models = r.where("k < 30 and k % 2 = 0").select("sensor_id", F.col("sequence").alias("model_id"), F.col("t").alias("trained_t"))
    have = sinks.latest(models, ["sensor_id"], ["trained_t", "model_id"], ["model_id"]).withColumn("created", F.lit(False))
    every = r.select("sensor_id").distinct().select("sensor_id", (-F.col("sensor_id")).alias("model_id"), F.lit(True).alias("created"))
    return have.unionByName(sinks.absent(have, every, ["sensor_id"]))


@query(f"WITH {READINGS} SELECT sequence AS id, CASE WHEN k % 4 = 0 THEN 'explained ' || sequence WHEN k % 3 = 0 THEN 'known' END AS explanation FROM r")
def explanations_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _readings(spark, sf_dir)
    old = r.select(F.col("sequence").alias("id"), F.when(F.col("k") % 3 == 0, "known").alias("before"))
    new = r.where("k % 4 = 0").select(F.col("sequence").alias("id"), F.concat(F.lit("explained "), F.col("sequence").cast("string")).alias("after"))
    return old.join(new, "id", "left").select("id", F.coalesce("after", "before").alias("explanation"))


@query(f"WITH {READINGS} SELECT sensor_id % 10 + 1 AS device_id, max(t) AS last_seen_t, 'online' AS status, count(DISTINCT sensor_id) AS sensors FROM r GROUP BY ALL")
def devices_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _readings(spark, sf_dir).groupBy((F.col("sensor_id") % 10 + 1).alias("device_id")).agg(F.max("t").alias("last_seen_t"), F.lit("online").alias("status"), F.count_distinct("sensor_id").alias("sensors"))


@query(f"WITH {READINGS} SELECT sensor_id, count(*) FILTER (WHERE event_type = 'error' AND k % 2 = 0) AS active_events, CASE WHEN count(*) FILTER (WHERE event_type = 'error' AND k % 2 = 0) > 0 THEN 'WARNING' ELSE 'NORMAL' END AS state FROM r GROUP BY sensor_id")
def active_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active events of each sensor and the state that agrees with them."""
    n = F.count_if((F.col("event_type") == "error") & (F.col("k") % 2 == 0))
    return _readings(spark, sf_dir).groupBy("sensor_id").agg(n.alias("active_events")).withColumn("state", F.when(F.col("active_events") > 0, "WARNING").otherwise("NORMAL"))


@query(f"""WITH {READINGS}, s AS (SELECT sensor_id, count(*) AS n, count(*) FILTER (WHERE k < 50) AS ok FROM r GROUP BY sensor_id)
    SELECT CASE WHEN n < 2 THEN 'none' WHEN sensor_id % 4 = 0 THEN 'enterprise' ELSE 'baseline' END AS engine, count(*) AS sensors, sum(ok)::BIGINT AS processed, sum(n - ok)::BIGINT AS failed, CASE WHEN sum(n) = 0 THEN 1.0 ELSE sum(ok)::DOUBLE / sum(n) END AS success_rate FROM s GROUP BY ALL""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _readings(spark, sf_dir).groupBy("sensor_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") < 50).alias("ok"))
    engine = F.when(F.col("n") < 2, "none").when(F.col("sensor_id") % 4 == 0, "enterprise").otherwise("baseline")
    out = s.groupBy(engine.alias("engine")).agg(F.count(F.lit(1)).alias("sensors"), F.sum("ok").alias("processed"), F.sum(F.col("n") - F.col("ok")).alias("failed"))
    return out.withColumn("success_rate", metrics.success_rate(F.col("processed"), F.col("failed")))


@query(f"""WITH {READINGS} SELECT CASE WHEN k < 40 THEN 'mqtt' WHEN k < 80 THEN 'http' ELSE 'csv' END AS source, count(*) AS n, count(*) FILTER (WHERE k < 40) AS typed, min(t) AS first_t, max(sequence) FILTER (WHERE k < 80) AS last_sequence FROM r GROUP BY ALL""")
def unified_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three channels with columns of their own, brought to one schema and put together."""
    r = _readings(spark, sf_dir)
    parts = (("mqtt", r.where("k < 40").drop("k", "event_type")), ("http", r.where("k >= 40 and k < 80").select("sensor_id", "value", "t", "sequence")), ("csv", r.where("k >= 80").select("sensor_id", "value", "t")))
    one = None
    for name, rows in parts:
        u = readings.unified(rows, name)
        one = u if one is None else one.unionByName(u)
    return one.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sensor_type") != "unknown").alias("typed"), F.min("t").alias("first_t"), F.max("sequence").alias("last_sequence"))


@query(f"""WITH {READINGS} SELECT sequence, 'iot:sensor_' || sensor_id || ':' || sensor_id AS series_id, value, t / 1000000.0::DOUBLE AS epoch_seconds, sensor_type AS stream_type, sensor_id FROM r""")
def ml_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as points for the learning side, and back: the sensor is read from the series key."""
    p = _readings(spark, sf_dir).select("sequence", series.of_sensor(F.col("sensor_id")).alias("series_id"), "value", (F.col("t") / 1e6).alias("epoch_seconds"), F.col("sensor_type").alias("stream_type"))
    return p.withColumn("sensor_id", series.sensor_of(F.col("series_id")))


@query(f"""WITH {READINGS} SELECT sequence, CASE WHEN k % 9 = 0 THEN 'VERSION_INVALID' WHEN k % 9 = 1 THEN 'FIELD_MISSING' WHEN k % 9 = 2 THEN 'NOT_CASTABLE' WHEN value < CASE sensor_type WHEN 'temperature' THEN -50 WHEN 'humidity' THEN 0 WHEN 'pressure' THEN 800 ELSE -1e9 END
        OR value > CASE sensor_type WHEN 'temperature' THEN 100 WHEN 'humidity' THEN 100 WHEN 'pressure' THEN 1200 ELSE 1e9 END THEN 'OUT_OF_RANGE' END AS reason FROM r""")
def modular_payload_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stricter message path: version 1 only, all fields there and castable, value in the narrow range of its type."""
    k = F.col("k") % 9
    m = _readings(spark, sf_dir).select("sequence", "sensor_type", F.when(k == 0, 2).otherwise(1).alias("v"), F.when(k != 1, F.col("sensor_id").cast("string")).alias("sensor"), F.when(k == 2, "x").otherwise(F.col("value").cast("string")).alias("text"))
    value = F.col("text").try_cast("double")
    reason = F.when(F.col("v") != 1, "VERSION_INVALID").when(F.col("sensor").isNull() | F.col("text").isNull(), "FIELD_MISSING").when(F.col("sensor").try_cast("long").isNull() | value.isNull(), "NOT_CASTABLE")
    return m.select("sequence", F.when(reason.isNotNull(), reason).when(guards.out_of_message_range(value, F.col("sensor_type")), "OUT_OF_RANGE").alias("reason"))


@query(f"""WITH {READINGS} SELECT DISTINCT k % 8 AS attempt, least(1.0::DOUBLE * power(2.0::DOUBLE, k % 8), 30.0::DOUBLE) AS wait_seconds, CASE WHEN k % 8 >= {K.DLQ_RETRIES} THEN 'archived' ELSE 'requeued' END AS fate FROM r""")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _readings(spark, sf_dir).select((F.col("k") % 8).alias("attempt")).distinct()
    return a.select("attempt", rules.backoff_seconds(F.col("attempt")).alias("wait_seconds"), rules.dead_letter_fate(F.lit(False), F.col("attempt"), F.lit(0)).alias("fate"))


QUERIES, ORACLE_SQL = query.queries, query.sql
