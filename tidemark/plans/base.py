"""What the query modules share: the registry, dimension tables that are the same in Spark and in SQL, and base queries for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import constants as K

#: 2024-01-31 00:00:00 UTC, the time that queries take for now.
NOW = 1_706_659_200_000_000
#: Readings of one sensor are hours apart in the tables at hand, so intervals of minutes become hours.
HOUR = 3600
FRESH, COOLDOWN, THROTTLE, DEDUP, EVENT_GAP = 6 * HOUR, 12 * HOUR, 6 * HOUR, 24 * HOUR, 48 * HOUR


class Registry:
    """queries by name with the SQL that says the same for DuckDB."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str):
        def add(f):
            self.queries[f.__name__] = f
            self.sql[f.__name__] = sql
            return f

        return add


READINGS = """r AS (
    SELECT user_id AS sensor_id, value, epoch_us(ts) AS t, event_id AS sequence, event_type,
        CASE event_type WHEN 'view' THEN 'temperature' WHEN 'click' THEN 'humidity' WHEN 'purchase' THEN 'power' WHEN 'signup' THEN 'pressure' WHEN 'error' THEN 'air_quality' END AS sensor_type,
        CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
    FROM events)"""
POINTS = """p AS (
    SELECT *, domain || ':' || source_id || ':' || stream_id AS series_id FROM (
        SELECT CASE WHEN event_type IN ('view', 'click') THEN 'infrastructure' WHEN event_type = 'purchase' THEN 'finance' ELSE 'health' END AS domain,
            CAST(user_id AS VARCHAR) AS source_id,
            CASE event_type WHEN 'view' THEN 'cpu' WHEN 'click' THEN 'memory' WHEN 'purchase' THEN 'price' WHEN 'signup' THEN 'bpm' ELSE 'spo2' END AS stream_id,
            value, epoch_us(ts) AS t, event_id AS sequence FROM events))"""


def _sql_number(x: float | None) -> str:
    return "CAST(NULL AS DOUBLE)" if x is None else f"CAST({x!r} AS DOUBLE)"


BOUNDS_SQL = (
    f"bounds (domain, stream_id, {', '.join(K.BOUNDS)}) AS (VALUES " + ", ".join(f"('{d}', '{s}', {', '.join(map(_sql_number, v))})" for (d, s), v in K.STREAM_BOUNDS.items()) + ")"
)


def bounds(spark: SparkSession) -> DataFrame:
    kind = "domain string, stream_id string, " + ", ".join(f"{c} double" for c in K.BOUNDS)
    return spark.createDataFrame([(*k, *v) for k, v in K.STREAM_BOUNDS.items()], kind)


#: Three rules for each sensor: a warning band, a critical range and, for every fourth, a one-sided rule.
THRESHOLDS_SQL = """th AS (
    SELECT s * 10 + n AS id, s AS sensor_id,
        CASE n WHEN 1 THEN 'out_of_range' WHEN 2 THEN 'out_of_range' ELSE CASE WHEN s % 2 = 0 THEN 'greater_than' ELSE 'less_than' END END AS condition_type,
        CAST(CASE n WHEN 1 THEN 20 + s % 7 WHEN 2 THEN CASE WHEN s % 5 = 0 THEN NULL ELSE 5 END ELSE 150 END AS DOUBLE) AS low,
        CAST(CASE n WHEN 1 THEN 60 + s % 11 WHEN 2 THEN 120 + s % 13 ELSE 90 END AS DOUBLE) AS high,
        CASE n WHEN 1 THEN 'warning' WHEN 2 THEN 'critical' ELSE 'warning' END AS severity
    FROM (SELECT DISTINCT user_id AS s FROM events WHERE user_id > 0), (VALUES (1), (2), (3)) k(n)
    WHERE n < 3 OR s % 4 = 0)"""


def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per rule of each sensor: as many as there are sensors, times three."""
    s, n = F.col("s"), F.col("n")
    sensors = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id > 0").select(F.col("user_id").alias("s")).distinct()
    rows = sensors.select("s", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("n")).where((n < 3) | (s % 4 == 0))
    return rows.select(
        (s * 10 + n).alias("id"), s.alias("sensor_id"),
        F.when(n < 3, "out_of_range").when(s % 2 == 0, "greater_than").otherwise("less_than").alias("condition_type"),
        F.when(n == 1, 20 + s % 7).when(n == 2, F.when(s % 5 != 0, 5)).otherwise(150).cast("double").alias("low"),
        F.when(n == 1, 60 + s % 11).when(n == 2, 120 + s % 13).otherwise(90).cast("double").alias("high"),
        F.when(n == 2, "critical").otherwise("warning").alias("severity"),
    )


#: What a change must reach to be a spike.
SPIKES = {"abs_delta": 60.0, "rel_delta": 2.5, "abs_slope": 0.05, "rel_slope": None}
