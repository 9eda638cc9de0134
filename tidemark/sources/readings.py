"""Staging: packets, messages and files become rows of one schema.

Every function takes a DataFrame (of a batch or a stream) and gives one. Rejects keep their reason and go to dead letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import constants as K
from tidemark.functions import guards, series

READING = T.StructType([T.StructField("sensor_id", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("timestamp", T.TimestampType())])
BULK = T.StructType([T.StructField("readings", T.ArrayType(READING))])
PACKET = T.StructType([
    T.StructField("device_uuid", T.StringType()), T.StructField("ts", T.TimestampType()),
    T.StructField("readings", T.ArrayType(T.StructType([
        T.StructField("sensor_uuid", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("sensor_ts", T.DoubleType()), T.StructField("sequence", T.LongType()),
    ]))),
])
POINTS = T.StructType([
    T.StructField("source_id", T.StringType()), T.StructField("domain", T.StringType()),
    T.StructField("data_points", T.ArrayType(T.StructType([
        T.StructField("series_id", T.StringType()), T.StructField("stream_id", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("timestamp", T.TimestampType()),
        T.StructField("stream_type", T.StringType()), T.StructField("sequence", T.LongType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]))),
])
MESSAGE = T.StructType([
    T.StructField("v", T.IntegerType()), T.StructField("sensorId", T.StringType()), T.StructField("sensor_id", T.StringType()), T.StructField("value", T.DoubleType()),
    T.StructField("timestamp", T.StringType()), T.StructField("type", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("msgId", T.StringType()), T.StructField("msg_id", T.StringType()), T.StructField("_corrupt", T.StringType()),
])
#: Fixed: how event types stand for sensor types, and for domain, stream pairs.
SENSOR_TYPES = {"view": "temperature", "click": "humidity", "purchase": "power", "signup": "pressure", "error": "air_quality"}
STREAMS = {"view": ("infrastructure", "cpu"), "click": ("infrastructure", "memory"), "purchase": ("finance", "price"), "signup": ("health", "bpm"), "error": ("health", "spo2")}


def _mapped(c: Column, table: dict[str, str]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in table.items():
        out = out.when(c == k, v)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sensor_id, value, t, sequence, sensor_type, event_type, k): the events table as readings; t is in microseconds."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("sensor_id"), "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("sequence"),
        _mapped(F.col("event_type"), SENSOR_TYPES).alias("sensor_type"), "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, domain, source_id, stream_id, value, t, sequence): the events table as points of several domains."""
    r = event_readings(spark, sf_dir)
    domain, stream = (_mapped(F.col("event_type"), {k: v[i] for k, v in STREAMS.items()}) for i in (0, 1))
    source = F.col("sensor_id").cast("string")
    return r.select(series.build(domain, source, stream).alias("series_id"), domain.alias("domain"), source.alias("source_id"), stream.alias("stream_id"), "value", "t", "sequence")


def bulk(packets: DataFrame) -> DataFrame:
    """Rows (sensor_id, value, timestamp) of bulk packets; an empty list gives none."""
    return packets.select(F.inline("readings"))


def device_packets(packets: DataFrame, sensors: DataFrame, ingested: Column) -> DataFrame:
    """Rows of device packets with their sensor_id (null: not known) by both uuids, in lower case, so that a device can't speak for another's sensor.

    A reading's own time goes before the packet's. sensors: (device_uuid, sensor_uuid, sensor_id).
    """
    flat = packets.select(F.lower("device_uuid").alias("device_uuid"), "ts", F.explode("readings").alias("r"))
    flat = flat.select("device_uuid", F.lower("r.sensor_uuid").alias("sensor_uuid"), "r.value", F.coalesce(F.timestamp_micros((F.col("r.sensor_ts") * K.SECOND).cast("long")), "ts").alias("timestamp"), "r.sequence")
    known = sensors.select(F.lower("device_uuid").alias("device_uuid"), F.lower("sensor_uuid").alias("sensor_uuid"), "sensor_id")
    return flat.join(known, ["device_uuid", "sensor_uuid"], "left").withColumn("ingested_ts", ingested)


def points(packets: DataFrame) -> DataFrame:
    """Points of universal packets; error is set for points without a stream and for packets of domain iot."""
    flat = packets.select("domain", "source_id", F.explode("data_points").alias("p"))
    key = series.given_or_built(F.col("p.series_id"), F.col("domain"), F.col("source_id"), F.col("p.stream_id"))
    error = F.when(~guards.not_iot(F.col("domain")), "invalid_domain").when(key.isNull(), "missing_stream")
    return flat.select(key.alias("series_id"), "domain", "source_id", F.coalesce("p.stream_id", series.part(key, 3)).alias("stream_id"), "p.value", "p.timestamp", "p.sequence", "p.metadata", error.alias("error"))


def messages(raw: DataFrame, now: Column | int) -> DataFrame:
    """Messages (topic, payload) by the shape of their topic: four parts that end in data are universal points, the rest sensor readings.

    Text that isn't JSON has error parse_error; a payload that breaks a rule has validation_error and the reason.
    """
    parts = F.split("topic", "/")
    universal = (F.size(parts) == 4) & (F.get(parts, F.lit(3)) == "data")
    p = F.from_json("payload", MESSAGE, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    m = raw.withColumn("p", p).withColumn("universal", universal).withColumn("parts", parts)
    sensor = F.coalesce("p.sensorId", "p.sensor_id")
    micros = F.unix_micros(F.try_to_timestamp(F.regexp_replace("p.timestamp", "Z$", "+00:00")))
    bad = F.col("p").isNull() | F.col("p._corrupt").isNotNull()
    iot = F.lower(F.get("parts", F.lit(0))) == "iot"
    reason = F.when(bad, "NOT_JSON").when(F.col("universal"), F.when(iot, "INVALID_DOMAIN").when(F.col("p.value").isNull(), "VALUE_INVALID")).otherwise(guards.message_reason(F.coalesce("p.v", F.lit(1)), sensor, F.col("p.value"), micros, now))
    error = F.when(bad, "parse_error").when(F.col("universal") & iot, "invalid_domain").when(reason.isNotNull(), "validation_error")
    meta = lambda k: F.try_element_at("p.metadata", F.lit(k))
    stream = lambda k: F.get("parts", F.lit(k))
    return m.select(
        "topic", "payload", "universal", F.when(~F.col("universal"), F.trim(sensor).try_cast("long")).alias("sensor_id"),
        F.when(F.col("universal"), series.build(stream(0), stream(1), stream(2))).alias("series_id"),
        F.col("p.value").alias("value"), F.coalesce(micros, F.when(F.col("universal"), now if isinstance(now, Column) else F.lit(now))).alias("t"),
        meta("sequence").try_cast("long").alias("sequence"), F.coalesce(meta("sensorType"), F.lit("unknown")).alias("sensor_type"),
        F.coalesce("p.msgId", "p.msg_id").alias("msg_id"), error.alias("error"), reason.alias("reason"),
    )


def csv_points(rows: DataFrame, time_col: str, value_cols: list[str], source_id: str, domain: str, prefix: str = "") -> DataFrame:
    """Wide rows of text as long points: one stream per value column. Rows with an unreadable time and cells that aren't numbers are left out."""
    missing = [c for c in (time_col, *value_cols) if c not in rows.columns]
    if missing or not value_cols:
        raise ValueError(f"columns {missing} are missing" if missing else "value columns must be named")
    timed = rows.withColumn("t", F.unix_micros(F.try_to_timestamp(F.col(time_col)))).where("t is not null")
    numbers = timed.select("t", *(F.col(c).try_cast("double").alias(c) for c in value_cols))
    long = numbers.unpivot(["t"], value_cols, "column", "value").where("value is not null and not isnan(value)")
    return long.select(series.build(F.lit(domain), F.lit(source_id), F.concat(F.lit(prefix), "column")).alias("series_id"), F.concat(F.lit(prefix), "column").alias("stream_id"), "t", "value")


def unified(readings: DataFrame, source: str) -> DataFrame:
    """Readings of any channel as (sensor_id, value, t, sensor_type, sequence, msg_id, source); columns that a channel lacks are null."""
    has = lambda c, kind, other=None: (F.col(c) if c in readings.columns else F.lit(other)).cast(kind).alias(c)
    return readings.select(has("sensor_id", "long"), has("value", "double"), has("t", "long"), has("sensor_type", "string", "unknown"), has("sequence", "long"), has("msg_id", "string"), F.lit(source).alias("source"))


def dead_letters(rejects: DataFrame, payload: Column, error: Column, error_type: Column, source: str, at: Column) -> DataFrame:
    """Rejects as dead letters: payload and error are cut to their lengths, no retries yet."""
    return rejects.select(F.substring(payload, 1, K.DLQ_PAYLOAD).alias("payload"), F.substring(error, 1, K.DLQ_ERROR).alias("error"), error_type.alias("error_type"), F.lit(source).alias("source"), at.alias("timestamp"), F.lit(0).alias("retry_count"))
