"""Series keys, message ids and lifecycle states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def build(domain: Column, source: Column, stream: Column) -> Column:
    return F.concat_ws(":", domain, source, stream)


def part(series_id: Column, k: int) -> Column:
    """Part k (1 to 3) of a key; the third keeps further colons; null if the key is too short."""
    return F.try_element_at(F.split(series_id, ":", 3), F.lit(k))


def of_sensor(sensor_id: Column) -> Column:
    return F.concat(F.lit("iot:sensor_"), sensor_id.cast("string"), F.lit(":"), sensor_id.cast("string"))


def sensor_of(series_id: Column) -> Column:
    """The sensor of an iot series, null for others."""
    return F.when(is_iot(series_id), F.coalesce(part(series_id, 3).try_cast("long"), F.regexp_extract(part(series_id, 2), r"^sensor_(\d+)$", 1).try_cast("long")))


def is_iot(series_id: Column) -> Column:
    return F.coalesce(F.lower(part(series_id, 1)) == "iot", F.lit(False))


def given_or_built(series_id: Column, domain: Column, source: Column, stream: Column) -> Column:
    """A key that is given wins; else it's built; null without a stream."""
    return F.when(F.coalesce(series_id, F.lit("")) != "", series_id).when(F.coalesce(stream, F.lit("")) != "", build(domain, source, stream))


def message_id(given: Column, sensor_id: Column, epoch_seconds: Column, value: Column) -> Column:
    """A given id, else sensor, time and value with six decimals. Prefer to deduplicate on the typed columns: engines round texts differently."""
    return F.coalesce(given, F.concat_ws(":", sensor_id.cast("string"), F.format_string("%.6f", epoch_seconds), F.format_string("%.6f", value)))


def lifecycle(rejected: Column, failed: Column, class_: Column, persisted: Column) -> Column:
    return F.when(rejected, "rejected").when(failed, "failed").when(persisted, "persisted").when(class_.isNotNull(), "classified").otherwise("pending")


def client_ip(forwarded: Column, real: Column, peer: Column) -> Column:
    """The first of X-Forwarded-For, else X-Real-IP, else the peer's address."""
    first = F.trim(F.get(F.split(forwarded, ","), F.lit(0)))
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(F.trim(real), F.lit("")), peer)


def processed_at(status: Column, at: Column) -> Column:
    """When a point was done with: set as it is persisted, rejected or failed."""
    return F.when(status.isin("persisted", "rejected", "failed"), at)
