"""Guards: why a reading is turned away, as column expressions. NaN is tested first, for Spark orders it above all numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import constants as K


def by_type(type_: Column, table: dict[str, tuple[float, float]], place: int, other: float | None = None) -> Column:
    """A number by sensor type; types that the table lacks get `other` or null."""
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for name, pair in table.items():
        out = out.when(type_ == name, F.lit(pair[place]))
    return out if other is None else out.otherwise(F.lit(other))


def below_or_above(value: Column, low: Column, high: Column) -> Column:
    """Strictly outside of bounds, of which a null one doesn't bind; false for NaN."""
    return ~F.isnan(value) & (F.coalesce(value < low, F.lit(False)) | F.coalesce(value > high, F.lit(False)))


def sensor_reason(sensor_id: Column) -> Column:
    return F.when(sensor_id.isNull(), "SENSOR_ID_NULL").when(sensor_id <= 0, "SENSOR_ID_INVALID")


def value_reason(value: Column, type_: Column | None = None) -> Column:
    """VALUE_NULL, VALUE_NAN, VALUE_INFINITE, or outside of its type's limits; null if nothing is wrong. Types compare in lower case."""
    out = F.when(value.isNull(), "VALUE_NULL").when(F.isnan(value), "VALUE_NAN").when(F.abs(value) == float("inf"), "VALUE_INFINITE")
    if type_ is None:
        return out
    kind = F.lower(type_)
    return out.when(value < by_type(kind, K.GUARD_LIMITS, 0), "VALUE_BELOW_LIMIT").when(value > by_type(kind, K.GUARD_LIMITS, 1), "VALUE_ABOVE_LIMIT")


def time_reason(micros: Column, now: Column | int, future: int = K.FUTURE_SECONDS, past: int = K.PAST_SECONDS) -> Column:
    """Times, as microseconds, more than `future` seconds ahead of now or `past` behind it; a null time is accepted."""
    now = F.lit(now) if isinstance(now, int) else now
    return F.when(micros > now + future * K.SECOND, "TIMESTAMP_FUTURE").when(micros < now - past * K.SECOND, "TIMESTAMP_TOO_OLD")


def reading_reason(sensor_id: Column, value: Column, micros: Column, now: Column | int, type_: Column | None = None) -> Column:
    """The first reason of sensor, value and time; null for a good reading."""
    return F.coalesce(sensor_reason(sensor_id), value_reason(value, type_), time_reason(micros, now))


def message_reason(version: Column, sensor: Column, value: Column, micros: Column, now: Column | int) -> Column:
    """For messages: version 1 to 10, a sensor id of digits, a finite value within limits, a time that can be read and isn't far."""
    return F.coalesce(
        F.when(F.coalesce(version, F.lit(0)).between(1, 10), None).otherwise("VERSION_INVALID"),
        F.when(F.trim(F.coalesce(sensor, F.lit(""))) == "", "SENSOR_ID_BLANK").when(F.trim(sensor).try_cast("long").isNull(), "SENSOR_ID_NOT_NUMERIC"),
        F.when(value.isNull(), "VALUE_INVALID").when(F.isnan(value) | (F.abs(value) >= K.MESSAGE_VALUE_LIMIT), "VALUE_OUT_OF_BOUNDS"),
        F.when(micros.isNull(), "TIMESTAMP_INVALID"),
        time_reason(micros, now, past=K.MESSAGE_PAST_SECONDS),
    )


def suspicious_zero(value: Column, type_: Column, tolerance: float = K.ZERO_TOLERANCE) -> Column:
    kind = F.lower(F.trim(type_))
    return F.coalesce((F.abs(value) <= tolerance) & (type_.isNull() | kind.isin(*K.SUSPICIOUS_ZERO_TYPES)), F.lit(False))


def out_of_message_range(value: Column, type_: Column) -> Column:
    low, high = (by_type(type_, K.MESSAGE_RANGES, k, K.MESSAGE_RANGES["unknown"][k]) for k in (0, 1))
    return below_or_above(value, low, high)


def not_iot(domain: Column) -> Column:
    return F.coalesce(F.lower(domain) != "iot", F.lit(False))


def contract_error(sensor_id: Column, value: Column, timestamp: Column) -> Column:
    """What a reading (texts) lacks to keep the domain's contract; null if it keeps it."""
    missing = [F.when(c.isNull(), f"Missing required field: {name}") for name, c in (("sensor_id", sensor_id), ("value", value), ("timestamp", timestamp))]
    return F.coalesce(*missing, F.when(sensor_id.try_cast("long").isNull(), "sensor_id must be an integer"), F.when(value.try_cast("double").isNull(), "value must be a number"))
