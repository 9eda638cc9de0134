"""Events by class: which readings are alerts, warnings or clean, and the tables that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.functions import guards, rules
from tidemark.operators import folds, history

KEYS, ORDER = ["sensor_id"], ["t", "sequence"]


def noise(type_: Column, place: int) -> Column:
    return guards.by_type(type_, K.NOISE_FLOORS, place, K.NOISE_FLOORS["default"][place])


def with_previous(rows: DataFrame, violates: Column, fresh_seconds: float) -> DataFrame:
    """rows with previous_value and previous_t: what the newest-value table would hold when a row comes.

    That is the last value that doesn't break the sensor's range, with the time at which its run of equal values began; null
    if that is more than fresh_seconds ago.
    """
    w = history.before(KEYS, ORDER)
    ok = ~violates
    r = rows.withColumn("_ok", ok).withColumn("_pv", history.last_where(F.col("value"), F.col("_ok"), w))
    begins = F.col("_ok") & ~F.col("_pv").eqNullSafe(F.col("value"))
    r = r.withColumn("_begins", begins).withColumn("_pt", history.last_where(F.col("t"), F.col("_begins"), w))
    fresh = F.coalesce(F.col("t") - F.col("_pt") <= F.lit(int(fresh_seconds * K.SECOND)), F.lit(False))
    return r.withColumn("previous_value", F.when(fresh, F.col("_pv"))).withColumn("previous_t", F.when(fresh, F.col("_pt"))).drop("_ok", "_pv", "_begins", "_pt")


def with_spike(rows: DataFrame, thresholds: dict[str, float | None], typed: bool = True) -> DataFrame:
    """rows with triggered: the thresholds that the change from the previous value reaches. typed: noise floors by sensor type and slopes always."""
    limits = {k: F.lit(v).cast("double") for k, v in thresholds.items()}
    if typed:
        floor, least = (noise(F.col("sensor_type"), 0), noise(F.col("sensor_type"), 1)), 0.0
    else:
        floor, least = tuple(F.lit(x) for x in K.GENERIC_NOISE), K.LEAST_SLOPE_SECONDS
    return rows.withColumn("triggered", rules.spike(F.col("value"), F.col("t"), F.col("previous_value"), F.col("previous_t"), limits, *floor, least))


def iot_classified(rows: DataFrame, ranges: DataFrame, spikes: dict[str, float | None], fresh_seconds: float = K.FRESH_SECONDS, cooldown_seconds: float = K.COOLDOWN_SECONDS, warm_up: int = K.WARM_UP_READINGS, required: int = K.CONSECUTIVE, takes_part: Column | None = None) -> DataFrame:
    """rows with class (ALERT, WARNING or ML_PREDICTION) and reason.

    In order: invalid values; sensors that warm up; values out of range, of which the required number in a row makes an
    alert; values in the warning band; spikes, unless one was reported within the cooldown; all else is clean.
    ranges: (sensor_id, low, high, warning_min, warning_max), one row per sensor. Rows for which takes_part isn't true are
    invalid and leave no trace in the history of their sensor.
    """
    r = _judged(rows, ranges, spikes, fresh_seconds, cooldown_seconds, warm_up, required, takes_part)
    return r.select(*rows.columns, "previous_value", "triggered", _kind(F.col("reason")).alias("class"), "reason")


def _kind(reason: Column) -> Column:
    return F.when(reason == "out_of_range", "ALERT").when(reason == "spike", "WARNING").otherwise("ML_PREDICTION")


def _judged(rows: DataFrame, ranges: DataFrame, spikes: dict[str, float | None], fresh_seconds: float, cooldown_seconds: float, warm_up: int, required: int, takes_part: Column | None) -> DataFrame:
    """rows with reason, and what it was found by: _good, _open, _out, consecutive, previous values, triggered."""
    r = rows.join(ranges, "sensor_id", "left")
    good = ~(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf")))
    good = good if takes_part is None else good & F.coalesce(takes_part, F.lit(False))
    r = r.withColumn("_good", good).withColumn("_n", F.sum(F.col("_good").cast("int")).over(history.upto(KEYS, ORDER)))
    r = r.withColumn("_open", F.col("_good") & (F.col("_n") >= warm_up))
    r = r.withColumn("_out", guards.below_or_above(F.col("value"), F.col("low"), F.col("high")))
    # rows that are invalid or blocked don't touch the count of violations
    r = history.consecutive(r, KEYS, ORDER, F.col("_out"), counts=F.col("_open"))
    r = with_spike(with_previous(r, F.col("_out") | ~F.col("_good"), fresh_seconds), spikes)
    band = rules.within_band(F.col("value"), F.col("warning_min"), F.col("warning_max"))
    r = r.withColumn("_spike", F.col("_open") & ~F.col("_out") & ~F.coalesce(band, F.lit(False)) & (F.coalesce(F.size("triggered"), F.lit(0)) > 0))
    r = folds.spaced(r, KEYS, "t", cooldown_seconds, ORDER, "_told", only="_spike", split=False)
    why = (
        F.when(~F.col("_good"), "invalid").when(~F.col("_open"), "warming_up")
        .when(F.col("_out"), F.when(F.col("consecutive") >= required, "out_of_range").otherwise("out_of_range_pending"))
        .when(F.coalesce(band, F.lit(False)), "warning_band").when(F.col("_told"), "spike").when(F.col("_spike"), "spike_cooldown").otherwise("clean")
    )
    return r.withColumn("reason", why)


def left_behind(rows: DataFrame, ranges: DataFrame, spikes: dict[str, float | None], fresh_seconds: float = K.FRESH_SECONDS, cooldown_seconds: float = K.COOLDOWN_SECONDS, warm_up: int = K.WARM_UP_READINGS, required: int = K.CONSECUTIVE, takes_part: Column | None = None) -> DataFrame:
    """(sensor_id, n, run, value, since, told): the state of each sensor's path after rows, for a stream to begin with.

    Readings that count, violations in a row, the newest value within bounds and when it began to stand, the last reported spike.
    """
    r = _judged(rows, ranges, spikes, fresh_seconds, cooldown_seconds, warm_up, required, takes_part)
    ok, order = F.col("_good") & ~F.col("_out"), F.struct(*ORDER)
    begins = ok & ~history.last_where(F.col("value"), ok, history.before(KEYS, ORDER)).eqNullSafe(F.col("value"))
    r = r.where("_good").withColumn("_begins", begins)
    last = lambda c, where: F.max_by(c, F.when(where, order))
    return r.groupBy("sensor_id").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(last("consecutive", F.col("_open")), F.lit(0)).alias("run"), last("value", ok).alias("value"),
        F.max(F.when(F.col("_begins"), F.col("t"))).alias("since"), F.max(F.when(F.col("reason") == "spike", F.col("t"))).alias("told"),
    )


def consequences(told: DataFrame) -> DataFrame:
    """(…, outcome, reason) with class, suspicious and what is done with each row; only routed rows have a class."""
    routed = F.col("outcome") == "routed"
    r = told.withColumn("class", F.when(routed, _kind(F.col("reason")))).withColumn("suspicious", routed & guards.suspicious_zero(F.col("value"), F.lit(None).cast("string")))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return r.withColumns({"persist_reading": yes(rules.persists_reading(F.col("class"))), "update_latest": F.col("class").isNotNull(), "to_learning": yes(rules.goes_to_learning(F.col("class")))})


def active_alerts(violations: DataFrame) -> DataFrame:
    """One active alert per sensor: it keeps the id and start of its first violation and takes the values of its last."""
    first, last = F.min_by("sequence", F.struct(*ORDER)), F.max(F.struct(*ORDER, "value", "threshold_id"))
    a = violations.groupBy("sensor_id").agg(first.alias("alert_id"), last.alias("x"), F.count(F.lit(1)).alias("updates"))
    return a.select("sensor_id", "alert_id", F.col("x.threshold_id").alias("threshold_id"), F.col("x.value").alias("triggered_value"), F.col("x.t").alias("triggered_t"), F.lit("critical").alias("severity"), F.lit("active").alias("status"), "updates")
