"""Timing and quality statistics of a feed, in order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.operators import history


def timing_rows(rows: DataFrame, keys: list[str], arrival: list[str], sent: str, received: str, sequence: str) -> DataFrame:
    """rows with lag_ms, delta_ms (to the last time that is known), on_time and out_of_order (not above the last sequence that is known)."""
    w = history.before(keys, arrival)
    last_sent, last_sequence = (F.last(c, ignorenulls=True).over(w) for c in (sent, sequence))
    r = rows.withColumn("lag_ms", (F.col(received) - F.col(sent)) / 1000.0).withColumn("delta_ms", (F.col(sent) - last_sent) / 1000.0)
    r = r.withColumn("out_of_order", F.coalesce(F.col(sequence) <= last_sequence, F.lit(False)))
    return r.withColumn("on_time", F.abs(F.col("delta_ms") - K.EXPECTED_MS) <= K.TOLERANCE_MS)


def timing_stats(rows: DataFrame, keys: list[str], newest_first: list[Column], samples: int = K.TIMING_SAMPLES) -> DataFrame:
    """Per key over its newest samples: number, mean, least, largest and sample deviation of delta_ms, mean and largest lag, share out of order."""
    r = history.newest(rows, keys, newest_first, samples)
    d = "delta_ms"
    return r.groupBy(*keys).agg(
        F.count(d).alias("n"), F.avg(d).alias("avg_delta_ms"), F.min(d).alias("min_delta_ms"), F.max(d).alias("max_delta_ms"), F.when(F.count(d) > 1, F.stddev_samp(d)).alias("stdev_delta_ms"),
        F.avg("lag_ms").alias("avg_lag_ms"), F.max("lag_ms").alias("max_lag_ms"), F.count_if("out_of_order").alias("out_of_order"), F.count(F.lit(1)).alias("readings"),
    )


def verdict(max_lag: Column, out_of_order: Column, readings: Column) -> tuple[Column, Column]:
    """(verdict, reasons): WARN for a large lag, FAIL for a large share out of order, which goes before."""
    late = F.coalesce(max_lag > K.LAG_WARN_MS, F.lit(False))
    share = F.when(readings > 0, out_of_order / readings).otherwise(0.0)
    wrong = share > K.OUT_OF_ORDER_FAIL
    reasons = F.filter(F.array(F.when(late, "lag"), F.when(wrong, "out_of_order")), lambda x: x.isNotNull())
    return F.when(wrong, "FAIL").when(late, "WARN").otherwise("OK"), reasons


def success_rate(processed: Column, failed: Column) -> Column:
    return F.coalesce(F.try_divide(processed.cast("double"), (processed + failed).cast("double")), F.lit(1.0))
