"""What came before: windows over the rows of a key. They share one partitioning and order, so one exchange and sort serve them all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.operators import ranges


def by(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def before(keys: list[str], order: list[str]) -> WindowSpec:
    return by(keys, order).rowsBetween(Window.unboundedPreceding, -1)


def upto(keys: list[str], order: list[str]) -> WindowSpec:
    return by(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def last_where(value: Column, where: Column, w: WindowSpec) -> Column:
    """The value of the last row before for which `where` holds."""
    return F.last(F.when(where, value), ignorenulls=True).over(w)


def consecutive(rows: DataFrame, keys: list[str], order: list[str], hit: Column, name: str = "consecutive", counts: Column | None = None) -> DataFrame:
    """rows with the number of hits in a row up to each; 0 where there is none. Rows that don't count neither add to a run nor end it."""
    counts = F.lit(True) if counts is None else F.coalesce(counts, F.lit(False))
    marked = rows.withColumn("_counts", counts).withColumn("_hit", F.col("_counts") & F.coalesce(hit, F.lit(False)))
    marked = marked.withColumn("_island", F.sum(F.when(F.col("_counts") & ~F.col("_hit"), 1).otherwise(0)).over(upto(keys, order)))
    count = F.sum(F.col("_hit").cast("int")).over(upto([*keys, "_island"], order))
    return marked.withColumn(name, F.when(F.col("_hit"), count).otherwise(0).cast("long")).drop("_counts", "_island", "_hit")


def newest(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """Of each key the first n rows in order, with their place from 1; ranks are cut before the exchange too."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def rate_limited(rows: DataFrame, keys: list[str], time_col: str, order: list[str], limit: int, window_seconds: int = K.RATE_WINDOW_SECONDS, counts: Column | None = None) -> DataFrame:
    """rows with approx (calls in a sliding window, by the share of the bucket before that still counts) and allowed.

    Calls are counted by key and bucket before any exchange and joined to the bucket after; the running number is one of a key
    and bucket. So a key with many calls is spread over tasks by its buckets. Rows for which counts isn't true aren't calls:
    they have neither.
    """
    width = window_seconds * K.SECOND
    bucket = F.floor(F.col(time_col) / F.lit(width)).cast("long")
    r = rows.withColumn("_call", F.lit(1) if counts is None else F.when(counts, 1)).withColumn("_bucket", bucket)
    # of the bucket directly before, all calls count, allowed or not
    held = r.where("_call = 1").groupBy(*(F.col(k).alias(f"_of_{k}") for k in keys), (F.col("_bucket") + 1).alias("_next")).agg(F.count(F.lit(1)).alias("_previous"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys))
    r = r.withColumn("_n", F.sum("_call").over(upto([*keys, "_bucket"], order))).join(held, same & (F.col("_bucket") == F.col("_next")), "left")
    weight = 1 - (F.col(time_col) - F.col("_bucket") * width) / float(width)
    approx = F.when(F.col("_call") == 1, (F.floor(F.coalesce("_previous", F.lit(0)) * weight) + F.col("_n")).cast("long"))
    return r.select(*rows.columns, approx.alias("approx"), (approx <= limit).alias("allowed"))


def as_of_forward(events: DataFrame, readings: DataFrame, key: str, at: str, time_col: str, value_col: str, name: str = "actual", ties: str | None = None, most_rows: int | None = None, parts: int | None = None) -> DataFrame:
    """events with the first non-null value strictly after their time: both sides share one pass from the newest row to the oldest, there is no range join.

    A value is the last seen before an event in that order. Of readings at one time that with the smallest `ties` is taken. Keys
    of more than most_rows rows are dealt out over several tasks by ranges of time, with the value at each border carried over.
    """
    extra = [c for c in events.columns if c not in (key, at)]
    none = F.lit(None)
    left = events.select(key, F.col(at).alias("_t"), none.cast("double").alias("_v"), F.lit(1).alias("_side"), none.cast("long").alias("_tie"), F.struct(*extra).alias("_e"))
    tie = F.col(ties).cast("long") if ties else none.cast("long")
    right = readings.where(F.col(value_col).isNotNull()).select(key, F.col(time_col).alias("_t"), F.col(value_col).cast("double").alias("_v"), F.lit(0).alias("_side"), tie.alias("_tie"), none.cast(left.schema["_e"].dataType).alias("_e"))
    # events come before the readings of their time, so what they have seen is strictly later
    order = [F.desc("_t"), F.desc("_side"), F.desc("_tie"), F.desc("_v")]
    seen = F.last("_v", ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    found = ranges.by_size(
        left.unionByName(right), [key], lambda r: r.withColumn("_next", seen),
        lambda r: ranges.scanned(r, [key], order, ranges.Newest("_v"), "_next", "double", parts), most_rows,
    )
    return found.where("_side = 1").select(key, F.col("_t").alias(at), *(F.col(f"_e.{c}").alias(c) for c in extra), F.col("_next").alias(name))
