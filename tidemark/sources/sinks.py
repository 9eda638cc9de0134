"""Tables that the pipelines leave: appends, newest values, current state by derivation, bounded tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import constants as K


def append(rows: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    """Appends to a Parquet table, in folders of the named columns (domain, date)."""
    w = rows.write.mode("append")
    (w.partitionBy(*partitions) if partitions else w).parquet(path)


def latest(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Of each key the columns of its newest row: partial aggregates before the exchange, no sort."""
    newest = F.max_by(F.struct(*columns), F.struct(*order)).alias("x")
    return rows.groupBy(*keys).agg(newest).select(*keys, "x.*")


def upserted(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """current with the rows of changes in place of, or besides, its own: what MERGE does, as a derivation. changes holds a key once."""
    return current.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def absent(current: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of wanted whose key current lacks (insert if absent)."""
    return wanted.join(current.select(*keys).distinct(), keys, "left_anti")


def tail(rows: DataFrame, order: list[Column], n: int = K.DLQ_LENGTH) -> DataFrame:
    """The first n rows in order: a bounded stream keeps its newest."""
    return rows.orderBy(*order).limit(n)


def audit(points: DataFrame, key: Column, transport: str) -> DataFrame:
    """Audit rows; of the key only its hash and its first eight letters are kept."""
    return points.select("series_id", "domain", "source_id", "value", "classification", F.lit(transport).alias("transport"), F.sha2(key, 256).alias("api_key_hash"), F.substring(key, 1, 8).alias("key_prefix"), F.col("t"), F.lit("accepted").alias("status"))
