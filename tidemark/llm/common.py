"""What the operators share: tables, the hold-out rule, lineage cuts in the shared folder, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch's slice, if it has several rows.
SLICE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column) -> Column:
    """True where crc32 of the id as text leaves no remainder by 5; null ids count as held out, so nothing learns from them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0, F.lit(True))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Only local masters may do without it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir isn't set; on a cluster it must name a folder that all machines share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder name of its own below the shared one."""
    return f"{shared_root(spark).rstrip('/')}/tidemark/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, which outlives executors."""
    shared_root(df.sparkSession)
    return df.checkpoint()


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Actions on DataFrames made in here remove their shuffle files when they end; else these stay until the driver happens to collect its garbage.

    For steps that are cut. A DataFrame made in here that runs again shuffles again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def in_slices(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of batches in order, in slices of at most `most` bytes or of one row.

    Spark's batches are bounded by rows. What a worker makes of a batch of long texts stays with it as long as it lives,
    beside what the executor's heap needs in later stages; so it makes it slice by slice. Empty batches stay.
    """
    for b in batches:
        todo = [b]
        while todo:
            b = todo.pop()
            if b.nbytes <= most or b.num_rows < 2:
                yield b
            else:
                todo += b.slice(b.num_rows // 2), b.slice(0, b.num_rows // 2)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): one row (node, root) per node, root the smallest node reachable.

    Alternates the two star operations of MapReduce connected components until no edge changes. A node with many
    neighbours costs one row per neighbour in a join that adaptive execution can split; nothing is collected but two sums.
    """

    def state(e: DataFrame) -> tuple:
        # exact sums: decimals don't overflow and don't depend on the order of addition
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut(e)
    now = state(e)
    while now[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        e = cut(small)
        before, now = now, state(e)
        if before == now:
            break
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
