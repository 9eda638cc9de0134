"""Lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only local masters may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir isn't set; on a cluster it must name a folder that all machines share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def folder(spark: SparkSession, what: str) -> str:
    """A new folder name of its own below the shared one."""
    return f"{shared_root(spark).rstrip('/')}/tidemark/{what}-{uuid.uuid4().hex}"


def cut(rows: DataFrame) -> DataFrame:
    """rows with their lineage cut by a reliable checkpoint, which outlives executors."""
    shared_root(rows.sparkSession)
    return rows.checkpoint()
