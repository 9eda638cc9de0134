"""Feeds of messages: batches and streams of (topic, payload) from JSON-lines files, where a broker's subscription would stand.

Spark's own file source keeps account of the files: each is read once, whatever its name and whenever it arrives, from any
path that Spark reads, and a micro-batch takes no more of them than it is told to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files that one micro-batch takes.
FILES_PER_BATCH = 100


def feed(spark: SparkSession, folder: str, stream: bool = False, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """(topic, payload) of each line of the *.jsonl files in a folder. A payload that is an object comes as its JSON text; a line that can't be read has no topic and is its own payload."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch) if stream else spark.read
    lines = reader.option("pathGlobFilter", "*.jsonl").text(folder)
    topic, payload = (F.get_json_object("value", f"$.{c}") for c in ("topic", "payload"))
    good = topic.isNotNull() & payload.isNotNull()
    return lines.select(F.when(good, topic).otherwise("").alias("topic"), F.when(good, payload).otherwise(F.col("value")).alias("payload"))
