"""Streams of readings: deduplication, windows, throttling, classification and idempotent writes.

Each takes a streaming DataFrame with a timestamp column and gives one. State is kept by key in the state store, so it
outlives restarts and executors. Watermarks bound the state of windows and deduplication, a life time, if one is given,
that of throttles and classifiers: a key that is silent for so long starts anew. Life times go by the clock, so a stream
that has one runs until it is stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import constants as K
from tidemark.functions import rules


def timed(points: DataFrame, time_col: str = "t", name: str = "ts") -> DataFrame:
    """With a timestamp column from microseconds."""
    return points.withColumn(name, F.timestamp_micros(time_col))


def deduplicated(points: DataFrame, keys: list[str], time_col: str = "ts", seconds: int = K.DEDUP_SECONDS) -> DataFrame:
    """The first row of each key within the watermark; unlike the batch operator its life time isn't counted from the first acceptance."""
    return points.withWatermark(time_col, f"{seconds} seconds").dropDuplicatesWithinWatermark(keys)


def bucket_counts(points: DataFrame, keys: list[str], time_col: str = "ts", width: str = "60 seconds", late: str = "5 minutes") -> DataFrame:
    """Rows of each key by tumbling window; later rows than `late` are dropped."""
    return points.withWatermark(time_col, late).groupBy(F.window(time_col, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.max("sequence").alias("acknowledged")).select(*keys, F.unix_micros("window.start").alias("start"), "n", "acknowledged")


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A micro-batch's rows of one key, by time; the source's limits bound how many these are. Rows without a time are left out."""
    data = pd.concat(list(rows))
    return data[data["t"].notna()].astype({"t": "int64"}).sort_values(["t", "sequence"])


class Throttle(StatefulProcessor):
    """Of each key the rows that come `seconds` or more after the last accepted one."""

    def __init__(self, seconds: float, forget_seconds: float | None):
        self.gap, self.forget = int(seconds * K.SECOND), forget_seconds and int(forget_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t long", self.forget)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the interface's names
        data = _ordered(rows)
        last = self.last.get()[0] if self.last.exists() else None
        keep, times = np.zeros(len(data), bool), data["t"].to_numpy()
        at = 0 if last is None else int(np.searchsorted(times, last + self.gap))
        while at < len(times):
            keep[at], last = True, int(times[at])
            at = max(at + 1, int(np.searchsorted(times, last + self.gap)))
        if last is not None:
            self.last.update((last,))
        yield data.loc[keep, ["sensor_id", "t", "sequence", "value"]]

    def close(self) -> None:
        pass


def throttled(readings: DataFrame, seconds: float, forget_seconds: float | None = None) -> DataFrame:
    """(sensor_id, t, sequence, value): readings thinned out per sensor. A micro-batch's rows of a sensor are put in order first."""
    processor = Throttle(seconds, forget_seconds)
    return readings.select("sensor_id", "t", "sequence", "value").groupBy("sensor_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType="sensor_id long, t long, sequence long, value double", outputMode="Append", timeMode="ProcessingTime" if forget_seconds else "None")


class LastValue(StatefulProcessor):
    """Adds to each row the value before that no bound has stopped."""

    def __init__(self, forget_seconds: float | None):
        self.forget = forget_seconds and int(forget_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "value double", self.forget)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        data = _ordered(rows)
        last = self.value.get()[0] if self.value.exists() else None
        before = []
        for value, passes in zip(data["value"], data["passes"]):
            before.append(last if passes else None)
            last = value if passes else last
        if last is not None:
            self.value.update((float(last),))
        yield data.assign(previous_value=pd.array(before, dtype="Float64"))[["series_id", "sequence", "value", "violated_constraint", "max_abs_delta", "max_rel_delta", "previous_value"]]

    def close(self) -> None:
        pass


def classified(points: DataFrame, config: DataFrame, forget_seconds: float | None = None) -> DataFrame:
    """(series_id, sequence, value, previous_value, violated_constraint, classification): the classifier of batches, with its one value of state per series."""
    c = points.join(config.withColumn("configured", F.lit(True)), ["domain", "stream_id"], "left")
    c = c.withColumn("violated_constraint", rules.violated_bound(F.col("value"), {b: F.col(b) for b in K.BOUNDS[:8]}))
    c = c.withColumn("passes", F.col("configured").isNotNull() & F.col("violated_constraint").isNull())
    c = c.select("series_id", "t", "sequence", "value", "violated_constraint", "passes", "max_abs_delta", "max_rel_delta")
    kind = "series_id string, sequence long, value double, violated_constraint string, max_abs_delta double, max_rel_delta double, previous_value double"
    s = c.groupBy("series_id").transformWithStateInPandas(statefulProcessor=LastValue(forget_seconds), outputStructType=kind, outputMode="Append", timeMode="ProcessingTime" if forget_seconds else "None")
    delta = rules.change_bound(F.col("value"), F.col("previous_value"), F.col("max_abs_delta"), F.col("max_rel_delta"))
    return s.select("series_id", "sequence", "value", "previous_value", "violated_constraint", rules.class_of(F.col("violated_constraint"), delta).alias("classification"))


def write_once(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch goes to a folder of its own, so a batch that runs again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write


def tables_once(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over stateful.ingested: a micro-batch's readings, alerts and dead letters, each in a folder of the batch's own.

    The batch is computed once and kept while its three tables are written; a batch that runs again replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        told = batch.persist()
        try:
            good = told.where("error is null").drop("error")
            good.write.mode("overwrite").parquet(f"{folder}/readings/batch={batch_id}")
            alerts = good.where(rules.should_alert(F.col("classification"))).select("series_id", "sequence", "value", rules.alert_severity(F.col("classification")).alias("severity"), "violated_constraint", "t")
            alerts.write.mode("overwrite").parquet(f"{folder}/alerts/batch={batch_id}")
            dead = told.where("error is not null").select("series_id", "sequence", "error", F.lit("validation_error").alias("error_type"), "t", F.lit(0).alias("retry_count"))
            dead.write.mode("overwrite").parquet(f"{folder}/dead_letters/batch={batch_id}")
        finally:
            told.unpersist()

    return write


def drained(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Runs a stream over all that is there now and ends."""
    q = stream.writeStream.foreachBatch(write_once(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
