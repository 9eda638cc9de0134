"""Streams that give what the batch operators give: the rate limiter, the path of a reading from guard to class, and the
ingestion of points of any domain.

One processor holds all that the path of a sensor needs: how many readings it had, its run of violations, the value before and
when that began, the spike reported last, and the readings whose repeats are still turned away. Event-time timers take out what
can't matter any more, so state doesn't grow with time. A stream can begin with the state that a batch has left.

Rows of a key are put in order within a micro-batch; across micro-batches they must come in order of their times, as the batch
operators take them. Rows that are later than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import constants as K
from tidemark.functions import guards, rules
from tidemark.operators import events

MILLI = 1000  # microseconds


class Limiter(StatefulProcessor):
    """Calls of a key by bucket, with the buckets that still count as state."""

    def __init__(self, limit: int, width: int, forget: int):
        self.limit, self.width, self.forget = limit, width, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.buckets = handle, handle.getMapState("buckets", "bucket long", "calls long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the interface's names
        data = pd.concat(list(rows)).sort_values(["t", "sequence"])
        times = data["t"].to_numpy()
        bucket = times // self.width
        counts = pd.Series(bucket).value_counts(sort=False)
        before = {int(b): self._held(int(b)) for b in counts.index}
        total = {b: n + int(counts[b]) for b, n in before.items()}
        number = pd.Series(bucket).groupby(bucket).cumcount().to_numpy() + 1 + np.array([before[int(b)] for b in bucket], np.int64)
        previous = np.array([total[b] if (b := int(x) - 1) in total else self._held(b) for x in bucket], np.int64)
        approx = np.floor(previous * (1 - (times - bucket * self.width) / float(self.width))).astype(np.int64) + number
        for b, n in total.items():
            self.buckets.updateValue((b,), (n,))
            self.handle.registerTimer((b * self.width + self.forget) // MILLI)
        yield data.assign(approx=approx, allowed=approx <= self.limit)[["k", "t", "sequence", "approx", "allowed"]]

    def _held(self, bucket: int) -> int:
        return self.buckets.getValue((bucket,))[0] if self.buckets.containsKey((bucket,)) else 0

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        gone = expiredTimerInfo.getExpiryTimeInMs() * MILLI - self.forget
        for (b,) in [k for k in self.buckets.keys() if k[0] * self.width <= gone]:
            self.buckets.removeKey((b,))
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def rate_limited(calls: DataFrame, key: str, time_col: str, limit: int, window_seconds: int = K.RATE_WINDOW_SECONDS, forget_seconds: int = K.LIMITER_SECONDS, late: str = "5 minutes") -> DataFrame:
    """(k, t, sequence, approx, allowed) of a stream of calls, as the batch limiter says. A bucket is forgotten forget_seconds after its start, by event time."""
    if forget_seconds < 2 * window_seconds:
        raise ValueError("a bucket counts until the end of the one after it, so it can't be forgotten sooner")
    rows = calls.select(F.col(key).alias("k"), F.col(time_col).alias("t"), "sequence", F.timestamp_micros(time_col).alias("ts")).withWatermark("ts", late)
    processor = Limiter(limit, window_seconds * K.SECOND, forget_seconds * K.SECOND)
    kind = f"k {rows.schema['k'].dataType.simpleString()}, t long, sequence long, approx long, allowed boolean"
    return rows.groupBy("k").transformWithStateInPandas(statefulProcessor=processor, outputStructType=kind, outputMode="Append", timeMode="EventTime")


class Path(StatefulProcessor):
    """The path of a sensor's good readings: repeats, warm-up, run of violations, change from the value before, cooldown."""

    def __init__(self, spikes: dict[str, float | None], fresh: int, cooldown: int, life: int, warm_up: int, required: int):
        self.spikes, self.fresh, self.cooldown, self.life, self.warm_up, self.required = spikes, fresh, cooldown, life, warm_up, required

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "n long, run long, value double, since long, told long")
        self.seen = handle.getMapState("seen", "sent long, value double", "received long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        r = initialState.iloc[0]
        known = lambda x, kind: None if pd.isna(x) else kind(x)
        self.held.update((int(r["n"]), int(r["run"]), known(r["value"], float), known(r["since"], int), known(r["told"], int)))

    def _first(self, data: pd.DataFrame) -> pd.Series:
        """Whether a reading isn't a repeat: rows by (received, sequence), each against the last accepted one like it."""
        first, now = {}, {}
        for at, sent, value, received in data.sort_values(["received", "sequence"])[["sent_key", "value", "received"]].itertuples():
            like = (int(sent), float(value))
            last = now[like] if like in now else self.seen.getValue(like)[0] if self.seen.containsKey(like) else None
            first[at] = last is None or received - last >= self.life
            if first[at]:
                now[like] = int(received)
        for like, received in now.items():
            self.seen.updateValue(like, (received,))
            self.handle.registerTimer((received + self.life) // MILLI + 1)
        return data.index.map(first)

    def _triggered(self, value: float, t: int, before: float, since: int, floor: float, least: float) -> bool:
        """Whether a change reaches one of the thresholds: rules.spike for one row."""
        delta = abs(value - before)
        relative = abs(delta / before) if abs(before) > 1e-6 else 0.0
        if delta < floor and relative < least:
            return False
        seconds = (t - since) / float(K.SECOND)
        seconds = 0.001 if seconds <= 0 else seconds
        found = {"abs_delta": delta, "rel_delta": relative, "abs_slope": delta / seconds, "rel_slope": relative / seconds}
        return any(limit is not None and found[k] >= limit for k, limit in self.spikes.items())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        data = pd.concat(list(rows), ignore_index=True)
        data["first"] = self._first(data)
        data = data.sort_values(["t", "sequence"])
        n, run, last, since, told = self.held.get() if self.held.exists() else (0, 0, None, None, None)
        outcomes, reasons = [], []
        for x in data.itertuples():
            if not x.first:
                outcomes.append("duplicate")
                reasons.append(None)
                continue
            n += 1
            before = last if last is not None and x.t - since <= self.fresh else None
            changed = before is not None and self._triggered(x.value, x.t, before, since, x.noise_abs, x.noise_rel)
            if not x.is_out and last != x.value:
                since = x.t
            if not x.is_out:
                last = x.value
            if n < self.warm_up:
                why = "warming_up"
            else:
                run = run + 1 if x.is_out else 0
                if x.is_out:
                    why = "out_of_range" if run >= self.required else "out_of_range_pending"
                elif x.in_band:
                    why = "warning_band"
                elif changed and (told is None or x.t - told >= self.cooldown):
                    why, told = "spike", x.t
                else:
                    why = "spike_cooldown" if changed else "clean"
            outcomes.append("routed")
            reasons.append(why)
        as_long = lambda x: None if x is None else int(x)
        self.held.update((int(n), int(run), None if last is None else float(last), as_long(since), as_long(told)))
        yield data.assign(outcome=outcomes, reason=reasons)[["sensor_id", "t", "sequence", "value", "outcome", "reason"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        gone = expiredTimerInfo.getExpiryTimeInMs() * MILLI - self.life
        for like in [k for k, v in self.seen.iterator() if v[0] <= gone]:
            self.seen.removeKey(like)
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def routed(rows: DataFrame, ranges: DataFrame, spikes: dict[str, float | None], now: int, fresh_seconds: float = K.FRESH_SECONDS, cooldown_seconds: float = K.COOLDOWN_SECONDS, dedup_seconds: float = K.DEDUP_SECONDS, warm_up: int = K.WARM_UP_READINGS, required: int = K.CONSECUTIVE, late: str = "10 minutes", initial: DataFrame | None = None) -> DataFrame:
    """(sensor_id, t, sequence, value, outcome, reason, class, suspicious, persist_reading, update_latest, to_learning) of a stream of arrivals.

    The batch path's rows for any cut of the stream into micro-batches. rows: (sensor_id, sensor_type, value, t, sent,
    received, sequence); ranges: a batch table, one row per sensor. initial: events.left_behind of what was routed before.
    """
    guard = guards.reading_reason(F.col("sensor_id"), F.col("value"), F.col("sent"), now)
    r = rows.withColumn("guard", guard).join(ranges, "sensor_id", "left")
    rejected = r.where("guard is not null").select("sensor_id", "t", "sequence", "value", F.lit("rejected").alias("outcome"), F.col("guard").alias("reason"))
    good = r.where("guard is null").select(
        "sensor_id", "t", "sequence", "value", "received", F.coalesce("sent", F.lit(-(2**63))).alias("sent_key"),
        guards.below_or_above(F.col("value"), F.col("low"), F.col("high")).alias("is_out"),
        F.coalesce(rules.within_band(F.col("value"), F.col("warning_min"), F.col("warning_max")), F.lit(False)).alias("in_band"),
        events.noise(F.col("sensor_type"), 0).alias("noise_abs"), events.noise(F.col("sensor_type"), 1).alias("noise_rel"), F.timestamp_micros("received").alias("ts"),
    ).withWatermark("ts", late)
    processor = Path(dict(spikes), *(int(x * K.SECOND) for x in (fresh_seconds, cooldown_seconds, dedup_seconds)), warm_up, required)
    kind = "sensor_id long, t long, sequence long, value double, outcome string, reason string"
    told = good.groupBy("sensor_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=kind, outputMode="Append", timeMode="EventTime",
        initialState=None if initial is None else initial.groupBy("sensor_id"),
    )
    return events.consequences(rejected.unionByName(told))


class Series(StatefulProcessor):
    """The points of a series that aren't repeats, each with the value before that no bound has stopped.

    Points are held until the watermark has passed them, which is when no repeat can come any more; of those that go, the
    newest that no bound has stopped is kept for good.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "t long", "value double, passes boolean")
        self.newest = handle.getValueState("newest", "t long, value double")

    def _state(self) -> pd.DataFrame:
        rows = [(t, value, passes) for (t,), (value, passes) in self.held.iterator()]
        if self.newest.exists():
            rows.append((*self.newest.get(), True))
        return pd.DataFrame(rows, columns=["t", "value", "passes"]).assign(new=False)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        data = pd.concat(list(rows)).sort_values(["t", "sequence"]).assign(new=True)
        held = self._state()
        data = (pd.concat([held, data]) if len(held) else data).drop_duplicates("t").sort_values("t", kind="stable")
        value, passes = data["value"].astype(float), data["passes"].astype(bool)
        data["previous_value"] = value.where(passes).ffill().shift(1).where(passes)
        data = data[data["new"].astype(bool)]
        for t, value, passes in data[["t", "value", "passes"]].itertuples(index=False):
            self.held.updateValue((int(t),), (float(value), bool(passes)))
        if len(data):
            self.handle.registerTimer(int(data["t"].iloc[-1]) // MILLI + 1)
        yield data.astype({"t": "int64", "sequence": "int64"})[["series_id", "t", "sequence", "value", "violated_constraint", "max_abs_delta", "max_rel_delta", "previous_value"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        gone = [(t, value, passes) for (t,), (value, passes) in self.held.iterator() if t < expiredTimerInfo.getExpiryTimeInMs() * MILLI]
        for t, _, _ in gone:
            self.held.removeKey((t,))
        if passing := [(t, value) for t, value, passes in gone if passes]:
            self.newest.update(max([*passing, *([tuple(self.newest.get())] if self.newest.exists() else [])]))
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def ingested(points: DataFrame, config: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(series_id, t, sequence, value, previous_value, violated_constraint, classification, error) of a stream of points.

    Rejected points have an error and no class. Of points with equal series and time one is left, that which came first or has
    the smallest sequence; each is classified against its whole history, as the batch classifier does, for any cut into
    micro-batches. A point that is older than another that came in an earlier micro-batch changes nothing in that one's class.
    points: (series_id, domain, stream_id, value, t, sequence); config: bounds, a batch table.
    """
    error = F.coalesce(F.when(~guards.not_iot(F.col("domain")), "invalid_domain"), guards.value_reason(F.col("value")), F.when(F.col("t").isNull(), "missing_timestamp"))
    checked = points.withColumn("error", error)
    c = checked.where("error is null").join(config.withColumn("configured", F.lit(True)), ["domain", "stream_id"], "left")
    c = c.withColumn("violated_constraint", rules.violated_bound(F.col("value"), {b: F.col(b) for b in K.BOUNDS[:8]}))
    passes = F.col("configured").isNotNull() & F.col("violated_constraint").isNull()
    c = c.select("series_id", "t", "sequence", "value", "violated_constraint", passes.alias("passes"), "max_abs_delta", "max_rel_delta", F.timestamp_micros("t").alias("ts")).withWatermark("ts", late)
    kind = "series_id string, t long, sequence long, value double, violated_constraint string, max_abs_delta double, max_rel_delta double, previous_value double"
    told = c.groupBy("series_id").transformWithStateInPandas(statefulProcessor=Series(), outputStructType=kind, outputMode="Append", timeMode="EventTime")
    delta = rules.change_bound(F.col("value"), F.col("previous_value"), F.col("max_abs_delta"), F.col("max_rel_delta"))
    told = told.withColumn("classification", rules.class_of(F.col("violated_constraint"), delta)).drop("max_abs_delta", "max_rel_delta")
    rejected = checked.where("error is not null").select("series_id", "t", "sequence", "value", "error")
    return told.unionByName(rejected, allowMissingColumns=True)
