"""Ordered folds: operators whose answer for a row depends on what they answered before.

Rows go to the partition of their key and stream through in order, with one exchange and one sort; a task holds the state
of one key and one batch. Keys that hold very many rows are dealt out over several tasks (ranges.py).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.operators import ranges


def in_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def fold(rows: DataFrame, keys: list[str], order: list[str], inputs: list[str], start: Callable[[], Any], step: Callable[[Any, tuple], tuple[Any, Any]], name: str, kind: str) -> DataFrame:
    """rows with one more column: step(state, inputs) gives the next state and the row's answer; start() is a key's first state."""
    kept = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            at = [b.schema.names.index(c) for c in keys]
            own = list(zip(*(b.column(k).to_pylist() for k in at)))
            given = zip(*(b.column(b.schema.names.index(c)).to_pylist() for c in inputs))
            out = []
            for k, x in zip(own, given):
                if k != key:
                    key, state = k, start()
                state, answer = step(state, x)
                out.append(answer)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, _ARROW[kind])], [*kept, name])

    return in_order(rows, keys, order).mapInArrow(run, rows.select("*", F.lit(None).cast(kind).alias(name)).schema)


_ARROW = {"boolean": pa.bool_(), "string": pa.string(), "long": pa.int64(), "int": pa.int32()}


def spaced(rows: DataFrame, keys: list[str], time_col: str, seconds: float, order: list[str], name: str = "accepted", only: str | None = None, split: bool = True, most_rows: int | None = None) -> DataFrame:
    """rows with a flag: the first row of a key is accepted, and each that comes `seconds` or more after the last accepted one.

    This is the throttle of publishing, the cooldown of spikes, deduplication with a life time, and that of events and
    notifications. Times are microseconds; a row without one is accepted and changes nothing. only: a boolean column; rows
    where it isn't true are passed over, with a false flag. split: keys of more than most_rows rows are dealt out over several
    tasks; telling them takes a count of rows by key.
    """
    if order[0] != time_col:
        raise ValueError("rows must be in order of their times first")
    scan = ranges.Spaced(time_col, int(seconds * K.SECOND), only)
    plain = lambda r: _streamed(r, keys, order, scan, name, "boolean")
    if not split:
        return plain(rows)
    return ranges.by_size(rows, keys, plain, lambda r: ranges.scanned(r, keys, order, scan, name, "boolean"), most_rows)


def _streamed(rows: DataFrame, keys: list[str], order: list[str], scan: ranges.Scan, name: str, kind: str) -> DataFrame:
    """rows with the answers of a scan, each key in one task."""
    kept, held = rows.columns, [*keys, *scan.columns()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            if not b.num_rows:
                continue
            at = [b.schema.names.index(c) for c in held]
            starts = ranges._starts(b, at[: len(keys)])
            first = [b.column(k)[0].as_py() for k in at[: len(keys)]]
            states = [state if first == key else scan.start()] + [scan.start()] * (len(starts) - 1)
            told, state = scan.answers(states, starts, [b.column(k) for k in at[len(keys) :]])
            key = [b.column(k)[b.num_rows - 1].as_py() for k in at[: len(keys)]]
            yield pa.RecordBatch.from_arrays([*b.columns, told], [*kept, name])

    return in_order(rows, keys, order).mapInArrow(run, rows.select("*", F.lit(None).cast(kind).alias(name)).schema)


def breaker(rows: DataFrame, keys: list[str], time_col: str, ok_col: str, order: list[str], failures: int = K.BREAKER_FAILURES, recovery_seconds: float = K.BREAKER_RECOVERY_SECONDS, successes: int = K.BREAKER_SUCCESSES, name: str = "breaker") -> DataFrame:
    """rows with the circuit breaker's state after each call. A call that an open breaker turns away changes nothing and says REJECTED."""

    def step(state: tuple, x: tuple) -> tuple:
        mode, failed, succeeded, since = state
        now, ok = x
        if mode == "OPEN" and now - since >= recovery_seconds * K.SECOND:
            mode, succeeded = "HALF_OPEN", 0
        if mode == "OPEN":
            return (mode, failed, succeeded, since), "REJECTED"
        if ok:
            if mode == "HALF_OPEN":
                succeeded += 1
                if succeeded >= successes:
                    mode, failed = "CLOSED", 0
            else:
                failed = 0
        else:
            failed, since = failed + 1, now
            if mode == "HALF_OPEN" or failed >= failures:
                mode = "OPEN"
        return (mode, failed, succeeded, since), mode

    return fold(rows, keys, order, [time_col, ok_col], lambda: ("CLOSED", 0, 0, 0), step, name, "string")


def states(rows: DataFrame, keys: list[str], severity_col: str, order: list[str], warm_up: int = K.WARM_UP_READINGS, name: str = "state", most_rows: int | None = None) -> DataFrame:
    """rows with the sensor's state after each reading: warm-up first, then by severity (critical, warning, or null for a normal value).

    A warning never lowers an alert; a normal value brings back NORMAL. States follow each other by a table, so the rows of a
    key of more than most_rows rows are dealt out over several tasks.
    """

    names = ["INITIALIZING"] * warm_up + ["NORMAL", "WARNING", "ALERT"]
    normal, warning, alert = range(warm_up, warm_up + 3)
    step = np.zeros((3, warm_up + 3), np.int16)
    for symbol, target in enumerate((normal, warning, alert)):  # no severity, any but critical, critical
        for state in range(warm_up + 3):
            # the reading that ends the warm-up is judged as one of a normal sensor
            mode = names[state] if state + 1 != warm_up else "NORMAL"
            held = normal if state + 1 == warm_up else state
            may = names[target] in K.TRANSITIONS[mode] and not (mode == "ALERT" and target == warning)
            step[symbol, state] = state + 1 if mode == "INITIALIZING" else target if may else held
    severity = F.lower(F.coalesce(F.col(severity_col), F.lit("")))
    marked = rows.withColumn("_symbol", F.when(severity == "critical", 2).when(severity != "", 1).otherwise(0))
    scan = ranges.Automaton("_symbol", step, 0 if warm_up > 0 else normal, names)
    plain = lambda r: _streamed(r, keys, order, scan, name, "string")
    return ranges.by_size(marked, keys, plain, lambda r: ranges.scanned(r, keys, order, scan, name, "string"), most_rows).drop("_symbol")
