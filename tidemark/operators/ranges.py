"""Ordered scans of keys of any size: rows are dealt out by ranges of (key, order), so one key may lie in many tasks.

A scan passes over the ranges twice. The first pass says of each range what its rows of its last key do to a state that
comes in: a map of states. These maps are put together in order of the ranges, which gives the state that each range begins
with; only a range's first key can have begun before it, so there is one small map and one state for each range, however
many keys there are. The second pass gives each row its answer. Inside a batch all is array operations: maps are composed by
doubling, never row by row.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut

#: Rows of a key from which on it is dealt out over several tasks.
HOT_ROWS = 1_000_000
RANGE = "_range"


def dealt(rows: DataFrame, keys: list[str], order: list[str | Column], parts: int | None = None) -> DataFrame:
    """rows in order within ranges of (keys, order), with the number of their range. Cut, so that both passes see the same ranges."""
    by = [*keys, *order]
    ranged = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    return cut(ranged.sortWithinPartitions(*by).withColumn(RANGE, F.spark_partition_id()))


def by_size(rows: DataFrame, keys: list[str], plain: Callable[[DataFrame], DataFrame], split: Callable[[DataFrame], DataFrame], most: int | None = None) -> DataFrame:
    """plain(rows of keys with few rows) and split(rows of keys with more than `most`), which must give the same columns. One count by key decides."""
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > (HOT_ROWS if most is None else most)).select(*(F.col(k).alias(f"_hot_{k}") for k in keys))
    if hot.isEmpty():
        return plain(rows)
    hot = cut(hot)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys))
    return plain(rows.join(hot, same, "left_anti")).unionByName(split(rows.join(hot, same, "left_semi")))


class Scan:
    """What a scan keeps and answers; states and maps are anything that pickles and stays small."""

    def columns(self) -> list[str]:
        """The columns that it reads."""
        raise NotImplementedError

    def start(self) -> Any:
        """The state before a key's first row."""
        raise NotImplementedError

    def identity(self) -> Any:
        """The map of no rows."""
        raise NotImplementedError

    def extended(self, so_far: Any, given: list[pa.Array]) -> Any:
        """A map with the rows of one key that follow."""
        raise NotImplementedError

    def applied(self, map_: Any, state: Any) -> Any:
        """The state after a map's rows."""
        raise NotImplementedError

    def answers(self, states: list[Any], starts: np.ndarray, given: list[pa.Array]) -> tuple[pa.Array, Any]:
        """The answers of a batch, whose keys begin at starts with these states, and the state after its last row."""
        raise NotImplementedError


def _starts(b: pa.RecordBatch, at: list[int]) -> np.ndarray:
    """The places of a batch's rows where a key begins."""
    codes = np.stack([b.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy() for k in at], 1)
    return np.r_[0, np.flatnonzero((np.diff(codes, axis=0) != 0).any(1)) + 1]


def scanned(rows: DataFrame, keys: list[str], order: list[str | Column], scan: Scan, name: str, kind: str, parts: int | None = None) -> DataFrame:
    """rows with the scan's answer of each in a column of that name."""
    kept, out_of = rows.columns, rows.select("*", F.lit(None).cast(kind).alias(name)).schema
    lying = dealt(rows, keys, order, parts)
    held = [*keys, *scan.columns()]
    n_keys = len(keys)

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = number = None
        map_ = scan.identity()
        for b in batches:
            if not b.num_rows:
                continue
            starts, number = _starts(b, list(range(n_keys))), b.column(len(held))[0].as_py()
            key = [b.column(k)[0].as_py() for k in range(n_keys)]
            first = key if first is None else first
            if len(starts) > 1 or key != last:
                map_ = scan.identity()
            last, tail = [b.column(k)[b.num_rows - 1].as_py() for k in range(n_keys)], b.slice(int(starts[-1]))
            map_ = scan.extended(map_, [tail.column(k) for k in range(n_keys, len(held))])
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([pickle.dumps((first, last, map_))])], ["number", "told"])

    # one row for each range
    told = sorted((r["number"], pickle.loads(r["told"])) for r in lying.select(*held, RANGE).mapInArrow(summary, "number int, told binary").collect())
    begins, key, state = {}, None, scan.start()
    for number, (first, last, map_) in told:
        carried = state if first == key else scan.start()
        begins[number] = (carried, first == key)
        state = scan.applied(map_, carried if first == last else scan.start())
        key = last

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            if not b.num_rows:
                continue
            at = [b.schema.names.index(c) for c in held]
            starts = _starts(b, at[:n_keys])
            first = [b.column(k)[0].as_py() for k in at[:n_keys]]
            if key is None:
                state = begins[b.column(b.schema.names.index(RANGE))[0].as_py()][0]
            elif first != key:
                state = scan.start()
            told, state = scan.answers([state] + [scan.start()] * (len(starts) - 1), starts, [b.column(k) for k in at[n_keys:]])
            key = [b.column(k)[b.num_rows - 1].as_py() for k in at[:n_keys]]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(c)) for c in kept), told], [*kept, name])

    return lying.mapInArrow(answer, out_of)


class Automaton(Scan):
    """A finite automaton: step[symbol, state] is the next state; a row's answer is the name of the state after it."""

    def __init__(self, symbol_col: str, step: np.ndarray, start: int, names: list[str]):
        self.symbol, self.step, self.first, self.names = symbol_col, np.asarray(step, np.int16), start, names

    def columns(self):
        return [self.symbol]

    def start(self):
        return self.first

    def identity(self):
        return np.arange(self.step.shape[1], dtype=np.int16)

    def extended(self, so_far, given):
        maps = self.step[given[0].to_numpy()]
        while len(maps) > 1:  # pairs of neighbours become one map
            odd = maps[-1:] if len(maps) % 2 else maps[:0]
            maps = np.r_[np.take_along_axis(maps[1::2], maps[: len(maps) - len(odd) : 2].astype(np.int64), 1), odd]
        return maps[0][so_far]

    def applied(self, map_, state):
        return int(map_[state])

    def answers(self, states, starts, given):
        maps = self.step[given[0].to_numpy()]
        # a key's first row leads to one state, whatever comes in: so composition doesn't reach over keys
        maps[starts] = maps[starts, states][:, None]
        reach = 1
        while reach < len(maps):
            maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.int64), 1)
            reach *= 2
        after = maps[:, 0]
        return pa.array(np.array(self.names, object)[after], pa.string()), int(after[-1])


def _chains(times: np.ndarray, groups: np.ndarray, gap: int) -> np.ndarray:
    """Of each row the next one of its group that comes gap or more later, itself if there is none. Rows are in order of (group, time)."""
    base = times.min()
    span = int(times.max() - base) + gap + 1
    place = groups * span + (times - base)
    at = np.searchsorted(place, place + gap)
    own = np.arange(len(times))
    at = np.where(at > own, at, own + 1)  # a gap of nothing
    ok = at < len(times)
    ok[ok] = groups[at[ok]] == groups[ok]
    return np.where(ok, at, own)


class Spaced(Scan):
    """Accepts the first row of a key and each that comes gap or more after the last accepted one. A state is that one's time, or None.

    A map holds a few starts and ends: if the first accepted row of its rows has a time up to starts[k] (and over the one before),
    the last one has the time ends[k]. Chains that begin close to each other soon meet, so few differ.
    """

    def __init__(self, time_col: str, gap: int, only: str | None = None):
        self.time, self.gap, self.only = time_col, gap, only

    def columns(self):
        return [self.time] + ([self.only] if self.only else [])

    def start(self):
        return None

    def identity(self):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), None  # starts, ends, the time up to which rows can be the first

    def _looked_at(self, given):
        n = len(given[0])
        wanted = given[1].fill_null(False).to_numpy(zero_copy_only=False) if self.only else np.ones(n, bool)
        missing = given[0].is_null().to_numpy(zero_copy_only=False)
        return wanted, missing, given[0].fill_null(0).to_numpy()

    def extended(self, so_far, given):
        wanted, missing, times = self._looked_at(given)
        times = times[wanted & ~missing]
        starts, ends, upto = so_far
        if not len(times):
            return so_far
        last = _chains(times, np.zeros(len(times), np.int64), self.gap)
        while (last[last] != last).any():
            last = last[last]
        last = times[last]
        # chains of the map go on here; this batch's rows can begin chains up to a gap after the first row, and the one behind that
        at = np.searchsorted(times, ends + self.gap)
        ends = np.where(at < len(times), last[np.minimum(at, len(times) - 1)], ends)
        new = slice(0, 0)
        if upto is None or (len(starts) and starts[-1] < upto):
            upto = int(times[0]) + self.gap if upto is None else upto
            new = slice(0, int(np.searchsorted(times, upto)) + 1)
        starts, ends = np.r_[starts, times[new]], np.r_[ends, last[new]]
        keep = np.r_[(ends[1:] != ends[:-1]), True]
        return starts[keep], ends[keep], upto

    def applied(self, map_, state):
        starts, ends, upto = map_
        if not len(starts):
            return state
        k = 0 if state is None else int(np.searchsorted(starts, state + self.gap))
        return int(ends[k]) if k < len(starts) else state

    def answers(self, states, starts, given):
        wanted, missing, times = self._looked_at(given)
        out, rows = wanted & missing, np.flatnonzero(wanted & ~missing)
        times, groups = times[rows], np.searchsorted(starts, rows, "right") - 1
        state = states[-1]
        if len(times):
            follows = _chains(times, groups, self.gap)
            marked = np.zeros(len(times), bool)
            begin, held = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]), states[0]
            if groups[0] == 0 and held is not None:
                end = int(np.searchsorted(groups, 0, "right"))
                at = int(np.searchsorted(times[:end], held + self.gap))
                begin = np.r_[[at] if at < end else np.zeros(0, np.int64), begin[1:]].astype(np.int64)
            marked[begin] = True
            while (follows[follows] != follows).any():  # each round marks twice as many of a chain
                marked[follows[np.flatnonzero(marked)]] = True
                follows = follows[follows]
            marked[follows[np.flatnonzero(marked)]] = True
            out[rows[marked]] = True
            own = times[marked & (groups == len(starts) - 1)]
            state = int(own[-1]) if len(own) else state
        return pa.array(out), state


class Newest(Scan):
    """Of each row the last value before it in its key that isn't null."""

    def __init__(self, value_col: str):
        self.value = value_col

    def columns(self):
        return [self.value]

    def start(self):
        return None

    def identity(self):
        return None

    def extended(self, so_far, given):
        known = given[0].drop_null()
        return known[len(known) - 1].as_py() if len(known) else so_far

    def applied(self, map_, state):
        return state if map_ is None else map_

    def answers(self, states, starts, given):
        known, n = given[0].is_valid().to_numpy(zero_copy_only=False), len(given[0])
        at = np.maximum.accumulate(np.where(known, np.arange(n), -1))
        before = np.r_[-1, at[:-1]]
        first = starts[np.searchsorted(starts, np.arange(n), "right") - 1]
        values = given[0].take(pa.array(np.where(before >= first, before, 0), mask=before < first))
        if states[0] is not None:  # only the first key can have begun before
            end = int(starts[1]) if len(starts) > 1 else n
            values = pa.concat_arrays([values.slice(0, end).fill_null(states[0]), values.slice(end)])
        state = given[0][int(at[-1])].as_py() if at[-1] >= starts[-1] else states[-1]
        return values, state
