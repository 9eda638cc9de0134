"""SimHash fingerprints, a Gray-order hierarchical index that links those within a few bits of each other, and near duplicates.

Fingerprints lie in Gray order, where neighbours share most bits. Runs of them are the leaves of a tree whose upper nodes
keep the bits that all fingerprints below them agree on. Two trees (or one with itself) are walked from the top: two nodes
whose agreed bits differ in too many places are dropped with all that is below them.

A large table is laid out in several Gray orders, each of which puts some bits first: two fingerprints within the distance
agree on the first bits of one order at least, so only groups with equal first bits meet there. A large group is cut into
cells by range; cells meet only if their agreed bits allow it.
"""

from __future__ import annotations

import math
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.common import components, cut

#: Rows that a group of equal first bits has on the average, and the most that one cell of a group holds.
GROUP_ROWS, CELL_ROWS = 4096, 16384
FANOUT = 16
#: Pairs of nodes whose children are compared at once.
AT_ONCE = 1024
ALL = ~np.uint64(0)


def shingle_hashes(text: bytes, width: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of a text in UTF-8, repeats included: A-Z lower-cased, words between ASCII white space; fewer words are one shingle."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if n <= width:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends)]
    return np.fromiter(map(xxh64_intdigest, [joined[s:e] for s, e in zip(starts, ends[width - 1 :])], repeat(seed)), np.uint64, n - width + 1)


def majority(h: np.ndarray) -> int:
    """The bits (unsigned) that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        ones += np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """The 64 bits (unsigned) of a text; zero without words."""
    return majority(shingle_hashes(text, width, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp): one row per row of docs; fp holds the 64 bits as a signed long. A null or empty text has fp 0."""

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            bits = np.fromiter((fingerprint(t or b"", width) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits.view(np.int64))], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, docs.select(id_col, F.lit(0).cast("long").alias("fp")).schema)


def gray_rank(fp: Column) -> Column:
    """The place of a 64-bit word in the Gray code's order, where neighbours differ in one bit (as a signed long: from the middle on)."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp


def at_rank(rank: np.ndarray) -> np.ndarray:
    """The words at these places of the Gray code's order."""
    rank = rank.view(np.uint64)
    return rank ^ (rank >> np.uint64(1))


class Cell:
    """Fingerprints in Gray order and the tree above them; levels[k] holds (bits, mask of the agreed ones) of its nodes in rows of FANOUT."""

    def __init__(self, fps: np.ndarray):
        self.fps, self.n = fps, len(fps)
        value, mask = fps, np.full(len(fps), ALL)
        self.sizes, self.levels = [], []
        while True:
            self.sizes.append(len(value))
            self.levels.append((self._rows(value), self._rows(mask)))
            if len(value) <= 1:
                break
            at = np.arange(0, len(value), FANOUT)
            every, some = np.bitwise_and.reduceat(value, at), np.bitwise_or.reduceat(value | ~mask, at)
            mask = np.bitwise_and.reduceat(mask, at) & ~(every ^ some)
            value = every & mask
        self.agreed, self.mask = int(value[0]), int(mask[0])

    @staticmethod
    def _rows(x: np.ndarray) -> np.ndarray:
        out = np.zeros(-(-len(x) // FANOUT) * FANOUT, np.uint64)
        out[: len(x)] = x
        return out.reshape(-1, FANOUT)

    def below(self, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The nodes under those of a depth; above its root a tree goes on as the root alone."""
        k = min(depth - 1, len(self.levels) - 1)
        return *self.levels[k], self.sizes[k]


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each row's smallest linked row so far) after the links i-j."""
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return label
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]


def link_cells(a: Cell, b: Cell, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Links that join all fingerprints of a with those of b (a itself: among each other) within most bits, at most one per fingerprint, as two arrays; and how many pairs of fingerprints were compared."""
    same, compared = a is b, 0
    fps = a.fps if same else np.r_[a.fps, b.fps]
    label, first_b = np.arange(len(fps)), 0 if same else a.n
    stack = [(max(1, len(a.levels) - 1, len(b.levels) - 1), np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        depth, left, right = stack.pop()
        if len(left) > AT_ONCE:
            stack += [(depth, left[k : k + AT_ONCE], right[k : k + AT_ONCE]) for k in range(0, len(left), AT_ONCE)]
            continue
        (va, ma, na), (vb, mb, nb) = a.below(depth), b.below(depth)
        differ = va[left][:, :, None] ^ vb[right][:, None, :]
        if depth > 1:
            differ &= ma[left][:, :, None] & mb[right][:, None, :]
        else:
            compared += differ.size
        pair, s, t = np.nonzero(np.bitwise_count(differ) <= most)
        i, j = left[pair] * FANOUT + s, right[pair] * FANOUT + t
        ok = (i < na) & (j < nb)
        if same:
            ok &= (i < j) if depth == 1 else (i <= j)
        i, j = i[ok], j[ok]
        if depth == 1:
            label = _merge(label, i, j + first_b)
            continue
        span = FANOUT ** (depth - 1)  # nodes whose members are all linked with each other already have nothing to add
        at_a, at_b = np.arange(0, a.n, span), np.arange(first_b, len(fps), span)
        low_a, high_a = np.minimum.reduceat(label[: a.n], at_a), np.maximum.reduceat(label[: a.n], at_a)
        low_b, high_b = np.minimum.reduceat(label, at_b), np.maximum.reduceat(label, at_b)
        new = (low_a[i] != high_b[j]) | (low_b[j] != high_a[i])
        if new.any():
            stack.append((depth - 1, i[new], j[new]))
    far = label != np.arange(len(fps))
    return fps[far], fps[label[far]], compared


def orders(rows: int, most: int, group_rows: int = GROUP_ROWS) -> list[int]:
    """Masks of the first bits of each Gray order: two words within most bits agree on all bits of one mask.

    The more rows, the more bits, so that groups of equal first bits keep the size of group_rows where bits are evenly spread.
    """
    bits = math.ceil(math.log2(max(1, rows / group_rows)))
    if not bits:
        return [0]
    agree = next((k for k in (1, 2) if k * (64 // (most + k)) >= bits), 3)
    width = min(64 // (most + agree), -(-bits // agree))
    blocks = [((1 << width) - 1) << (k * width) for k in range(most + agree)]
    return [sum(own) for own in combinations(blocks, agree)]


def _cells(most: int, cell_rows: int):
    """For mapInArrow over rows (route, bits, part, rank) in order: links inside of cells, and the cells of groups that have several."""

    def row(a=None, b=None, ranks=None, **more):
        n = len(a) if a is not None else 1
        columns = [pa.nulls(n, pa.int64()) if x is None else pa.array(x) for x in (a, b)]
        columns += [pa.array([more.get(k)] * n, pa.int64()) for k in ("route", "bits", "cell", "agreed", "mask")]
        columns.append(pa.nulls(n, pa.list_(pa.int64())) if ranks is None else pa.array([ranks], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "route", "bits", "cell", "agreed", "mask", "ranks"])

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    def run(batches):
        cells, held, key, several = 0, [], None, False

        def close():
            nonlocal cells, held
            ranks = np.concatenate(held)
            cell, held = Cell(at_rank(ranks)), []
            x, y, _ = link_cells(cell, cell, most)
            if len(x):
                yield row(x.view(np.int64), y.view(np.int64))
            if several:
                yield row(route=key[0], bits=key[1], cell=(TaskContext.get().partitionId() << 32) + cells, agreed=signed(cell.agreed), mask=signed(cell.mask), ranks=ranks)
                cells += 1

        for b in batches:
            keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in range(3)], 1)
            rank = b.column(3).to_numpy()
            for own in np.split(np.arange(len(rank)), np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1) if len(rank) else ():
                if (now := tuple(keys[own[0]].tolist())) != key:
                    if held:
                        yield from close()
                    key, several = now, now[2] >= 0
                while len(own):
                    room = cell_rows - sum(map(len, held))
                    held.append(rank[own[:room]])
                    own = own[room:]
                    if len(own):
                        yield from close()
        if held:
            yield from close()

    return run


def _between(most: int):
    """For mapInArrow over rows (x, y, side, rank), sorted: links between the two cells of each pair."""

    def found(rows: np.ndarray):
        a, b = (Cell(at_rank(np.ascontiguousarray(rows[rows[:, 2] == k, 3]))) for k in (0, 1))
        x, y, _ = link_cells(a, b, most)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    def run(batches):
        held = []
        for b in batches:
            rows = np.stack([b.column(c).to_numpy().astype(np.int64) for c in range(4)], 1)
            for own in np.split(rows, np.flatnonzero((np.diff(rows[:, :2], axis=0) != 0).any(1)) + 1) if len(rows) else ():
                if held and (held[-1][0, :2] != own[0, :2]).any():
                    yield found(np.concatenate(held))
                    held = []
                held.append(own)
        if held:
            yield found(np.concatenate(held))

    return run


def links(distinct: DataFrame, most: int = 4, group_rows: int = GROUP_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) that join all of the distinct fingerprints (fp long) within most bits.

    A group of more than cell_rows rows is dealt out by ranges of its Gray ranks, so it is spread over tasks. Of the cells
    of one group only their headers meet (a row per cell); cells go on to meet where no more than most agreed bits differ.
    """
    spark = distinct.sparkSession
    masks = [m - (1 << 64) if m >> 63 else m for m in orders(distinct.count(), most, group_rows)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    routed = distinct.select(gray_rank(F.col("fp")).alias("rank"), F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks))).alias("route", "bits"))
    large = cut(routed.groupBy("route", "bits").count().where(F.col("count") > cell_rows))
    # so many of the first bits of a rank as make parts of about half a cell; -1 in groups that are one cell
    first = F.ceil(F.log2(F.col("count") * 2 / cell_rows)).cast("int")
    part = F.when(F.col("count").isNull(), F.lit(-1).cast("long")).otherwise(F.expr("shiftrightunsigned(rank, 64 - _first)"))
    ordered = routed.join(large, ["route", "bits"], "left").withColumn("_first", first).select("route", "bits", part.alias("part"), "rank")
    ordered = ordered.repartition(parts, "route", "bits", "part").sortWithinPartitions("route", "bits", "part", "rank")
    found = cut(ordered.mapInArrow(_cells(most, cell_rows), "a long, b long, route long, bits long, cell long, agreed long, mask long, ranks array<long>"))
    cells = found.where("cell is not null")
    heads = cells.select("route", "bits", "cell", "agreed", "mask")
    x, y = heads.alias("x"), heads.alias("y")
    near = F.bit_count(F.col("x.agreed").bitwiseXOR(F.col("y.agreed")).bitwiseAND(F.col("x.mask")).bitwiseAND(F.col("y.mask"))) <= most
    pairs = x.join(y, (F.col("x.route") == F.col("y.route")) & (F.col("x.bits") == F.col("y.bits")) & (F.col("x.cell") < F.col("y.cell")) & near)
    pairs = pairs.select(F.col("x.cell").alias("x"), F.col("y.cell").alias("y"))
    sides = pairs.select("x", "y", F.posexplode(F.array("x", "y")).alias("side", "cell"))
    met = sides.join(cells.select("cell", "ranks"), "cell").select("x", "y", "side", F.explode("ranks").alias("rank"))
    met = met.repartition(parts, "x", "y").sortWithinPartitions("x", "y", "side", "rank")
    return found.where("cell is null").select("a", "b").unionByName(met.mapInArrow(_between(most), "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, most: int = 4) -> DataFrame:
    """(id, fp, component_id): one row per row of docs; component_id is the smallest id reachable over links, its own included.

    Null ids never name a component unless all ids of it are null. Rows with equal ids or texts each keep their row, a
    null text is an empty one, extra columns are left out, and an empty table gives an empty one.
    """
    fps = cut(fingerprints(docs, id_col, text_col, width))
    distinct = cut(fps.groupBy("fp").agg(F.min(id_col).alias("least")))
    linked = components(links(distinct, most))
    member = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(id_col, "fp", "component_id")
