"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected and shifted in a different way for each curve and ordered by their place on a Hilbert curve. Spark
range-partitions each order; a query takes the window of rows around its own place and compares short codes there. How far a
code is from its vector bounds the true distance from both sides: only rows that can't be among the nearest of their window, or
then of all windows, go, and the others are ranked by exact distances on the original vectors. There is no cap on them.

The width of the windows is fitted on a bounded sample, and on a quarter of it, so that the wanted share of true neighbours
is found: how much wider the whole sample's windows are says how they grow with the table. Where vectors cluster they
hardly grow; where they have no structure they stay a share of all rows. Equal vectors are indexed once, with their smallest ids.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, shared_folder

#: Rows of a curve's order that a task compares at once.
BLOCK = 4096


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The places on the Hilbert curve of rows of integer coordinates of so many bits; at most 63 bits in all."""
    x = cells.T.astype(np.uint64).copy()
    n = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):  # undo the turns and reflections, from the coarsest cells down
        low = np.uint64((1 << b) - 1)
        for i in range(n):
            set_ = (x[i] >> np.uint64(b)) & one == one
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> np.uint64(b)) & one == one, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << one | (x[i] >> np.uint64(b)) & one
    return key.astype(np.int64)


@dataclass(frozen=True)
class Curves:
    """A projection and a shift for each curve; window: the rows on either side of a query in a table of `rows`; growth: the power of the table's size that it grows by."""

    projections: np.ndarray
    shifts: np.ndarray
    bits: int
    window: float = 0.0
    rows: int = 1
    growth: float = 1.0

    def half(self, rows: int) -> int:
        """The rows on either side of a query in a table of so many."""
        return max(256, math.ceil(self.window * max(1.0, rows / self.rows) ** self.growth))

    def keys(self, v: np.ndarray) -> np.ndarray:
        """(curves, rows) of Hilbert keys."""
        out = []
        for p, s in zip(self.projections, self.shifts):
            y = np.nan_to_num(v @ p + s, posinf=1.0, neginf=0.0)
            out.append(hilbert_keys(np.clip(y * (1 << self.bits), 0, (1 << self.bits) - 1).astype(np.int64), self.bits))
        return np.stack(out) if len(v) else np.zeros((len(self.shifts), 0), np.int64)


def fit(sample: np.ndarray, curves: int = 16, dims: int = 12, bits: int = 4, recall: float = 0.96, k: int = 10, queries: int = 128, seed: int = 7) -> Curves:
    """Curves for vectors like those of the sample, with the narrowest window that finds the wanted share of the k nearest within it.

    The sample's rows are in random order: a part of it stands for a smaller table.
    """
    r = np.random.default_rng(seed)
    d = sample.shape[1]
    dims = min(dims, d)
    mean = sample.mean(0)
    projections, shifts = [], []
    for _ in range(curves):
        p = np.linalg.qr(r.normal(size=(d, dims)))[0]
        p = p / (6 * ((sample - mean) @ p).std(0) + 1e-12)  # three deviations each way are the unit cube
        projections.append(p)
        shifts.append(0.5 - mean @ p + r.uniform(-0.15, 0.15, dims))
    index = Curves(np.stack(projections), np.stack(shifts), bits)
    n = len(sample)
    window = _window(index, sample, k, recall, queries)
    part = max(2 * k, n // 4)
    quarter = _window(index, sample[:part], k, recall, queries)
    growth = math.log(max(1.0, window / quarter)) / math.log(n / part) + 0.1 if part < n else 1.0
    return replace(index, window=window, rows=n, growth=min(1.0, growth))


def _window(index: Curves, sample: np.ndarray, k: int, recall: float, queries: int) -> float:
    """The rows on either side within which the wanted share of the k nearest of some of the sample's rows lies on some curve."""
    n = len(sample)
    if n < 2:
        return 1.0
    at = np.empty((len(index.shifts), n), np.int64)
    for row, key in zip(at, index.keys(sample)):
        row[np.argsort(key, kind="stable")] = np.arange(n)
    near = []
    for q in range(0, n, max(1, n // queries)):
        dist = ((sample - sample[q]) ** 2).sum(1)
        dist[q] = np.inf
        true = np.argsort(dist, kind="stable")[: min(k, n - 1)]
        near.append(np.abs(at - at[:, [q]]).min(0)[true])  # of each true neighbour the closest it comes on any curve
    return float(np.quantile(np.concatenate(near), recall)) + 1


def dimension(vectors: DataFrame, id_col: str, vector_col: str) -> int:
    """The commonest dimension of the vectors that can be used, the smaller of equals; 0 without any."""
    top = _finite(vectors, id_col, vector_col).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return top["d"] if top else 0


def _finite(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.transform(vector_col, lambda x: x.cast("double"))
    rows = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), v.alias("v"))
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))


def usable(vectors: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """(id, v: array<double>): rows of dims components whose vector isn't null, zero or of null or non-finite components; equal rows once."""
    return _finite(vectors, id_col, vector_col).where(F.size("v") == dims).distinct()


def _codes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as a scale and 8-bit components, and how far at most these are from them."""
    scale = np.abs(v).max(1) / 127
    scale = np.where(scale > 0, scale, 1.0)
    code = np.rint(v / scale[:, None]).astype(np.int8)
    unit = v / scale[:, None]  # in this unit squares don't overflow
    slack = np.sqrt(((unit - code) ** 2).sum(1)) + 1e-7 * np.sqrt((unit**2).sum(1))  # the second part is for rounding
    return scale, code, slack * scale


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = 4096, curves: int = 16, recall: float = 0.96) -> DataFrame:
    """(query_id, rank, id, score): of each query row its k nearest other rows by Euclidean distance, as far as the windows show them.

    queries: rows of the same columns, all of which are rows of vectors too. Ties go to smaller ids. Rows that usable() leaves out, and
    vectors and queries of other than the commonest dimension of vectors, take no part. Rows that repeat count once. With no more
    than k + 1 rows, or an empty table, all that there is comes back. Other columns are left out.
    """
    spark = vectors.sparkSession
    folder = shared_folder(spark, "ann")
    dims = dimension(vectors, id_col, vector_col)
    rows = usable(vectors, id_col, vector_col, dims)
    # Equal vectors: the k + 1 smallest ids can be results, the smallest stands for all.
    by_vector = Window.partitionBy("v")
    members = rows.withColumn("n", F.row_number().over(by_vector.orderBy("id"))).where(F.col("n") <= k + 1)
    members.withColumn("rep", F.min("id").over(by_vector)).write.parquet(f"{folder}/members")
    members = spark.read.parquet(f"{folder}/members")
    reps = members.where("n = 1").select("rep", "v")
    asked = cut(usable(queries, id_col, vector_col, dims).join(reps, "v").select(F.col("id").alias("query_id"), "rep"))

    sample = reps.orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).toArrow()  # bounded by sample_rows
    if not sample.num_rows:
        return asked.select("query_id", F.lit(0).alias("rank"), F.col("rep").alias("id"), F.lit(0.0).alias("score")).limit(0)
    index = fit(_matrix(sample.column("v").combine_chunks()), curves=curves, recall=recall, k=k)
    total = reps.count()
    half = index.half(total)
    shared = spark.sparkContext.broadcast(index)

    def keyed(batches):
        for b in batches:
            v = _matrix(b.column(1))
            if not len(v):
                continue
            scale, code, slack = _codes(v)
            codes = pa.array([x.tobytes() for x in code], pa.binary())
            for c, key in enumerate(shared.value.keys(v)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c, np.int32)), pa.array(key), b.column(0), pa.array(scale), pa.array(slack), codes], ["curve", "key", "rep", "scale", "slack", "code"])

    def numbered(batches):
        part, curve, n = TaskContext.get().partitionId(), -1, 0
        for b in batches:
            c = b.column(0).to_numpy()
            place = np.empty(len(c), np.int64)
            for at in np.split(np.arange(len(c)), np.flatnonzero(np.diff(c)) + 1) if len(c) else ():
                if c[at[0]] != curve:
                    curve, n = c[at[0]], 0
                place[at] = np.arange(n, n + len(at))
                n += len(at)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(c), part, np.int32)), pa.array(place), *(b.column(x) for x in (2, 3, 4, 5))], ["curve", "part", "place", "rep", "scale", "slack", "code"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = reps.mapInArrow(keyed, f"curve int, key long, rep {dict(reps.dtypes)['rep']}, scale double, slack double, code binary")
    ordered = keys.repartitionByRange(parts, "curve", "key", "rep").sortWithinPartitions("curve", "key", "rep")
    ordered.mapInArrow(numbered, f"curve int, part int, place long, rep {dict(reps.dtypes)['rep']}, scale double, slack double, code binary").write.parquet(f"{folder}/curves")
    ordered = spark.read.parquet(f"{folder}/curves")
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("curve", "part").count().select("curve", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    # a row for each partition and curve that meet: no more than partitions and curves together
    placed = ordered.join(F.broadcast(starts), ["curve", "part"]).select("curve", (F.col("start") + F.col("place")).alias("place"), "rep", "scale", "slack", "code")
    held = placed.select("curve", F.expr(f"place div {BLOCK}").alias("block"), F.lit(0).alias("kind"), "place", "rep", "scale", "slack", "code")
    probes = placed.join(asked.select("rep").distinct(), "rep", "left_semi")
    reach = F.sequence(F.expr(f"greatest(place - {half}, 0) div {BLOCK}"), F.expr(f"least(place + {half}, {total - 1}) div {BLOCK}"))
    probes = probes.select("curve", F.explode(reach).alias("block"), F.lit(1).alias("kind"), "place", "rep", "scale", "slack", "code")
    met = held.unionByName(probes).repartition(parts, "curve", "block").sortWithinPartitions("curve", "block", "kind")
    kind_of_code = np.float32 if dims <= 1000 else np.float64  # sums of products of codes are exact in either
    kind = dict(reps.dtypes)["rep"]

    def windows(batches):
        """Of each block first its rows come, then the queries that look at it."""
        at, rows_, block = None, [], None
        for b in batches:
            groups = np.stack([b.column(0).to_numpy().astype(np.int64), b.column(1).to_numpy()], 1)
            kinds, places, scales, slacks, reps_ = (b.column(x).to_numpy() for x in (2, 3, 5, 6, 4))
            codes = np.frombuffer(b"".join(b.column(7).to_pylist()), np.int8).reshape(len(kinds), -1) if len(kinds) else np.zeros((0, 1), np.int8)
            edges = np.flatnonzero((np.diff(groups, axis=0) != 0).any(1) | (np.diff(kinds) != 0)) + 1
            for own in np.split(np.arange(len(kinds)), edges) if len(kinds) else ():
                if tuple(groups[own[0]]) != at:
                    at, rows_, block = tuple(groups[own[0]]), [], None
                mine = places[own], reps_[own], scales[own], codes[own].astype(kind_of_code), slacks[own]
                if kinds[own[0]] == 0:
                    rows_.append(mine)
                    continue
                if block is None:
                    block = [np.concatenate(x) for x in zip(*rows_)] if rows_ else None
                    if block is None:
                        continue
                    square = (block[3] ** 2).sum(1) * block[2] ** 2
                for lo in range(0, len(own), 256):
                    p, r, s, c, e = (x[lo : lo + 256] for x in mine)
                    dist = square[None, :] + ((c**2).sum(1) * s**2)[:, None] - 2 * (c @ block[3].T) * s[:, None] * block[2][None, :]
                    dist = np.sqrt(np.maximum(dist, 0))
                    off = e[:, None] + block[4][None, :]
                    least, most = dist - off, dist + off
                    if not np.isfinite(dist).all():  # squares that overflow say nothing
                        least[~np.isfinite(dist)], most[~np.isfinite(dist)] = 0, np.inf
                    outside = np.abs(block[0][None, :] - p[:, None]) > half
                    most[outside] = np.inf
                    m = min(k + 1, most.shape[1])
                    bound = np.partition(most, m - 1, axis=1)[:, m - 1]  # so many rows are no farther
                    q, at_ = np.nonzero((least <= bound[:, None]) & ~outside)
                    for x in range(0, len(q), 65536):
                        i, j = q[x : x + 65536], at_[x : x + 65536]
                        yield pa.RecordBatch.from_arrays([pa.array(r[i]), pa.array(block[1][j]), pa.array(least[i, j]), pa.array(most[i, j])], ["asked", "rep", "least", "most"])

    pairs = met.mapInArrow(windows, f"asked {kind}, rep {kind}, least double, most double")
    pairs = pairs.groupBy("asked", "rep").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    of_query = Window.partitionBy("asked")
    pairs = pairs.withColumn("n", F.row_number().over(of_query.orderBy("most", "rep"))).withColumn("bound", F.max(F.when(F.col("n") <= k + 1, F.col("most"))).over(of_query))
    pairs = pairs.where("least <= bound").select("asked", "rep")
    exact = pairs.join(reps, "rep").join(reps.select(F.col("rep").alias("asked"), F.col("v").alias("q")), "asked")
    square = F.aggregate(F.zip_with("v", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    exact = exact.select("asked", "rep", F.sqrt(square).alias("score")).join(members.select("rep", "id"), "rep")
    best = exact.withColumn("n", F.row_number().over(Window.partitionBy("asked").orderBy("score", "id"))).where(F.col("n") <= k + 1)
    best = cut(best.select(F.col("asked").alias("rep"), "id", "score"))
    found = asked.join(best, "rep").where(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
