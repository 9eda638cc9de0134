"""Exact top-k search by inner product, with pivot-table elimination.

Distances of every row to many pivots are computed once. Together they bound from below how far a row is from a query,
and so from above what their inner product can be, as closely as these distances allow. Rows are evaluated in the order
of that bound until the k-th best score is above the bound of all that are left.
"""

from __future__ import annotations

import heapq
import math
from itertools import chain
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Rows that a task holds while all queries pass by.
GROUP_ROWS = 32_768
#: Queries whose bounds are computed at once.
AT_ONCE = 32


def scaled(vector: str | Column, factor: int = 64) -> Column:
    """floor(factor * x) of each component, as long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(factor))))


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Rows of the sample that are far from each other: each time the one farthest from those chosen."""
    chosen = [int(((sample - sample.mean(0)) ** 2).sum(1).argmax())]
    far = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < pivots and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


class PivotTable:
    """Rows (ids, integer vectors) with what their distances to the pivots say.

    A distance to a pivot gives the inner product with it, and those with all pivots give a row's coordinates in the
    pivots' span and the length of the rest. Two rests have an inner product of at most the product of their lengths: no
    distances to these pivots can bound an inner product more closely.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        pivots = pivots.astype(float)
        turned = np.linalg.qr(pivots.T)[1] if len(pivots) else np.zeros((0, 0))
        diagonal = np.abs(np.diag(turned))
        kept = np.flatnonzero(diagonal > 1e-3 * diagonal.max(initial=0))  # others lie in the span of those before
        self.pivots = pivots[kept]
        self.turn = np.linalg.inv(np.linalg.qr(self.pivots.T)[1]) if len(kept) else np.zeros((0, 0))
        self.pivot_square = (self.pivots**2).sum(1)
        self.square = (self.x.astype(float) ** 2).sum(1)
        self.distances = self._distances(self.x)  # the pivot table
        self.at, self.rest = self._coordinates(self.distances, self.square)
        self.reach = np.sqrt(self.square) + math.sqrt(self.pivot_square.max(initial=0))
        self.evaluated = 0

    def _distances(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        square = (x**2).sum(1)[:, None] + self.pivot_square[None, :] - 2 * (x @ self.pivots.T)
        return np.sqrt(np.clip(square, 0, None))

    def _coordinates(self, distances: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (square[:, None] + self.pivot_square[None, :] - distances**2) / 2 @ self.turn
        return at, np.sqrt(np.clip(square - (at**2).sum(1), 0, None))

    def search(self, own: np.ndarray, q: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """For each query (id, integer vector) the (id, score) of the k rows with the highest scores, ties to smaller ids; rows with the query's own id are no candidates."""
        out = []
        for lo in range(0, len(q), AT_ONCE):
            part = q[lo : lo + AT_ONCE]
            square = (part.astype(float) ** 2).sum(1)
            at, rest = self._coordinates(self._distances(part), square)
            bounds = at @ self.at.T + rest[:, None] * self.rest[None, :]
            bounds += 1e-9 * (np.sqrt(square) + self.reach.max(initial=0))[:, None] * self.reach[None, :]  # rounding
            out += [self._best(int(i), x, most, k) for i, x, most in zip(own[lo : lo + AT_ONCE], part, bounds)]
        return out

    def _best(self, own: int, q: np.ndarray, most: np.ndarray, k: int) -> list[tuple[int, int]]:
        most[np.searchsorted(self.ids, own) : np.searchsorted(self.ids, own, "right")] = -np.inf
        n = int(np.isfinite(most).sum())
        best: list[tuple[int, int]] = []  # (-score, id)
        order, done, step = np.zeros(0, np.int64), 0, 4 * k
        while done < n:
            if done >= len(order):  # the next rows by bound: ever more of them are put in order
                m = min(len(most), 8 * max(step, len(order)))
                top = np.argpartition(-most, m - 1)[:m] if m < len(most) else np.arange(len(most))
                order = top[np.argsort(-most[top], kind="stable")]
            at = order[done : min(done + step, n)]
            if len(best) == k and most[at[0]] < -best[-1][0]:
                break
            if len(best) == k:  # those of the block that can't come in any more
                at = at[: int(np.searchsorted(-most[at], best[-1][0], "right"))]
            done, step = done + len(at), 2 * step
            self.evaluated += len(at)
            score, ids = self._scores(at, q), self.ids[at]
            if len(best) == k:
                good = score >= -best[-1][0]
                score, ids = score[good], ids[good]
            best = heapq.nsmallest(k, chain(best, zip((-score).tolist(), ids.tolist())))
        return [(i, -s) for s, i in best]

    def _scores(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact inner products: in double precision where it holds all sums, in whole numbers of any size else."""
        x = self.x[at]
        if math.sqrt(float((q.astype(float) ** 2).sum()) * self.square[at].max(initial=0)) < 2**52:
            return (x.astype(float) @ q.astype(float)).astype(np.int64)
        return np.array([sum(map(mul, row, q.tolist())) for row in x.tolist()], object)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "vector", pivots: int | None = None, sample_rows: int = 4096, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(query_id, rank, id, score): of each query row the k other rows with the highest inner product, ties to smaller ids.

    vector_col holds integers (array<long>). Null vectors, vectors with a null and rows without an id take no part; vectors of different
    lengths have no inner product, so those of other than the commonest length take no part either. Equal rows count once.
    Scores are exact; one that a long can't hold raises. pivots: by default seven eighths as many as dimensions. All queries
    pass by every group of group_rows rows. An empty table gives an empty one; other columns are left out.
    """
    spark = vectors.sparkSession

    def rows(df: DataFrame) -> DataFrame:
        good = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull())
        return df.where(good).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).distinct()

    held = rows(vectors)
    top = held.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    dims = top["d"] if top else 0
    held = held.where(F.size("v") == dims)
    sample = held.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toArrow().column("v").combine_chunks()  # bounded by sample_rows
    wanted = math.ceil(dims * 7 / 8) if pivots is None else pivots
    chosen = choose_pivots(sample.flatten().to_numpy().astype(float).reshape(len(sample), -1), wanted) if len(sample) and dims else np.zeros((0, dims))
    shared = spark.sparkContext.broadcast(chosen)
    groups = max(spark.sparkContext.defaultParallelism, math.ceil((top["n"] if top else 0) / group_rows))
    here = held.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("kind"), "id", "v")
    asked = rows(queries).where(F.size("v") == dims).select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("kind"), "id", "v")
    met = here.unionByName(asked).repartitionByRange(groups, "g").sortWithinPartitions("g", "kind")

    def search(batches):
        at, parts, pivot_table = None, [], None
        for b in batches:
            g, kind, ids = (b.column(c).to_numpy() for c in range(3))
            if not len(g):
                continue
            v = b.column(3).flatten().to_numpy().reshape(len(g), -1)
            edges = np.flatnonzero((np.diff(g) != 0) | (np.diff(kind) != 0)) + 1
            for own in np.split(np.arange(len(g)), edges):
                if g[own[0]] != at:
                    at, parts, pivot_table = g[own[0]], [], None
                if kind[own[0]] == 0:
                    parts.append((ids[own], v[own]))
                    continue
                if pivot_table is None:
                    if not parts:
                        continue
                    pivot_table = PivotTable(*(np.concatenate(x) for x in zip(*parts)), shared.value)
                out = [(int(i), *hit) for i, hits in zip(ids[own], pivot_table.search(ids[own], v[own], k)) for hit in hits]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["query_id", "id", "score"])

    found = met.mapInArrow(search, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return cut(found).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
