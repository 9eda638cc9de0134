"""Neighbours and top-k against brute force, with the cases that have a defined result of their own."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, queries, topk

KIND = "vec_id long, embedding array<float>, extra string"


def vectors(n=400, d=12, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(20, d))
    v = (centres[r.integers(0, 20, n)] + 0.3 * r.normal(size=(n, d))).astype(np.float32)
    v[5:60] = v[4]  # a hot vector
    return [(i, [float(x) for x in row], "x") for i, row in enumerate(v)]


ODD = [(1000, None, None), (1100, [0.0] * 12, None), (1200, [float("nan")] + [1.0] * 11, None), (1300, [None] + [1.0] * 11, None), (1400, [float("inf")] * 12, None), (None, [1.0] * 12, None), (1500, [1.0], None)]


def brute(rows, query, k):
    x = {i: np.array(v, np.float64) for i, v, _ in rows}
    near = sorted((float(np.sqrt(((x[i] - x[query]) ** 2).sum())), i) for i in x if i != query)
    return near[:k]


def test_ann_recall_and_ties(spark):
    rows = vectors()
    df = spark.createDataFrame(rows + ODD, KIND)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), k=10, id_col="vec_id").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    assert set(got) == set(range(0, 400, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, 11))
        want = brute(rows, q, 10)
        hits += len({i for _, i in want} & {x[1] for x in found})
        assert all(a[2] <= b[2] and (a[2] < b[2] or a[1] < b[1]) for a, b in zip(found, found[1:]))
    assert hits / (10 * len(got)) >= 0.9
    assert [(x[1], x[2]) for x in got[20]] == [(i, 0.0) for i in range(4, 14)]  # of the hot vector the smallest ids


def test_ann_small(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], ""), (1, [0.0, 1.0], ""), (1, [0.0, 1.0], "again")], KIND)
    assert [(r["query_id"], r["rank"], r["id"]) for r in ann.nearest(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    one = df.where("vec_id = 0")
    assert ann.nearest(one, one).count() == 0


def test_ann_whole_where_codes_say_little(spark):
    """One component takes all 8 bits, so codes tell no rows apart; the windows hold the whole table."""
    r = np.random.default_rng(5)
    v = np.c_[np.full(250, 1e4), r.normal(size=(250, 11))].astype(np.float32)
    rows = [(i, [float(x) for x in row], "") for i, row in enumerate(v)]
    df = spark.createDataFrame(rows, KIND)
    got = {}
    for x in ann.nearest(df, df.where("vec_id % 25 = 0"), k=10).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["id"]))
    assert {q: [i for _, i in sorted(f)] for q, f in got.items()} == {q: [i for _, i in brute(rows, q, 10)] for q in range(0, 250, 25)}
    huge = spark.createDataFrame([(i, [1e200 * (i + 1), 1.0], "") for i in range(5)], "vec_id long, embedding array<double>, extra string")
    assert ann.nearest(huge, huge.where("vec_id = 0"), k=3).count() == 3


def test_hilbert_is_a_walk():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        key = ann.hilbert_keys(cells, bits)
        order = cells[np.argsort(key)]
        assert sorted(key) == list(range(len(cells)))
        assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_top_k_against_brute_force(spark):
    rows = [(i, [int(x * 64) for x in v], e) for i, v, e in vectors()]
    more = [(900, None, ""), (901, [None] + [1] * 11, ""), (None, [1] * 12, ""), (902, [5], ""), rows[3]]
    df = spark.createDataFrame(rows + more, "vec_id long, vector array<long>, extra string")
    x = np.array([v for _, v, _ in rows])
    for group_rows in (64, 32_768):
        got = {}
        for r in topk.top_k(df, df.where("vec_id % 40 = 0"), k=20, pivots=8, group_rows=group_rows).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
        for q in range(0, 400, 40):
            score = x @ x[q]
            want = sorted((-int(s), i) for i, s in enumerate(score) if i != q)[:20]
            assert [(-s, i) for _, i, s in sorted(got[q])] == want


def test_pivots_save_work():
    r = np.random.default_rng(1)
    x = np.rint(r.normal(size=(5000, 3)) * 1000)
    x = np.rint(x / np.linalg.norm(x, axis=1)[:, None] * 1000)  # of one length: the bound tells near from far
    t = topk.PivotTable(np.arange(5000), x, topk.choose_pivots(x[:500], 16))
    t.search(np.arange(1), x[:1], 5)
    assert t.evaluated < 1000
    x = np.rint(r.normal(size=(20000, 64)) * 8).astype(np.int64)  # no structure at all
    t = topk.PivotTable(np.arange(20000), x, topk.choose_pivots(x[:2000].astype(float), 56))
    for q, got in zip(range(20), t.search(np.arange(20), x[:20], 20)):
        assert got == [(i, -s) for s, i in sorted((-int(s), i) for i, s in enumerate(x @ x[q]) if i != q)[:20]]
    assert t.evaluated < 0.1 * 20 * 20000


def test_top_k_limits(spark):
    df = spark.createDataFrame([(0, [1, 2]), (1, [3, 4])], "vec_id long, vector array<long>")
    assert [tuple(r) for r in topk.top_k(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 11)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    big = spark.createDataFrame([(0, [3 << 29, 1]), (1, [1 << 30, 5]), (2, [1 << 30, 6]), (3, [-1, 7])], "vec_id long, vector array<long>")
    assert [tuple(r) for r in topk.top_k(big, big.where("vec_id = 0"), k=2).collect()] == [(0, 1, 2, (3 << 59) + 6), (0, 2, 1, (3 << 59) + 5)]
    assert [r[0] for r in spark.createDataFrame([([-0.01, 0.99],)], "v array<double>").select(topk.scaled("v").alias("x")).collect()] == [[-1, 63]]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    r = con.execute(queries.ORACLE_SQL[name])
    cols = [d[0] for d in r.description]
    assert sorted(map(tuple, queries.queries()[name](spark, sf_dir).select(*cols).collect()), key=repr) == sorted(r.fetchall(), key=repr)


def test_extra_columns_with_clashing_names(spark):
    rows = [(i, v, float(i), i, i, "s") for i, v, _ in vectors(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double, rank int, id long, rep string")
    assert ann.nearest(df, df.where("vec_id = 0"), k=3).count() == 3
    ints = df.withColumn("vector", F.transform("embedding", lambda x: F.floor(x)))
    assert topk.top_k(ints, ints.where("vec_id = 0"), k=3).count() == 3
