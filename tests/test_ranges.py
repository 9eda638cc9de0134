"""Scans over ranges give what one task gives for each key, however keys and batches fall."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.operators import folds, history, ranges

KIND = "k string, t long, sequence long, severity string, wanted boolean, value double"


def rows(seed, n=3000, step=40):
    """One key holds most rows; others are short; times repeat and some are missing."""
    r, out = random.Random(seed), []
    for i in range(n):
        key = r.choices(["hot", "b", "c", None, "z"], [80, 5, 5, 5, 5])[0]
        t = None if r.random() < 0.02 else r.randrange(n // step) * K.SECOND
        out.append((key, t, i, r.choices([None, "warning", "critical", "CRITICAL", ""], [40, 40, 5, 5, 10])[0], r.random() < 0.7, None if r.random() < 0.3 else float(i)))
    return out


def spaced_one_by_one(data, gap, only):
    last, told = {}, {}
    for k, t, s, _, wanted, _ in sorted(data, key=lambda x: (str(x[0]), x[1] is not None, x[1] or 0, x[2])):
        if only and not wanted:
            told[s] = False
        elif t is None:
            told[s] = True
        else:
            told[s] = k not in last or t - last[k] >= gap * K.SECOND
            last[k] = t if told[s] else last[k]
    return told


def states_one_by_one(data, warm_up):
    held, told = {}, {}
    for k, _, s, severity, _, _ in sorted(data, key=lambda x: (str(x[0]), x[2])):
        mode, n = held.get(k, ("INITIALIZING", 0))
        n += 1
        mode = "NORMAL" if mode == "INITIALIZING" and n >= warm_up else mode
        if mode != "INITIALIZING":
            target = "ALERT" if (severity or "").lower() == "critical" else "WARNING" if severity else "NORMAL"
            mode = mode if (mode, target) == ("ALERT", "WARNING") else target
        held[k], told[s] = (mode, n), mode
    return told


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 97)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("seed,gap,only,parts", [(0, 7, False, 9), (1, 1, True, 5), (2, 100, False, 9), (3, 0, True, 3), (4, 23, True, 16)])
def test_spacing(spark, small_batches, seed, gap, only, parts):
    data = rows(seed)
    df = spark.createDataFrame(data, KIND)
    want = spaced_one_by_one(data, gap, only)
    scan = ranges.Spaced("t", gap * K.SECOND, "wanted" if only else None)
    got = ranges.scanned(df, ["k"], ["t", "sequence"], scan, "accepted", "boolean", parts)
    lying = got.groupBy(F.col("k"), F.spark_partition_id()).count().groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in lying}["hot"] > 1  # the hot key lies in several tasks
    assert {r["sequence"]: r["accepted"] for r in got.collect()} == want
    plain = folds.spaced(df, ["k"], "t", gap, ["t", "sequence"], only="wanted" if only else None)
    assert {r["sequence"]: r["accepted"] for r in plain.collect()} == want


def test_spacing_by_size(spark):
    data = rows(7, 800)
    got = folds.spaced(spark.createDataFrame(data, KIND), ["k"], "t", 5, ["t", "sequence"], most_rows=200)
    assert got.columns[-1] == "accepted" and {r["sequence"]: r["accepted"] for r in got.collect()} == spaced_one_by_one(data, 5, False)


def test_long_gaps_over_many_ranges(spark, small_batches):
    """The gap spans several ranges, so most of them accept nothing and only hand the time on."""
    df = spark.range(4000).select(F.lit(1).alias("k"), (F.col("id") * K.SECOND).alias("t"), F.col("id").alias("sequence"))
    got = ranges.scanned(df, ["k"], ["t", "sequence"], ranges.Spaced("t", 1500 * K.SECOND), "accepted", "boolean", 12)
    assert [r["sequence"] for r in got.where("accepted").orderBy("t").collect()] == [0, 1500, 3000]


@pytest.mark.parametrize("seed,warm_up", [(0, 10), (1, 1), (2, 0), (3, 500)])
def test_states(spark, small_batches, seed, warm_up):
    data = rows(seed)
    df = spark.createDataFrame(data, KIND)
    want = states_one_by_one(data, warm_up)
    for most in (None, 100):
        got = folds.states(df, ["k"], "severity", ["sequence"], warm_up, most_rows=most)
        assert {r["sequence"]: r["state"] for r in got.collect()} == want


def test_any_automaton(spark, small_batches):
    r = np.random.default_rng(3)
    step = r.integers(0, 6, (4, 6))
    df = spark.range(2000).select((F.col("id") % 100 >= 90).alias("k"), F.col("id"), F.pmod(F.xxhash64("id"), F.lit(4)).cast("int").alias("s"))
    got = ranges.scanned(df, ["k"], ["id"], ranges.Automaton("s", step, 2, list("abcdef")), "state", "string", 8)
    held = {True: 2, False: 2}
    for x in got.orderBy("id").collect():
        held[x["k"]] = int(step[x["s"], held[x["k"]]])
        assert x["state"] == "abcdef"[held[x["k"]]]


def as_of_one_by_one(events, readings):
    told = {}
    for k, at, i in events:
        later = [(t, s, v) for key, t, s, _, _, v in readings if key == k and t is not None and v is not None and t > at]
        told[i] = min(later)[2] if later else None
    return told


def test_as_of_forward(spark, small_batches):
    data = [x for x in rows(11, 1500) if x[0] is not None and x[1] is not None]
    r = random.Random(2)
    asked = [(x[0], x[1] + r.choice([0, 0, 1, -1]) * K.SECOND, i) for i, x in enumerate(r.sample(data, 400))] + [("none", 5, 1000)]
    events, readings = spark.createDataFrame(asked, "k string, at long, id long"), spark.createDataFrame(data, KIND)
    want = as_of_one_by_one(asked, data)
    for most in (None, 100):
        got = history.as_of_forward(events, readings, "k", "at", "t", "value", ties="sequence", most_rows=most, parts=7)
        assert {x["id"]: x["actual"] for x in got.collect()} == want


def test_as_of_forward_of_one_large_key(spark):
    n = 1_000_000
    readings = spark.range(n).select(F.lit("s").alias("k"), (F.col("id") * 10).alias("t"), F.col("id").cast("double").alias("value"))
    events = spark.range(0, n, 1000).select(F.lit("s").alias("k"), (F.col("id") * 10).alias("at"), "id")
    for most in (10 * n, 1000):
        got = history.as_of_forward(events, readings, "k", "at", "t", "value", most_rows=most)
        assert got.where(F.col("actual") == F.col("id") + 1).count() == n // 1000


def test_empty_and_only_nulls(spark):
    empty = spark.createDataFrame([], KIND)
    assert ranges.scanned(empty, ["k"], ["t", "sequence"], ranges.Spaced("t", 5), "accepted", "boolean").collect() == []
    nulls = spark.createDataFrame([("a", None, 1, None, None, None)] * 3, KIND)
    got = ranges.scanned(nulls, ["k"], ["t", "sequence"], ranges.Spaced("t", 5, "wanted"), "accepted", "boolean")
    assert [x["accepted"] for x in got.collect()] == [False] * 3
