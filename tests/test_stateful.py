"""Stateful streams give the rows of the batch operators for any cut into micro-batches, over restarts, and forget what is over."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.operators import events, history
from tidemark.plans import ingestion, points
from tidemark.plans.base import COOLDOWN, FRESH, NOW, SPIKES, bounds
from tidemark.plans.sequences import ranges
from tidemark.sources import readings
from tidemark.streaming import jobs, stateful

COLUMNS = ["sequence", "outcome", "reason", "class", "suspicious", "persist_reading", "update_latest", "to_learning"]


def write_parts(spark, rows, folder, bounds):
    """The rows between bounds of their times, a folder for each part."""
    out = []
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        rows.where((F.col("t") >= a) & (F.col("t") < b)).coalesce(1).write.mode("append").parquet(f"{folder}/part={k}")
        out.append(f"{folder}/part={k}")
    return out


def run_part(spark, part, make, tmp_path):
    """One run of the stream over one more part, with the checkpoint of the runs before."""
    given = tmp_path / "given"
    spark.read.parquet(part).write.mode("append").parquet(str(given))
    s = spark.readStream.schema(spark.read.parquet(part).schema).parquet(str(given))
    q = make(s).writeStream.foreachBatch(jobs.write_once(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


@pytest.fixture(scope="module")
def arrivals(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("arrivals") / "rows")
    ingestion.arrivals(spark, sf_dir).select("sensor_id", "sensor_type", "value", "t", "sent", "received", "sequence").where("sensor_id % 5 = 1").write.parquet(folder)
    return spark.read.parquet(folder)


def cuts_of(rows, n, seed):
    times = sorted({r["t"] for r in rows.select("t").collect()})
    return [0, *sorted(random.Random(seed).sample(times, n - 1)), 2**62]


def as_set(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.select(COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("seed,n", [(0, 2), (1, 4)])
def test_routed_stream_equals_batch(spark, sf_dir, arrivals, tmp_path, seed, n):
    bounds = ranges(spark, sf_dir)
    want = ingestion.routed(arrivals, bounds, SPIKES, NOW, FRESH, COOLDOWN)
    for part in write_parts(spark, arrivals, str(tmp_path / "parts"), cuts_of(arrivals, n, seed)):
        run_part(spark, part, lambda s: stateful.routed(s, bounds, SPIKES, NOW, FRESH, COOLDOWN), tmp_path)
    assert as_set(spark.read.parquet(str(tmp_path / "out"))) == as_set(want)
    assert {r["reason"] for r in want.select("reason").distinct().collect()} >= {"warming_up", "clean"}


def test_stream_begins_where_a_batch_ended(spark, sf_dir, arrivals, tmp_path):
    # without repeats: the batch hands over what the path of a sensor holds, not which readings it has seen
    once = arrivals.where(f"sequence < {ingestion.COPY} and value is not null and not isnan(value) and abs(value) < 1e9 and sent = t")
    bounds, middle = ranges(spark, sf_dir), cuts_of(once, 2, 3)[1]
    args = (bounds, SPIKES, FRESH, COOLDOWN)
    left = events.left_behind(once.where(F.col("t") < middle), *args)
    (later,) = write_parts(spark, once, str(tmp_path / "parts"), [middle, 2**62])
    run_part(spark, later, lambda s: stateful.routed(s, bounds, SPIKES, NOW, FRESH, COOLDOWN, initial=left), tmp_path)
    want = ingestion.routed(once, bounds, SPIKES, NOW, FRESH, COOLDOWN).where(F.col("t") >= middle)
    assert as_set(spark.read.parquet(str(tmp_path / "out"))) == as_set(want)


def test_limiter_equals_batch_and_forgets(spark, tmp_path):
    r = random.Random(4)
    calls = sorted({(r.choice(["a", "a", "a", "b", "c"]), r.randrange(0, 1200) * K.SECOND // 4, i) for i in range(600)}, key=lambda x: x[1])
    df = spark.createDataFrame(calls, "k string, t long, sequence long")
    want = history.rate_limited(df, ["k"], "t", ["t", "sequence"], 20)
    for part in write_parts(spark, df, str(tmp_path / "parts"), [0, 70 * K.SECOND, 71 * K.SECOND, 2**62]):
        run_part(spark, part, lambda s: stateful.rate_limited(s, "k", "t", 20), tmp_path)
    got = spark.read.parquet(str(tmp_path / "out"))
    rows = lambda d: sorted((x["sequence"], x["approx"], x["allowed"]) for x in d.collect())
    assert rows(got) == rows(want) and not want.where("allowed").isEmpty() and not want.where("not allowed").isEmpty()
    # an hour later other keys call: what was held is forgotten, twice the watermark having moved on
    for k in range(2):
        spark.createDataFrame([("z", (3600 + 600 * k) * K.SECOND, 10_000 + k)], "k string, t long, sequence long").write.parquet(str(tmp_path / f"late{k}"))
        q = run_part(spark, str(tmp_path / f"late{k}"), lambda s: stateful.rate_limited(s, "k", "t", 20), tmp_path)
    held = spark.read.format("statestore").option("stateVarName", "buckets").load(str(tmp_path / "ck"))
    assert {x["key"]["k"] if "k" in x["key"] else x["key"][0] for x in held.collect()} == {"z"}
    assert q.exception() is None
    with pytest.raises(ValueError):
        stateful.rate_limited(df, "k", "t", 20, window_seconds=200)


def told(df):
    return sorted((tuple(r) for r in df.select("sequence", "previous_value", "violated_constraint", "classification").collect()), key=repr)


@pytest.mark.parametrize("seed,n", [(2, 2), (3, 4)])
def test_points_are_classified_alike_for_any_cut(spark, sf_dir, tmp_path, seed, n):
    spark.catalog.clearCache()
    rows = readings.event_points(spark, sf_dir).where("sequence % 3 = 0")
    path = str(tmp_path / "rows")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    good = rows.where("value is not null and not isnan(value)").dropDuplicates(["series_id", "t"])
    want = points.classified(good, bounds(spark))
    for part in write_parts(spark, rows, str(tmp_path / "parts"), cuts_of(rows, n, seed)):
        run_part(spark, part, lambda s: stateful.ingested(s, bounds(spark)), tmp_path)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert told(got.where("error is null")) == told(want) and want.where("previous_value is not null").count() > 0
    assert got.where("error is not null").count() == rows.where("value is null or isnan(value)").count()


def test_repeats_and_odd_points_over_micro_batches(spark, tmp_path):
    second = 1_000_000
    kind = "series_id string, domain string, stream_id string, value double, t long, sequence long"
    domain, stream, mid = "infrastructure", "cpu", 40.0
    limits = [1000.0 if c == "critical_max" else 5.0 if c == "max_abs_delta" else None for c in K.BOUNDS]
    config = spark.createDataFrame([(domain, stream, *limits)], "domain string, stream_id string, " + ", ".join(f"{c} double" for c in K.BOUNDS))
    point = lambda value, t, sequence, **more: tuple(({"s": "x", "d": domain, "st": stream} | more).values()) + (value, None if t is None else 10**9 + t, sequence)
    parts = [
        [point(mid, 0, 1), point(mid, second, 2), point(None, second, 3), point(mid, None, 4), point(mid, 0, 5, d="IoT")],
        [point(mid + 1, second, 6), point(1e12, 2 * second, 7), point(mid, 5 * second, 9), point(mid, 3 * second, 8)],  # a repeat, a broken bound, out of order
        [point(mid, 7200 * second, 10)],  # the watermark passes all before
        [point(mid, 2 * second, 11), point(mid, 7201 * second, 12), point(mid, 1 * second, 13, s="late")],  # too late: both go
    ]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        run_part(spark, str(tmp_path / f"in{k}"), lambda s: stateful.ingested(s, config), tmp_path)
    got = {r["sequence"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {k: r["error"] for k, r in got.items() if r["error"]}.keys() == {3, 4, 5} and got[4]["error"] == "missing_timestamp"
    assert {k: r["previous_value"] for k, r in got.items() if not r["error"]} == {1: None, 2: mid, 7: None, 8: mid, 9: mid, 10: mid, 12: mid}
