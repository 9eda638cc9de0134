"""Commits: whole or not at all, once, and told apart."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.sources import tables
from tidemark.operators import predict
from tidemark.sources.snapshots import Conflict, FileStatistics, SnapshotTable, writing


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_repeated_and_broken_batches(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}/t")
    with pytest.raises(ValueError):
        t.read()
    assert t.write(spark.range(3), 10, "job", 0) == 1
    assert t.write(spark.range(3), 11, "job", 0) == 1 and t.read().count() == 3  # the same batch again
    bad = spark.range(4).select(F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("broken"))).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        t.write(bad, 12, "job", 1)
    assert t.version() == 1 and t.read().count() == 3  # nothing of it is seen
    assert t.write(spark.range(3, 5), 13, "job", 1) == 2 and t.write(spark.range(9, 10), 14, "other", 0) == 3
    assert rows_of(t.read(), "id") == [(0,), (1,), (2,), (3,), (4,), (9,)] and t.read(1).count() == 3
    assert t.compacted(20) == 4 and len(t.manifest()["parts"]) == 1 and t.read().count() == 6 and t.read(2).count() == 5
    assert t.write(spark.range(3), 15, "job", 1) == 4  # batches are remembered over compaction


def test_upserts_and_times(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}/t", ["k"])
    kind = "k int, v string"
    t.write(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], kind), 100)
    t.write(spark.createDataFrame([(2, "c"), (4, "d")], kind), 200)
    want = [(1, "a", 100, 100), (2, "c", 100, 200), (3, "", 100, 100), (4, "d", 200, 200)]
    seen = lambda: rows_of(t.read().fillna("", ["v"]), "k", "v", "created_at", "updated_at")
    assert seen() == want
    t.compacted(250)
    assert seen() == want
    t.write(spark.createDataFrame([(3, "e")], kind), 300)
    assert seen() == [want[0], want[1], (3, "e", 100, 300), want[3]]


def test_writers_at_once_all_count(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}/t")
    t.write(spark.range(1), 1)
    errors = []

    def work(k):
        try:
            for n in range(3):
                SnapshotTable(spark, f"file://{tmp_path}/t").write(spark.range(100 * k + 10 * n, 100 * k + 10 * n + 2), k, f"w{k}", n)
        except Exception as e:  # told in the main thread
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(1, 5)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not errors and t.version() == 13 and t.read().count() == 1 + 4 * 3 * 2
    assert len(set(map(tuple, (p for p in t.manifest()["parts"])))) == 13


def test_a_taken_version_is_never_written_over(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}/t")
    t.write(spark.range(1), 1)
    held = t.manifest(1)
    assert not t._commit(1, {"parts": [], "batches": {}}) and t.manifest(1) == held


def test_compaction_keeps_what_comes_meanwhile(spark, tmp_path, monkeypatch):
    t = SnapshotTable(spark, f"file://{tmp_path}/t", ["id"])
    t.write(spark.range(3), 1)
    t.write(spark.range(2, 4), 2)
    plain = t._write
    monkeypatch.setattr(t, "_write", lambda rows: (SnapshotTable(spark, t.folder, ["id"]).write(spark.range(7, 8), 3), plain(rows))[1])
    t.compacted(4)
    assert rows_of(t.read(), "id", "updated_at") == [(0, 1), (1, 1), (2, 2), (3, 2), (7, 3)]
    monkeypatch.setattr(t, "_write", lambda rows: (SnapshotTable(spark, t.folder, ["id"]).compacted(5), plain(rows))[1])
    with pytest.raises(Conflict):
        t.compacted(6)
    assert t.read().count() == 5


def test_stream_into_commits(spark, tmp_path):
    kind = "t long, v long"
    t = SnapshotTable(spark, f"file://{tmp_path}/t")
    for k in range(2):
        spark.createDataFrame([(10 * k + i, i) for i in range(5)], kind).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        s.writeStream.foreachBatch(writing(t, "stream")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert t.read().count() == 10
    writing(t, "stream")(spark.createDataFrame([(1, 1)], kind), 1)  # a batch that runs again after a loss
    assert t.read().count() == 10


def test_stored_tables(spark):
    rows = [("s", "a", "finance", 1.0, "x"), (None, "a", "finance", 1.0, "x"), ("s", "a", "f" * 51, 1.0, None), ("s", "a", "finance", float("nan"), "x"), ("s", "a", "finance", None, "x")]
    df = spark.createDataFrame(rows, "stream_id string, source_id string, domain string, value double, extra string").withColumn("timestamp", F.lit("2024-01-01 00:00:00"))
    t = tables.DATA_POINTS
    told = t.conformed(df, F.timestamp_micros(F.lit(5))).withColumn("error", t.broken())
    assert [r["error"] for r in told.collect()] == [None, "stream_id is null", "domain is longer than 50", "value isn't finite", "value is null"]
    assert {r["classification"] for r in told.collect()} == {"normal"} and "extra" in told.columns
    assert [f.name for f in t.schema()] == told.columns[: len(t.columns)] and not t.schema()["value"].nullable
    keys = spark.createDataFrame([("h", "p", "admin", None), ("h", "p", "source_writer", None), ("h", "p", "root", None), ("h", "p", None, "s")], "key_hash string, key_prefix string, role string, allowed_source_id string")
    told = tables.API_KEYS.conformed(keys, F.current_timestamp()).withColumn("error", tables.API_KEYS.broken())
    assert [r["error"] for r in told.collect()] == [None, "breaks chk_admin_permissions", "breaks chk_role", None]
    assert all(x.schema() for x in tables.TABLES.values())


READING = "sensor_id int, t long, sequence long, value double"


def opened(df):
    """The files that a plan's scans open."""
    return {f for f in df.inputFiles()}


def test_newest_rows_are_in_the_files_that_are_opened(spark, tmp_path):
    rng = random.Random(3)
    t = SnapshotTable(spark, f"file://{tmp_path}/t", statistics=FileStatistics(files=3))
    with pytest.raises(ValueError, match="no commit"):
        t.file_statistics()
    rows = []
    for batch in range(6):  # times overlap between commits, tie, lack, and values are null or NaN now and then
        own = [(rng.randrange(8), rng.choice([None, *range(10 * batch, 10 * batch + 14)]), 1000 * batch + n, rng.choice([None, float("nan"), 1.0, 2.5, 7.0])) for n in range(60)]
        own += [(99, batch, 1000 * batch + 500, 4.0)] if batch < 2 else []
        rows += own
        t.write(spark.createDataFrame(own, READING), batch, "w", batch)
    everything = spark.createDataFrame(rows, READING)
    for n in (1, 7, 60):
        for sensors in ([0, 3], [7, 99], list(range(8))):
            wanted = spark.createDataFrame([(s,) for s in sensors], "sensor_id int")
            some, whole = t.newest(wanted, n), everything.join(wanted, "sensor_id", "left_semi")
            means = [rows_of(predict.moving_average(x.join(wanted, "sensor_id", "left_semi"), n, 1), "sensor_id", "n", "predicted_value") for x in (some, whole)]
            assert means[0] == means[1], (n, sensors)
    assert t.newest(spark.createDataFrame([(1234,)], "sensor_id int"), 5).count() == 0


def test_a_cycle_with_little_news_opens_only_files_with_news(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}/t", statistics=FileStatistics(files=3))
    for batch in range(5):
        t.write(spark.createDataFrame([(s, 1000 * batch + k, 1000 * batch + 100 * s + k, float(s)) for s in range(9) for k in range(20)], READING), batch, "w", batch)
    t.write(spark.createDataFrame([(4, 9000 + k, 9000 + k, 50.0) for k in range(3)], READING), 9, "w", 9)
    offsets = spark.createDataFrame([(s, 4000 + 100 * s + 19) for s in range(9)], "sensor_id int, last long")
    news = predict.pending(t.file_statistics().select("sensor_id", F.col("newest").alias("sequence")), offsets)
    assert rows_of(news, "sensor_id", "last", "newest") == [(4, 4419, 9002)]
    seen, all_files = opened(t.newest(news, 3)), opened(t.read())
    assert len(all_files) > 10 and seen and all(f in all_files for f in seen)
    assert all(f"/{t.manifest()['parts'][-1][0]}/" in f for f in seen)  # the last commit holds three of it
    more = t.newest(news, 5)  # two of them are in the commit before, of it only files that hold the sensor
    assert len(opened(more)) < len(opened(t.read())) / 2 and more.where("sensor_id = 4").count() >= 5
    bands = spark.createDataFrame([(41, 4, "out_of_range", 0.0, 20.0, "critical")], "id int, sensor_id int, condition_type string, low double, high double, severity string")
    none = spark.createDataFrame([], "sensor_id int, event_code string, status string, created_t long")
    models = spark.createDataFrame([(4, 7)], "sensor_id int, model_id long")
    out = predict.cycle_from_files(t, offsets, models, bands, none, 10_000, 3)
    assert [tuple(r) for r in out.select("sensor_id", "model_id", "predicted_value", "offset_before", "offset_after", "threshold_id", "event_type").collect()] == [(4, 7, 50.0, 4419, 9002, 41, "critical")]
    again = out.select("sensor_id", F.col("offset_after").alias("last")).unionByName(offsets.where("sensor_id <> 4"))
    assert predict.cycle_from_files(t, again, models, bands, none, 10_000, 3).count() == 0  # no news, nothing to do
    t.compacted(11)
    assert predict.cycle_from_files(t, offsets, models, bands, none, 10_000, 3).first()["predicted_value"] == 50.0
