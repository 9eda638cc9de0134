"""Streams give what batches give."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import folds
from tidemark.plans import points
from tidemark.plans.base import bounds
from tidemark.sources import readings
from tidemark.sources.feed import feed
from tidemark.streaming import jobs, stateful


@pytest.fixture(scope="module")
def parts(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("in") / "points")
    readings.event_points(spark, sf_dir).join(readings.event_readings(spark, sf_dir).select("sequence", "sensor_id"), "sequence").orderBy("t").coalesce(1).write.parquet(folder)
    return folder


def stream(spark, folder):
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)


def run(spark, out, tmp_path):
    jobs.drained(out, str(tmp_path / "out"), str(tmp_path / "ck"))
    return spark.read.parquet(str(tmp_path / "out"))


def test_throttle(spark, parts, tmp_path):
    got = run(spark, jobs.throttled(stream(spark, parts), 6 * 3600), tmp_path)
    want = folds.spaced(spark.read.parquet(parts), ["sensor_id"], "t", 6 * 3600, ["t", "sequence"]).where("accepted")
    assert sorted(r[0] for r in got.select("sequence").collect()) == sorted(r[0] for r in want.select("sequence").collect())


def test_classify(spark, parts, tmp_path):
    got = run(spark, jobs.classified(stream(spark, parts), bounds(spark)), tmp_path)
    want = points.classified(spark.read.parquet(parts), bounds(spark))
    cols = ["sequence", "previous_value", "classification"]
    assert sorted(map(tuple, got.select(cols).collect()), key=repr) == sorted(map(tuple, want.select(cols).collect()), key=repr)


def test_windows_and_dedup(spark, parts, tmp_path):
    s = jobs.timed(stream(spark, parts))
    got = run(spark, jobs.deduplicated(s, ["series_id", "t"]), tmp_path)
    assert got.count() == spark.read.parquet(parts).select("series_id", "t").distinct().count()
    counts = jobs.bucket_counts(s, ["domain"], width="1 day", late="1 hour")
    got = run(spark, counts, tmp_path / "w")
    want = spark.read.parquet(parts).groupBy("domain", (F.expr("t div 86400000000") * 86400000000).alias("start")).count()
    n = {(r[0], r[1]): r[2] for r in want.collect()}
    rows = got.collect()
    assert rows and all(n[(r["domain"], r["start"])] == r["n"] for r in rows)  # the windows that the watermark has closed


def test_feed_takes_each_file_once_whatever_its_name(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()

    def run_once():
        q = feed(spark, str(folder), stream=True, files_per_batch=1).writeStream.foreachBatch(jobs.write_once(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r["topic"], r["payload"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (folder / "b.jsonl").write_text(json.dumps({"topic": "iot/sensors/1/readings", "payload": {"sensorId": "1", "value": 2.5}}) + "\nnot json\n")
    want = [("", "not json"), ("iot/sensors/1/readings", '{"sensorId":"1","value":2.5}')]
    assert sorted(map(tuple, feed(spark, str(folder)).collect())) == want and run_once() == want
    (folder / "a.jsonl").write_text(json.dumps({"topic": "x", "payload": "text"}) + "\n")  # a smaller name that comes later, after a restart
    assert run_once() == sorted([*want, ("x", "text")])


def test_ingestion_writes_readings_alerts_and_dead_letters(spark, parts, tmp_path):
    out = str(tmp_path / "out")
    s = stream(spark, parts).withColumn("domain", F.when(F.col("sequence") % 50 == 0, "IoT").otherwise(F.col("domain")))
    for _ in range(2):  # the second run finds nothing new
        q = stateful.ingested(s, bounds(spark)).writeStream.foreachBatch(jobs.tables_once(out)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    whole = spark.read.parquet(parts)
    good = whole.where("sequence % 50 <> 0").dropDuplicates(["series_id", "t"])
    want = points.classified(good, bounds(spark))
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    assert read("readings").count() == good.count() and read("dead_letters").count() == whole.where("sequence % 50 = 0").count()
    assert read("alerts").count() == want.where("classification in ('critical', 'warning')").count()


def test_late_rows_are_dropped_and_state_outlives_restarts(spark, tmp_path):
    folder = tmp_path / "in"
    kind = "sensor_id long, t long, sequence long, value double"

    def add(rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(folder))

    hour = 3600 * 1_000_000
    got = []
    for rows in ([(1, 0, 1, 1.0), (1, hour, 2, 1.0), (2, 0, 3, 1.0)], [(1, 2 * hour, 4, 1.0), (1, 7 * hour, 5, 1.0), (2, 6 * hour, 6, 1.0)]):
        add(rows)
        jobs.drained(jobs.throttled(stream(spark, str(folder)), 6 * 3600), str(tmp_path / "out"), str(tmp_path / "ck"))
        got = sorted(r["sequence"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [1, 3, 5, 6]
    for k, rows in enumerate(([(1, 0, 1, 1.0), (1, 50 * hour, 2, 1.0)], [(1, hour, 3, 1.0), (1, 51 * hour, 4, 1.0)], [(1, 100 * hour, 5, 1.0)])):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "late"))
        s = jobs.timed(stream(spark, str(tmp_path / "late")))
        jobs.drained(jobs.bucket_counts(s, ["sensor_id"], width="1 hour", late="5 minutes"), str(tmp_path / "w"), str(tmp_path / "wck"))
    counts = {r["start"]: r["n"] for r in spark.read.parquet(str(tmp_path / "w")).collect()}
    assert hour not in counts and counts[0] == 1  # the reading of the second hour came after the watermark had passed it
