"""A database's table by parts, with pushed filters."""

import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tidemark.sources import database

KIND = "id long, sensor long, value double, name string"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path, r = str(tmp_path_factory.mktemp("db") / "x.db"), random.Random(1)
    rows = [(None if i % 50 == 0 else i * 3, i % 7 if i % 11 else None, r.choice([None, float(i), -0.5]), r.choice(["a", "B", "é", None])) for i in range(1000)]
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE readings (id INTEGER, sensor INTEGER, value REAL, name TEXT)")
    db.executemany("INSERT INTO readings VALUES (?, ?, ?, ?)", rows)
    db.execute("CREATE TABLE none (id INTEGER, sensor INTEGER, value REAL, name TEXT)")
    db.commit()
    db.close()
    spark.dataSource.register(database.DatabaseSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield (lambda table, parts: spark.read.format("database").schema(KIND).options(module="sqlite3", connect=json.dumps({"database": path}), table=table, partition_column="id", partitions=parts).load()), rows
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_parts_are_the_table(store):
    load, rows = store
    for parts in (1, 2, 7, 5000):
        df = load("readings", parts)
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(rows, key=repr)
    assert load("readings", 7).rdd.getNumPartitions() == 7
    assert load("none", 7).collect() == []


def test_ranges():
    assert database.ranges(None, None, 4) == [(None, None)] and database.ranges(5, 5, 4) == [(None, None)]
    assert database.ranges(0, 9, 3) == [(None, 3), (3, 6), (6, None)]
    assert database.ranges(-2, 0, 9) == [(None, -1), (-1, 0), (0, None)]


@pytest.mark.parametrize("where", ["sensor = 3", "sensor is null", "value > 10 and id <= 600", "sensor in (1, 2)", "name = 'a'", "value is not null and name like 'B%'", "sensor <> 3", "id >= 5000", "value = double('nan')", "sensor = 3 or id < 9"])
def test_filters(spark, store, where):
    load, rows = store
    want = spark.createDataFrame(rows, KIND).where(where)
    assert sorted(map(repr, load("readings", 4).where(where).collect())) == sorted(map(repr, want.collect()))


def test_filters_reach_the_database(store, capsys):
    load, _ = store
    load("readings", 4).where((F.col("value") > 10) & (F.col("sensor") == 3)).explain()
    plan = capsys.readouterr().out
    assert "PushedFilters" in plan or "Filter" not in plan.split("BatchScan")[0]
    reader = database.DatabaseReader(load("readings", 1).schema, {"module": "sqlite3", "table": 'a.b"c'})
    assert list(reader.pushFilters([database.D.GreaterThan(("value",), 10.0), database.D.EqualTo(("name",), "a")])) == [database.D.EqualTo(("name",), "a")]
    assert reader._query("x", []) == ('SELECT x FROM "a"."b""c" WHERE ("value" > ?)', [10.0])
