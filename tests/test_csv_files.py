"""Row numbers of CSV files over several splits."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import csv_files


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000b")
    spark.conf.set("spark.sql.files.openCostInBytes", "10b")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def write(folder, files, seed):
    """Files with blank lines and bad rows in between; what each data row's number and cells are."""
    r, want = random.Random(seed), {}
    for name, n in files.items():
        lines, k = ["at,a b,c"], 0
        for _ in range(n):
            if r.random() < 0.1:
                lines.append(r.choice(["", "   "]))
                continue
            at = r.choice(["2024-01-01 00:00:0" + str(r.randrange(10)), "never", "2024-01-02"])
            cells = [at, r.choice(["1.5", "x", "", "nan"]), r.choice(["7", '"8"', "-1e3", '"1,5"'])]
            line = r.choice([",".join(cells)] * 8 + [at, ",".join([*cells, "more"])])
            lines.append(line)
            want[name, k] = line
            k += 1
        (folder / name).write_text("\n".join(lines) + r.choice(["", "\n", "\n\n"]))
    return want


def test_numbers_over_splits(spark, small_splits, tmp_path):
    want = write(tmp_path, {"x.csv": 2500, "y.csv": 900, "z.csv": 1, "empty.csv": 0}, 3)
    lines = csv_files.lines(spark, str(tmp_path))
    assert lines.select("file", F.spark_partition_id()).distinct().groupBy("file").count().where("count > 5").count() >= 1
    got = {(r["file"].rsplit("/", 1)[1], r["line"] - 1): r["text"] for r in lines.where("line > 0").collect()}
    assert got == want
    rows = csv_files.rows(spark, str(tmp_path))
    assert rows.count() == len(want)
    points = csv_files.points(rows, "at", ["a b", "c"], F.lit("s"), "plant", "p_").collect()
    found = {(r["metadata"]["csv_row"], r["metadata"]["csv_column"], r["value"]) for r in points}
    for (_, k), line in want.items():
        cells = line.split(",")
        if len(cells) == 3 and cells[0] != "never":
            assert ((str(k), "a b", 1.5) in found) or cells[1] != "1.5"
            assert ((str(k), "c", 7.0) in found) or cells[2] != "7"
    assert {r["series_id"] for r in points} == {"plant:s:p_a b", "plant:s:p_c"} and all(r["t"] is not None for r in points)


def test_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("at,a\n1,2\n")
    (tmp_path / "b.csv").write_text("at,b\n1,2\n")
    with pytest.raises(ValueError):
        csv_files.rows(spark, str(tmp_path))
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.csv").write_text("")
    assert csv_files.rows(spark, str(tmp_path / "none")).collect() == []
    with pytest.raises(ValueError):
        csv_files.points(csv_files.rows(spark, str(tmp_path / "none")), "at", [], F.lit("s"), "plant")


def test_submissions(spark):
    given = [("finance", '["a"]', None), ("IoT", '["a"]', "invalid_domain"), (None, '["a"]', "invalid_domain"), ("x", "[]", "invalid_value_columns"), ("x", "a,b", "invalid_value_columns"), ("x", None, "invalid_value_columns"), ("x", '"a"', "invalid_value_columns")]
    df = spark.createDataFrame(given, "domain string, cols string, want string")
    bad = df.where(~csv_files.submit_error(F.col("domain"), F.col("cols")).eqNullSafe(F.col("want"))).collect()
    assert not bad
