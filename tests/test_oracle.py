"""Each registered query against its SQL, run by DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()
OWN = [k for k in entry.catalogue.queries()]


def same(a, b):
    if isinstance(a, float) and isinstance(b, (float, int)) or isinstance(b, float) and isinstance(a, (float, int)):
        return math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12) or (math.isnan(a) and math.isnan(b))
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


def connect(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def rows_of(spark, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    return cols, sorted(([r[c] for c in cols] for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(set(OWN) & set(SQL)))
def test_equals_sql(spark, sf_dir, name):
    cols, ours = rows_of(spark, sf_dir, name)
    r = connect(sf_dir).execute(SQL[name])
    names = [d[0] for d in r.description]
    assert cols == sorted(names)
    order = [names.index(c) for c in cols]
    theirs = sorted(([x[k] for k in order] for x in r.fetchall()), key=repr)
    assert len(ours) == len(theirs) and len(ours) > 0
    bad = [(a, b) for a, b in zip(ours, theirs) if not all(map(same, a, b))]
    assert not bad, bad[:3]


def test_every_own_query_has_sql():
    assert not set(OWN) - set(SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
