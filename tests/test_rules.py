"""Boundary cases of guards, rules, staging and folds, each against a value worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import access, guards, rules, series
from tidemark.functions import constants as K
from tidemark.operators import events, folds, history, metrics, predict
from tidemark.sources import readings, sinks

NOW = 1_706_659_200_000_000
INF, NAN = float("inf"), float("nan")


def col(spark, rows, kind, expr):
    return [r[0] for r in spark.createDataFrame(rows, kind).coalesce(1).select(expr).collect()]


def test_value_guard(spark):
    rows = [(None, "ph"), (NAN, "ph"), (INF, "ph"), (-INF, "ph"), (0.0, "PH"), (14.0, "ph"), (14.001, "ph"), (-0.1, "ph"), (1e9, "other")]
    got = col(spark, rows, "v double, k string", guards.value_reason(F.col("v"), F.col("k")))
    assert got == ["VALUE_NULL", "VALUE_NAN", "VALUE_INFINITE", "VALUE_INFINITE", None, None, "VALUE_ABOVE_LIMIT", "VALUE_BELOW_LIMIT", None]


def test_time_guard(spark):
    rows = [(None,), (NOW + 300 * K.SECOND,), (NOW + 300 * K.SECOND + 1,), (NOW - 30 * 86400 * K.SECOND,), (NOW - 30 * 86400 * K.SECOND - 1,)]
    assert col(spark, rows, "t long", guards.time_reason(F.col("t"), NOW)) == [None, None, "TIMESTAMP_FUTURE", None, "TIMESTAMP_TOO_OLD"]


def test_first_reason_wins(spark):
    rows = [(None, NAN), (0, NAN), (-1, 1.0), (1, NAN), (1, 1.0)]
    got = col(spark, rows, "s long, v double", guards.reading_reason(F.col("s"), F.col("v"), F.lit(NOW), NOW))
    assert got == ["SENSOR_ID_NULL", "SENSOR_ID_INVALID", "SENSOR_ID_INVALID", "VALUE_NAN", None]


def test_bounds_are_strict_and_nan_breaks_none(spark):
    rows = [(1.0, 1.0, 2.0), (2.0, 1.0, 2.0), (0.9, 1.0, None), (9.9, None, None), (NAN, 1.0, 2.0)]
    assert col(spark, rows, "v double, a double, b double", guards.below_or_above(F.col("v"), F.col("a"), F.col("b"))) == [False, False, True, False, False]
    assert col(spark, rows, "v double, a double, b double", rules.within_band(F.col("v"), F.col("a"), F.col("b"))) == [True, True, False, False, True]


def test_rule_variants(spark):
    rows = [("less_than", 5.0, 9.0, 7.0), ("out_of_range", 5.0, None, 3.0), ("equal_to", 5.0, None, 5.0), ("greater_than", 5.0, None, 5.0), ("less_than", None, None, 1.0)]
    kind = "c string, a double, b double, v double"
    args = [F.col(x) for x in ("c", "a", "b", "v")]
    assert col(spark, rows, kind, rules.violates_online(*args)) == [True, True, False, False, False]
    assert col(spark, rows, kind, rules.violates_batch(*args)) == [False, False, True, False, False]


def test_spike_edges(spark):
    t = {k: F.lit(v).cast("double") for k, v in {"abs_delta": 5.0, "rel_delta": None, "abs_slope": 5.0, "rel_slope": None}.items()}
    rows = [(10.0, 0, 5.0, 0), (10.0, 999_999, 5.0, 0), (10.0, 1_000_000, 5.0, 0), (5.05, 10, 5.0, 0), (1.0, 1, None, None), (4.0, 2_000_000, 0.0, 0)]
    kind = "v double, t long, p double, q long"
    args = [F.col(x) for x in ("v", "t", "p", "q")]
    both = ["abs_delta", "abs_slope"]
    assert col(spark, rows, kind, rules.spike(*args, t, F.lit(0.1), F.lit(0.01), 1.0)) == [["abs_delta"], ["abs_delta"], both, [], None, []]
    assert col(spark, rows, kind, rules.spike(*args, t, F.lit(0.5), F.lit(0.02))) == [both, both, both, [], None, []]


def test_series(spark):
    rows = [("a",), ("a:b",), ("a:b:c",), ("a:b:c:d:e",), ("iot:sensor_7:7",)]
    assert col(spark, rows, "s string", series.part(F.col("s"), 3)) == [None, None, "c", "c:d:e", "7"]
    assert col(spark, rows, "s string", series.sensor_of(F.col("s"))) == [None, None, None, None, 7]
    assert col(spark, [("1.2.3.4, 5",), ("",), (None,)], "x string", series.client_ip(F.col("x"), F.lit(None).cast("string"), F.lit("peer"))) == ["1.2.3.4", "peer", "peer"]


def test_access(spark):
    rows = [("admin", None, [], "s", "d"), ("read_only", None, ["d"], "s", "d"), ("source_writer", "s", ["d"], "s", "d"), ("source_writer", "s", [], "s", "d"), ("source_writer", "x", ["d"], "s", "d"), (None, None, None, "s", "d")]
    got = col(spark, rows, "r string, o string, l array<string>, s string, d string", access.may_write(*(F.col(c) for c in "rolsd" if c != "x")))
    assert got == [True, False, True, False, False, False]


def test_spaced(spark):
    rows = [(1, 0, 1), (1, 299_999_000, 2), (1, 300_000_000, 3), (1, None, 4), (2, 5, 5), (None, 1, 6), (None, 2, 7)]
    df = spark.createDataFrame(rows, "k long, t long, sequence long")
    got = {r["sequence"]: r["accepted"] for r in folds.spaced(df, ["k"], "t", 300, ["t", "sequence"]).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: True, 6: True, 7: False}


def test_breaker_and_states(spark):
    calls = [(1, t * K.SECOND, t, ok) for t, ok in ((0, False), (1, False), (2, True), (31, True), (32, True), (33, False))]
    df = spark.createDataFrame(calls, "k int, t long, sequence long, ok boolean")
    got = [r["breaker"] for r in folds.breaker(df, ["k"], "t", "ok", ["t"], failures=2).orderBy("t").collect()]
    assert got == ["CLOSED", "OPEN", "REJECTED", "HALF_OPEN", "CLOSED", "CLOSED"]
    rows = [(1, i, s) for i, s in enumerate([None, None, "warning", "critical", "warning", None, "warning"])]
    df = spark.createDataFrame(rows, "k int, sequence long, severity string")
    got = [r["state"] for r in folds.states(df, ["k"], "severity", ["sequence"], warm_up=2).orderBy("sequence").collect()]
    assert got == ["INITIALIZING", "NORMAL", "WARNING", "ALERT", "ALERT", "NORMAL", "WARNING"]


def test_consecutive_and_limit(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([5.0, 9.0, 9.0, None, 9.0])], "k int, sequence long, v double")
    assert [r["consecutive"] for r in history.consecutive(df, ["k"], ["sequence"], F.col("v") > 6).orderBy("sequence").collect()] == [0, 1, 2, 0, 1]
    calls = spark.createDataFrame([(1, t * K.SECOND, i) for i, t in enumerate((0, 1, 2, 60, 90))], "k int, t long, sequence long")
    got = {r["sequence"]: (r["approx"], r["allowed"]) for r in history.rate_limited(calls, ["k"], "t", ["t"], 3).collect()}
    assert got == {0: (1, True), 1: (2, True), 2: (3, True), 3: (4, False), 4: (3, True)}


def test_messages(spark):
    ok = '{"sensorId": "5", "value": 1.5, "timestamp": "2024-01-30T23:59:00Z", "metadata": {"sequence": "9", "sensorType": "ph"}}'
    rows = [("iot/sensors/5/readings", ok), ("iot/sensors/5/readings", "{"), ("plant/a/b/data", '{"value": 2}'), ("iot/a/b/data", '{"value": 2}'), ("x/y", '{"sensor_id": " ", "value": 1}')]
    got = [(r["sensor_id"], r["series_id"], r["sequence"], r["error"], r["reason"]) for r in readings.messages(spark.createDataFrame(rows, "topic string, payload string").coalesce(1), NOW).collect()]
    assert got[0] == (5, None, 9, None, None)
    assert got[1][3] == "parse_error" and got[2] == (None, "plant:a:b", None, None, None)
    assert got[3][3] == "invalid_domain" and got[4][3:] == ("validation_error", "SENSOR_ID_BLANK")


def test_packets(spark):
    df = spark.read.schema(readings.PACKET).json(spark.sparkContext.parallelize(['{"device_uuid": "D1", "ts": "2024-01-01T00:00:00Z", "readings": [{"sensor_uuid": "S1", "value": 1}, {"sensor_uuid": "S2", "value": 2, "sensor_ts": 1.5}]}']))
    sensors = spark.createDataFrame([("d1", "s1", 7), ("d2", "s2", 8)], "device_uuid string, sensor_uuid string, sensor_id long")
    got = {r["sensor_uuid"]: (r["sensor_id"], r["timestamp"].year) for r in readings.device_packets(df, sensors, F.lit(NOW)).collect()}
    assert got == {"s1": (7, 2024), "s2": (None, 1970)}
    packets = spark.read.schema(readings.POINTS).json(spark.sparkContext.parallelize(['{"source_id": "x", "domain": "IoT", "data_points": [{"stream_id": "a", "value": 1}]}', '{"source_id": "x", "domain": "d", "data_points": [{"value": 1}, {"stream_id": "b:c", "value": 2}]}']))
    assert sorted((r["series_id"] or "", r["error"] or "") for r in readings.points(packets).collect()) == [("", "missing_stream"), ("IoT:x:a", "invalid_domain"), ("d:x:b:c", "")]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,a,b\n2024-01-01 00:00:00,1,x\nbad,2,3\n2024-01-02 00:00:00,NaN,4\n")
    df = spark.read.option("header", True).csv(str(tmp_path))
    got = sorted((r["series_id"], r["value"]) for r in readings.csv_points(df, "time", ["a", "b"], "s", "d", "m_").collect())
    assert got == [("d:s:m_a", 1.0), ("d:s:m_b", 4.0)]
    with pytest.raises(ValueError):
        readings.csv_points(df, "time", ["c"], "s", "d")


def test_latest_upsert_tail(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, None), (2, 1, 7.0)], "k int, t long, v double")
    assert sorted(map(tuple, sinks.latest(df, ["k"], ["t"], ["v"]).collect())) == [(1, None), (2, 7.0)]
    new = spark.createDataFrame([(2, 9, 1.0), (3, 9, 1.0)], "k int, t long, v double")
    assert sorted(r["t"] for r in sinks.upserted(df, new, ["k"]).collect()) == [1, 2, 9, 9]
    assert [r["k"] for r in sinks.absent(df, new, ["k"]).collect()] == [3]


def test_previous_keeps_start_of_equal_run(spark):
    df = spark.createDataFrame([(1, t * K.SECOND, t, v) for t, v in ((0, 5.0), (100, 5.0), (200, 999.0), (600, 6.0), (1300, 7.0))], "sensor_id long, t long, sequence long, value double")
    got = {r["sequence"]: (r["previous_value"], r["previous_t"]) for r in events.with_previous(df, F.col("value") > 100, 600).collect()}
    assert got == {0: (None, None), 100: (5.0, 0), 200: (5.0, 0), 600: (5.0, 0), 1300: (None, None)}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "sensor_id long, t long, sequence long, value double, sensor_type string")
    assert folds.spaced(df, ["sensor_id"], "t", 1, ["t"]).count() == 0
    ranges = spark.createDataFrame([], "sensor_id long, low double, high double, warning_min double, warning_max double")
    assert events.iot_classified(df, ranges, {"abs_delta": 1.0, "rel_delta": None, "abs_slope": None, "rel_slope": None}).count() == 0
    assert predict.moving_average(df).count() == 0


def test_small_expressions(spark):
    assert col(spark, [(5, 0), (0, 0), (3, 1)], "a long, b long", metrics.success_rate(F.col("a"), F.col("b"))) == [1.0, 1.0, 0.75]
    assert col(spark, [(0,), (3,), (9,)], "a int", rules.backoff_seconds(F.col("a"))) == [1.0, 8.0, 30.0]
    assert col(spark, [(1.0, 2.5), (None, 2.0), (1.0, None), (None, None)], "a double, b double", rules.expected_range(F.col("a"), F.col("b"))) == ["1.0-2.5", "<= 2.0", ">= 1.0", "unknown"]
