"""Composed ingestion: readings and points from their arrival to the tables that they end in, each in one classified pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import access, guards, rules, series
from tidemark.functions import constants as K
from tidemark.operators import events, folds, lineage
from tidemark.plans import points as universal
from tidemark.plans.base import BOUNDS_SQL, COOLDOWN, FRESH, NOW, POINTS, READINGS, SPIKES, Registry, bounds
from tidemark.plans.sequences import _IOT, ranges
from tidemark.sources import csv_files, readings, sinks, snapshots, tables

query = Registry()
KEYS, ORDER = ["sensor_id"], ["t", "sequence"]
S = K.SECOND
#: The second copy of a reading has its sequence plus this.
COPY = 10_000_000


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as they come in (received): some with bad values or times, every tenth twice, within the life time of deduplication or after it."""
    k = F.col("k")
    r = readings.event_readings(spark, sf_dir).withColumn("copy", F.explode(F.when(k % 10 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    value = F.when(k == 11, F.lit(None)).when(k == 12, float("nan")).when(k == 13, float("inf")).when(k == 14, 0.0).otherwise(F.col("value"))
    received = F.col("t") + F.col("copy") * F.when(k % 20 == 3, 5).otherwise(400) * S
    return r.withColumn("value", value).withColumn("received", received).withColumn("sent", F.col("t") + F.when(k == 7, F.lit(31 * 86400 * S)).otherwise(0)).withColumn("sequence", F.col("sequence") + F.col("copy") * COPY)


def routed(rows: DataFrame, ranges_: DataFrame, spikes: dict[str, float | None], now: int, fresh_seconds: float = K.FRESH_SECONDS, cooldown_seconds: float = K.COOLDOWN_SECONDS, dedup_seconds: float = K.DEDUP_SECONDS) -> DataFrame:
    """rows with outcome (rejected, duplicate or routed), reason, class, suspicious and what is done with them.

    Guards come first, then deduplication by sensor, time and value with a life time, then the classifier, which only the
    rows that are left take part in. An alert or a warning is stored as a reading and never goes to the learning side; a
    clean value only renews the newest value and goes there. One scan; an exchange for deduplication and one for history.
    """
    reason = guards.reading_reason(F.col("sensor_id"), F.col("value"), F.col("sent"), now)
    r = rows.withColumn("_guard", reason).withColumn("_valid", reason.isNull())
    r = folds.spaced(r, ["sensor_id", "sent", "value"], "received", dedup_seconds, ["received", "sequence"], "_first", only="_valid", split=False)
    r = events.iot_classified(r, ranges_, spikes, fresh_seconds, cooldown_seconds, takes_part=F.col("_valid") & F.col("_first"))
    outcome = F.when(~F.col("_valid"), "rejected").when(~F.col("_first"), "duplicate").otherwise("routed")
    return events.consequences(r.select(*rows.columns, outcome.alias("outcome"), F.coalesce("_guard", F.when(outcome == "routed", F.col("reason"))).alias("reason")))


_ARRIVED = f"""{READINGS.replace('r AS (', 'r0 AS (', 1)}, ar AS (
        SELECT sensor_id, CASE WHEN k = 11 THEN NULL WHEN k = 12 THEN 'nan'::DOUBLE WHEN k = 13 THEN 'inf'::DOUBLE WHEN k = 14 THEN 0.0 ELSE value END AS value, t, sequence + copy * {COPY} AS sequence, event_type, sensor_type, k,
            t + copy * CASE WHEN k % 20 = 3 THEN 5 ELSE 400 END * {S} AS received, t + CASE WHEN k = 7 THEN {31 * 86400 * S} ELSE 0 END AS sent
        FROM r0, (VALUES (0), (1)) c(copy) WHERE copy = 0 OR k % 10 = 3
    ), gd AS (
        SELECT *, CASE WHEN sensor_id IS NULL THEN 'SENSOR_ID_NULL' WHEN sensor_id <= 0 THEN 'SENSOR_ID_INVALID' WHEN value IS NULL THEN 'VALUE_NULL' WHEN isnan(value) THEN 'VALUE_NAN' WHEN isinf(value) THEN 'VALUE_INFINITE'
            WHEN sent > {NOW} + 300000000 THEN 'TIMESTAMP_FUTURE' WHEN sent < {NOW} - 2592000000000 THEN 'TIMESTAMP_TOO_OLD' END AS guard FROM ar
    ), dd AS (
        SELECT *, guard IS NULL AND coalesce(received - lag(received) OVER (PARTITION BY sensor_id, sent, value, guard IS NULL ORDER BY received, sequence) < {K.DEDUP_SECONDS * S}, false) AS dup FROM gd
    ), r AS (SELECT sensor_id, value, t, sequence, event_type, sensor_type, k FROM dd WHERE guard IS NULL AND NOT dup)"""
_ROUTED = f"""{_IOT.replace(READINGS, _ARRIVED, 1)}, ro AS (
        SELECT dd.*, CASE WHEN guard IS NOT NULL THEN 'rejected' WHEN dup THEN 'duplicate' ELSE 'routed' END AS outcome, coalesce(guard, iot.reason) AS reason,
            CASE iot.reason WHEN 'out_of_range' THEN 'ALERT' WHEN 'spike' THEN 'WARNING' ELSE CASE WHEN iot.reason IS NOT NULL THEN 'ML_PREDICTION' END END AS class
        FROM dd LEFT JOIN iot USING (sequence))"""


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(arrivals(spark, sf_dir), ranges(spark, sf_dir), SPIKES, NOW, FRESH, COOLDOWN)


@query(f"""WITH RECURSIVE {_ROUTED} SELECT sequence, outcome, reason, class, outcome = 'routed' AND abs(value) <= 1e-6 AS suspicious, coalesce(class IN ('ALERT', 'WARNING'), false) AS persist_reading,
    class IS NOT NULL AS update_latest, coalesce(class = 'ML_PREDICTION', false) AS to_learning FROM ro""")
def route_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("sequence", "outcome", "reason", "class", "suspicious", "persist_reading", "update_latest", "to_learning")


@query(f"WITH RECURSIVE {_ROUTED} SELECT outcome, class, count(*) AS n, count(*) FILTER (WHERE outcome = 'routed' AND abs(value) <= 1e-6) AS zeros, max(sequence) AS acknowledged FROM ro GROUP BY ALL")
def route_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch of any size reports back."""
    return _routed(spark, sf_dir).groupBy("outcome", "class").agg(F.count(F.lit(1)).alias("n"), F.count_if("suspicious").alias("zeros"), F.max("sequence").alias("acknowledged"))


@query(f"WITH RECURSIVE {_ROUTED} SELECT 'sensor ' || sensor_id || ' reading ' || sequence AS payload, reason AS error, 'validation_error' AS error_type, 'router' AS source, sent AS timestamp, 0 AS retry_count FROM ro WHERE outcome = 'rejected'")
def route_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = _routed(spark, sf_dir).where("outcome = 'rejected'")
    payload = F.concat(F.lit("sensor "), F.col("sensor_id").cast("string"), F.lit(" reading "), F.col("sequence").cast("string"))
    return readings.dead_letters(bad, payload, F.col("reason"), F.lit("validation_error"), "router", F.col("sent"))


_STAGED = f"""{POINTS}, {BOUNDS_SQL}, s0 AS (
        SELECT CASE sequence % 7 WHEN 0 THEN 'IoT' ELSE domain END AS domain, source_id, CASE WHEN sequence % 7 = 1 THEN '' ELSE stream_id END AS stream_id, value, t, sequence + copy * {COPY} AS sequence
        FROM p, (VALUES (0), (1)) c(copy) WHERE copy = 0 OR sequence % 10 = 3
    ), st AS (SELECT *, domain || ':' || source_id || ':' || stream_id AS series_id, CASE WHEN lower(domain) = 'iot' THEN 'invalid_domain' WHEN stream_id = '' THEN 'missing_stream' END AS error FROM s0),
    dp AS (SELECT *, error IS NULL AND row_number() OVER (PARTITION BY series_id, t, error IS NULL ORDER BY sequence) > 1 AS dup FROM st),
    p2 AS (SELECT domain, source_id, stream_id, value, t, sequence, series_id FROM dp WHERE error IS NULL AND NOT dup)"""


def staged_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as they come in: some for the domain that has its own path, some without a stream, every tenth twice."""
    s = F.col("sequence")
    p = readings.event_points(spark, sf_dir).withColumn("copy", F.explode(F.when(s % 10 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    p = p.withColumn("domain", F.when(s % 7 == 0, "IoT").otherwise(F.col("domain"))).withColumn("stream_id", F.when(s % 7 == 1, "").otherwise(F.col("stream_id")))
    key = series.given_or_built(F.lit(None).cast("string"), F.col("domain"), F.col("source_id"), F.col("stream_id"))
    error = F.when(~guards.not_iot(F.col("domain")), "invalid_domain").when(key.isNull(), "missing_stream")
    return p.withColumn("series_id", key).withColumn("sequence", s + F.col("copy") * COPY).withColumn("error", error).drop("copy")


def routed_points(staged: DataFrame, config: DataFrame) -> DataFrame:
    """(series_id, domain, sequence, classification, status, error): rejected points keep their error; of points with one series and time the first is accepted."""
    good = staged.where("error is null")
    firsts = good.groupBy("series_id", "t").agg(F.min(F.struct("sequence", "domain", "source_id", "stream_id", "value")).alias("p"), F.count(F.lit(1)).alias("n"))
    told = universal.classified(firsts.select("series_id", "t", "p.*"), config)
    bad = staged.where("error is not null").select("series_id", "domain", "sequence", F.lit(None).cast("string").alias("classification"), F.lit("rejected").alias("status"), "error")
    accepted = told.select("series_id", "domain", "sequence", "classification", F.lit("accepted").alias("status"), F.lit(None).cast("string").alias("error"))
    repeated = firsts.where("n > 1").select("series_id", "t", F.col("p.sequence").alias("first"))
    again = good.join(repeated, ["series_id", "t"]).where(F.col("sequence") != F.col("first"))
    again = again.select("series_id", "domain", "sequence", F.lit(None).cast("string").alias("classification"), F.lit("duplicate").alias("status"), F.lit(None).cast("string").alias("error"))
    return accepted.unionByName(again).unionByName(bad)


_KEYS = "k (name, role, own, domains, active) AS (VALUES ('ka', 'admin', NULL, CAST([] AS VARCHAR[]), true), ('kb', 'source_writer', '3', ['finance', 'health'], true), ('kc', 'source_writer', '4', ['health'], false), ('kd', 'read_only', NULL, ['finance'], true))"
_CLASSIFIED2 = universal.CLASSIFIED.replace(f"{POINTS}, {BOUNDS_SQL}", _STAGED, 1).replace("FROM p LEFT JOIN bounds", "FROM p2 p LEFT JOIN bounds", 1)


@query(f"""WITH {_CLASSIFIED2} SELECT CASE WHEN dp.error = 'missing_stream' THEN NULL ELSE dp.series_id END AS series_id, dp.domain, dp.sequence, classification, CASE WHEN dp.error IS NOT NULL THEN 'rejected' WHEN dup THEN 'duplicate' ELSE 'accepted' END AS status, dp.error
    FROM dp LEFT JOIN classified c ON c.sequence = dp.sequence""")
def route_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed_points(staged_points(spark, sf_dir), bounds(spark))


@query(f"""WITH {_CLASSIFIED2}, {_KEYS}, au AS (
        SELECT dp.sequence, CASE WHEN given IS NULL THEN 'missing_key' WHEN k.name IS NULL THEN 'invalid_key' WHEN NOT active THEN 'inactive_key' WHEN role = 'admin' THEN NULL WHEN role = 'source_writer' AND own = source_id AND list_contains(k.domains, domain) THEN NULL ELSE 'forbidden' END AS denied
        FROM (SELECT *, CASE sequence % 6 WHEN 1 THEN 'kb' WHEN 2 THEN 'kc' WHEN 3 THEN 'kd' WHEN 4 THEN 'other' ELSE 'ka' END AS given FROM dp) dp LEFT JOIN k ON k.name = given)
    SELECT dp.sequence, st.status, CASE WHEN st.status <> 'pending' THEN {NOW} END AS processed_at, CASE WHEN denied IS NOT NULL THEN denied ELSE dp.error END AS error
    FROM dp JOIN au USING (sequence), LATERAL (SELECT CASE WHEN denied IS NOT NULL OR dp.error IS NOT NULL THEN 'rejected' WHEN dup THEN 'failed' ELSE 'persisted' END AS status) st""")
def point_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of calls with keys, in one plan: who may not write is turned away, then what is wrong; repeats fail at the store, the rest is stored. Each has the time at which it was done with."""
    s = F.col("sequence")
    staged = staged_points(spark, sf_dir).withColumn("given", F.when(s % 6 == 1, "kb").when(s % 6 == 2, "kc").when(s % 6 == 3, "kd").when(s % 6 == 4, "other").otherwise("ka"))
    j = staged.withColumn("key_hash", access.key_hash(F.col("given"))).join(api_keys(spark), "key_hash", "left")
    denied = access.call_error(F.col("given"), F.col("role"), F.col("active"), F.col("own"), F.col("domains"), F.col("source_id"), F.col("domain"))
    told = j.withColumn("denied", denied).withColumn("stored", F.min(F.when(F.col("error").isNull(), s)).over(Window.partitionBy("series_id", "t")))
    rejected = F.col("denied").isNotNull() | F.col("error").isNotNull()
    status = series.lifecycle(rejected, F.col("stored") != s, F.lit("normal"), F.col("stored") == s)
    out = told.select("sequence", status.alias("status"), F.coalesce("denied", "error").alias("error"))
    return out.withColumn("processed_at", series.processed_at(F.col("status"), F.lit(NOW)))


@query("""SELECT event_id AS sequence, CASE WHEN domain IS NULL OR domain = '' THEN 'unsupported' WHEN domain = 'iot' THEN 'iot' ELSE 'universal' END AS store
    FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'iot' WHEN 1 THEN 'IoT' WHEN 2 THEN 'finance' WHEN 3 THEN '' END AS domain FROM events)""")
def store_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table a point is stored in: the exact name iot has its own, all others share one, none without a domain."""
    m = F.col("sequence") % 5
    p = readings.event_readings(spark, sf_dir).select("sequence", F.when(m == 0, "iot").when(m == 1, "IoT").when(m == 2, "finance").when(m == 3, "").alias("domain"))
    return p.select("sequence", rules.store_of(F.col("domain")).alias("store"))


_MESSAGES = f"""{READINGS}, ms AS (SELECT sequence, k, value, t, CASE WHEN k % 8 = 0 THEN 'iot' ELSE 'health' END AS domain, sensor_id FROM r)"""


@query(f"""WITH {_MESSAGES} SELECT sequence, CASE WHEN k % 8 <> 1 THEN domain || ':' || sensor_id || ':bpm' END AS series_id,
        CASE WHEN k % 8 = 1 THEN 'parse_error' WHEN k % 8 = 0 THEN 'invalid_domain' WHEN k % 8 = 2 THEN 'validation_error' END AS error, CASE WHEN k % 8 NOT IN (1, 2) THEN value END AS value FROM ms""")
def universal_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of the universal topics, parsed and checked."""
    r, d = readings.event_readings(spark, sf_dir), F.col("k") % 8
    topic = F.concat_ws("/", F.when(d == 0, "iot").otherwise("health"), F.col("sensor_id").cast("string"), F.lit("bpm"), F.lit("data"))
    made = F.to_json(F.struct(F.when(d != 2, F.col("value")).alias("value"), F.create_map(F.lit("sequence"), F.col("sequence").cast("string")).alias("metadata")))
    raw = r.select(topic.alias("topic"), F.when(d == 1, F.concat(F.lit("{oops "), F.col("sequence").cast("string"))).otherwise(made).alias("payload"))
    out = readings.messages(raw, NOW)
    return out.select(F.coalesce("sequence", F.regexp_extract("payload", r"^\{oops (\d+)$", 1).try_cast("long")).alias("sequence"), F.when(F.coalesce(F.col("reason") != "NOT_JSON", F.lit(True)), F.col("series_id")).alias("series_id"), "error", "value")


#: Readings of a packet at most: sequences are unique, so a packet takes those of one range of them.
PACKET_READINGS = 500


def _packets(r: DataFrame) -> DataFrame:
    return r.withColumn("device", F.col("sensor_id") % 10).withColumn("packet", F.expr(f"sequence div {PACKET_READINGS}"))


@query(f"""WITH {READINGS} SELECT sensor_id % 10 AS device, sensor_id, value, t FROM r""")
def bulk_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk packets as JSON, each of a device and of bounded length, unpacked by their schema."""
    r = _packets(readings.event_readings(spark, sf_dir))
    one = F.struct("sensor_id", "value", F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"))
    packets = r.groupBy("device", "packet").agg(F.collect_list(one).alias("readings")).select("device", F.to_json(F.struct("readings")).alias("body"))
    rows = packets.select("device", F.from_json("body", readings.BULK).alias("b")).select("device", F.inline("b.readings"))
    return rows.select("device", "sensor_id", "value", F.unix_micros("timestamp").alias("t"))


@query(f"WITH {READINGS} SELECT sensor_id % 10 AS device, sequence // {PACKET_READINGS} AS packet, count(*) AS inserted, count(DISTINCT sensor_id) AS limited_keys FROM r GROUP BY ALL")
def bulk_acknowledged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each packet reports back: the rows of it, and the distinct sensors that the rate limiter counts."""
    r = _packets(readings.event_readings(spark, sf_dir))
    return r.groupBy("device", "packet").agg(F.count(F.lit(1)).alias("inserted"), F.count_distinct("sensor_id").alias("limited_keys"))


@query(f"""WITH RECURSIVE {_ROUTED} SELECT sensor_id % 10 AS device, sequence // {PACKET_READINGS} AS packet, count(*) AS received, count(*) FILTER (outcome = 'routed') AS accepted, count(*) FILTER (outcome = 'rejected') AS rejected,
        count(*) FILTER (outcome = 'duplicate') AS duplicates, coalesce(max(sequence) FILTER (outcome <> 'rejected'), -1) AS acknowledged,
        CASE WHEN count(*) FILTER (outcome = 'rejected') = 0 THEN 'ok' WHEN count(*) FILTER (outcome <> 'rejected') = 0 THEN 'error' ELSE 'partial' END AS status FROM ro GROUP BY ALL""")
def packet_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer to each packet after its readings were routed: how many were taken, turned away or there already, and the newest sequence that needn't be sent again."""
    r = _packets(_routed(spark, sf_dir))
    rejected = F.count_if(F.col("outcome") == "rejected")
    told = r.groupBy("device", "packet").agg(
        F.count(F.lit(1)).alias("received"), F.count_if(F.col("outcome") == "routed").alias("accepted"), rejected.alias("rejected"), F.count_if(F.col("outcome") == "duplicate").alias("duplicates"),
        F.coalesce(F.max(F.when(F.col("outcome") != "rejected", F.col("sequence"))), F.lit(-1)).alias("acknowledged"),
    )
    return told.withColumn("status", F.when(F.col("rejected") == 0, "ok").when(F.col("rejected") == F.col("received"), "error").otherwise("partial"))


_UNIVERSAL = f"""{POINTS}, u AS (SELECT CASE WHEN sequence % 50 = 7 THEN 'IoT' ELSE domain END AS domain, source_id, CASE WHEN sequence % 9 = 4 THEN '' ELSE stream_id END AS stream_id,
        CASE WHEN sequence % 9 = 5 THEN series_id || ':own' END AS given, value, t, sequence FROM p)"""


@query(f"""WITH {_UNIVERSAL} SELECT CASE WHEN given IS NOT NULL THEN given WHEN stream_id <> '' THEN domain || ':' || source_id || ':' || stream_id END AS series_id, domain, source_id, stream_id, value, t, sequence,
        CASE WHEN lower(domain) = 'iot' THEN 'invalid_domain' WHEN given IS NULL AND stream_id = '' THEN 'missing_stream' END AS error FROM u""")
def universal_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Universal packets as JSON, each of a domain and source and of bounded length, unpacked by their schema and checked point by point."""
    s = F.col("sequence")
    p = readings.event_points(spark, sf_dir).withColumn("given", F.when(s % 9 == 5, F.concat("series_id", F.lit(":own"))))
    one = F.struct(F.col("given").alias("series_id"), F.when(s % 9 == 4, "").otherwise(F.col("stream_id")).alias("stream_id"), "value", F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), "sequence")
    p = p.withColumn("domain", F.when(s % 50 == 7, "IoT").otherwise(F.col("domain")))
    packets = p.groupBy("domain", "source_id", F.expr(f"sequence div {PACKET_READINGS}").alias("packet")).agg(F.collect_list(one).alias("data_points"))
    body = packets.select(F.to_json(F.struct("domain", "source_id", "data_points")).alias("body"))
    found = readings.points(body.select(F.from_json("body", readings.POINTS).alias("p")).select("p.*"))
    return found.select("series_id", "domain", "source_id", "stream_id", "value", F.unix_micros("timestamp").alias("t"), "sequence", "error")


_FILES = """w AS (SELECT event_id % 4 AS job, event_id, ts, event_id % 11 = 0 AS bad, CASE WHEN event_id % 5 = 0 THEN 'x' WHEN event_id % 17 = 0 THEN NULL ELSE CAST(event_id % 97 AS VARCHAR) END AS a, CAST(event_id % 13 AS VARCHAR) AS b,
        row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) - 1 AS csv_row FROM events)"""


@query(f"""WITH {_FILES}, l AS (SELECT *, unnest(['a', 'b']) AS csv_column, unnest([a, b]) AS txt FROM w)
    SELECT job, csv_row, csv_column, 'plant:file' || job || ':m_' || csv_column AS series_id, epoch_us(date_trunc('second', ts)) AS t, TRY_CAST(txt AS DOUBLE) AS value FROM l WHERE NOT bad AND TRY_CAST(txt AS DOUBLE) IS NOT NULL""")
def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of rows, written and read back: every point tells the row and column that it comes from, counted as they lie in the file."""
    e = F.col("event_id")
    wide = readings.table(spark, sf_dir, "events").select(
        (e % 4).alias("job"), e, F.when(e % 11 == 0, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("at"),
        F.when(e % 5 == 0, "x").when(e % 17 != 0, (e % 97).cast("string")).alias("a"), (e % 13).cast("string").alias("b"),
    )
    folder = lineage.folder(spark, "csv")
    wide.repartition("job").sortWithinPartitions("job", "event_id").select("job", "at", "a", "b").write.partitionBy("job").csv(folder, header=True, emptyValue="")
    rows = csv_files.rows(spark, folder).withColumn("job", F.regexp_extract("file", r"/job=(\d+)/", 1).cast("long"))
    found = csv_files.points(rows, "at", ["a", "b"], F.concat(F.lit("file"), F.col("job").cast("string")), "plant", "m_")
    job = F.regexp_extract("series_id", r"^plant:file(\d+):", 1).cast("long")
    return found.select(job.alias("job"), F.col("metadata.csv_row").cast("long").alias("csv_row"), F.col("metadata.csv_column").alias("csv_column"), "series_id", "t", "value")


@query("""WITH j AS (SELECT event_id AS job_id, CASE WHEN event_id % 10 = 0 THEN 'IOT' WHEN event_id % 10 = 1 THEN NULL ELSE 'finance' END AS domain,
        CASE event_id % 7 WHEN 0 THEN '[]' WHEN 1 THEN 'price' WHEN 2 THEN '{"a": 1}' WHEN 3 THEN NULL WHEN 4 THEN '["price", "volume"' WHEN 5 THEN '["price"]' ELSE ' ["price", "volume"]' END AS cols FROM events)
    SELECT job_id, CASE WHEN domain IS NULL OR lower(domain) = 'iot' THEN 'invalid_domain' WHEN cols IS NULL OR json_valid(cols) IS NOT TRUE OR json_type(CASE WHEN json_valid(cols) THEN cols END) <> 'ARRAY' OR json_array_length(CASE WHEN json_valid(cols) THEN cols END) = 0 THEN 'invalid_value_columns' END AS error FROM j""")
def csv_submits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which submissions of files are taken: not for the domain that has its own path, and with a JSON array that names a column or more."""
    e = F.col("event_id")
    m = e % 7
    cols = F.when(m == 0, "[]").when(m == 1, "price").when(m == 2, '{"a": 1}').when(m == 3, F.lit(None)).when(m == 4, '["price", "volume"').when(m == 5, '["price"]').otherwise(' ["price", "volume"]')
    jobs = readings.table(spark, sf_dir, "events").select(e.alias("job_id"), F.when(e % 10 == 0, "IOT").when(e % 10 != 1, "finance").alias("domain"), cols.alias("cols"))
    return jobs.select("job_id", csv_files.submit_error(F.col("domain"), F.col("cols")).alias("error"))


@query(f"""WITH {READINGS} SELECT sequence, CASE WHEN k % 3 = 0 THEN 'missing_key' WHEN k % 3 = 1 THEN 'invalid_key' END AS keyed, CAST(NULL AS VARCHAR) AS open_mode, 'key_not_configured' AS unconfigured FROM r""")
def global_key_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls under one key for all: with a key, in open mode without one, and without one in production."""
    k = F.col("k") % 3
    calls = readings.event_readings(spark, sf_dir).select("sequence", F.when(k == 1, "other").when(k == 2, "secret").alias("given"))
    modes = {"keyed": ("secret", True), "open_mode": (None, False), "unconfigured": (None, True)}
    return calls.select("sequence", *(access.global_key_error(F.col("given"), expected, production).alias(c) for c, (expected, production) in modes.items()))


@query(f"""WITH {READINGS} SELECT sequence, CASE WHEN k % 10 = 1 THEN 'Missing required field: sensor_id' WHEN k % 10 = 2 THEN 'Missing required field: value' WHEN k % 10 = 3 THEN 'Missing required field: timestamp'
        WHEN k % 10 = 4 THEN 'sensor_id must be an integer' WHEN k % 10 = 5 THEN 'value must be a number' END AS error FROM r""")
def contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of a reading: three fields that must be there, of which two are numbers."""
    d = F.col("k") % 10
    r = readings.event_readings(spark, sf_dir).select(
        "sequence", F.when(d == 4, "x").when(d != 1, F.col("sensor_id").cast("string")).alias("sensor_id"), F.when(d == 5, "x").when(d != 2, F.col("value").cast("string")).alias("value"), F.when(d != 3, F.col("t").cast("string")).alias("timestamp")
    )
    return r.select("sequence", guards.contract_error(F.col("sensor_id"), F.col("value"), F.col("timestamp")).alias("error"))


def api_keys(spark: SparkSession) -> DataFrame:
    """(key_hash, role, own, domains, active): the table of keys, by their hashes."""
    rows = [("ka", "admin", None, [], True), ("kb", "source_writer", "3", ["finance", "health"], True), ("kc", "source_writer", "4", ["health"], False), ("kd", "read_only", None, ["finance"], True)]
    table = spark.createDataFrame(rows, "name string, role string, own string, domains array<string>, active boolean")
    return table.select(access.key_hash(F.col("name")).alias("key_hash"), "role", "own", "domains", "active")


_CALLS = f"""{POINTS}, {_KEYS}, q AS (SELECT *, CASE sequence % 6 WHEN 0 THEN 'ka' WHEN 1 THEN 'kb' WHEN 2 THEN 'kc' WHEN 3 THEN 'kd' WHEN 4 THEN 'other' END AS given FROM p),
    au AS (SELECT q.*, k.name, CASE WHEN given IS NULL THEN 'missing_key' WHEN k.name IS NULL THEN 'invalid_key' WHEN NOT active THEN 'inactive_key' WHEN role = 'admin' THEN NULL WHEN role = 'source_writer' AND own = source_id AND list_contains(k.domains, domain) THEN NULL ELSE 'forbidden' END AS error
        FROM q LEFT JOIN k ON sha256(k.name) = sha256(given))"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("sequence") % 6
    p = readings.event_points(spark, sf_dir).withColumn("given", F.when(m == 0, "ka").when(m == 1, "kb").when(m == 2, "kc").when(m == 3, "kd").when(m == 4, "other"))
    j = p.withColumn("key_hash", access.key_hash(F.col("given"))).join(api_keys(spark), "key_hash", "left")
    return j.withColumn("error", access.call_error(F.col("given"), F.col("role"), F.col("active"), F.col("own"), F.col("domains"), F.col("source_id"), F.col("domain")))


@query(f"WITH {_CALLS} SELECT sequence, error FROM au")
def authorized_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call by the hash of its key: the key must be there, known and active, and its role must allow the write."""
    return _calls(spark, sf_dir).select("sequence", "error")


@query(f"WITH {_CALLS} SELECT sha256(name) AS key_hash, count(*) AS calls, max(t) AS last_used_t FROM au WHERE name IS NOT NULL AND error IS DISTINCT FROM 'inactive_key' GROUP BY ALL")
def keys_last_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).where(F.col("role").isNotNull() & F.col("active")).groupBy("key_hash").agg(F.count(F.lit(1)).alias("calls"), F.max("t").alias("last_used_t"))


def _nullable(c: Column, where: Column) -> Column:
    return F.when(~where, c)


_LETTERS = f"""{READINGS}, dl AS (SELECT sequence AS id, repeat('p' || sequence || ' ', 300) AS payload, CASE WHEN k % 6 <> 0 THEN 'bad' END AS error, CASE WHEN k % 7 <> 0 THEN 'validation_error' END AS error_type, CASE WHEN k % 9 <> 0 THEN t END AS t, CASE WHEN k % 4 <> 3 THEN k % 5 END AS retry_count FROM r),
    dc AS (SELECT id, payload, coalesce(error, 'unknown') AS error, coalesce(error_type, 'unknown') AS error_type, coalesce(t, {NOW}) AS t, coalesce(retry_count, 0) AS retry_count FROM dl)"""


def dead_letters_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead letters as they are stored, with what stands in for fields that lack."""
    k = F.col("k")
    d = readings.event_readings(spark, sf_dir).select(
        F.col("sequence").alias("id"), F.repeat(F.concat(F.lit("p"), F.col("sequence").cast("string"), F.lit(" ")), 300).alias("payload"),
        _nullable(F.lit("bad"), k % 6 == 0).alias("error"), _nullable(F.lit("validation_error"), k % 7 == 0).alias("error_type"), _nullable(F.col("t"), k % 9 == 0).alias("t"), _nullable(k % 5, k % 4 == 3).alias("retry_count"),
    )
    return d.select("id", "payload", *(F.coalesce(c, F.lit(x)).alias(c) for c, x in (("error", "unknown"), ("error_type", "unknown"), ("t", NOW), ("retry_count", 0))))


_DLQ_AGE = 25 * 86400


@query(f"""WITH {_LETTERS} SELECT id, CASE WHEN ({NOW} - t) / 1000000.0 > {_DLQ_AGE} THEN 'deleted' WHEN retry_count >= {K.DLQ_RETRIES} THEN 'archived' ELSE 'requeued' END AS target, substr(payload, 1, 1000) AS payload, error, error_type, t,
        CASE WHEN ({NOW} - t) / 1000000.0 <= {_DLQ_AGE} AND retry_count < {K.DLQ_RETRIES} THEN retry_count + 1 ELSE retry_count END AS retry_count FROM dc ORDER BY t, id LIMIT 500""")
def dlq_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest 500 dead letters with the table that each goes to; payloads are cut at 1,000 characters there, and those tried again count one more."""
    oldest = sinks.tail(dead_letters_decoded(spark, sf_dir), [F.col("t"), F.col("id")], 500)
    fate = rules.dead_letter_fate(F.lit(False), F.col("retry_count"), (F.lit(NOW) - F.col("t")) / 1e6, max_age=_DLQ_AGE)
    return oldest.select("id", fate.alias("target"), F.substring("payload", 1, 1000).alias("payload"), "error", "error_type", "t", F.when(fate == "requeued", F.col("retry_count") + 1).otherwise(F.col("retry_count")).alias("retry_count"))


@query(f"WITH {_LETTERS} SELECT error_type, count(*) AS pending, min(t) AS oldest_t FROM dc GROUP BY ALL")
def dlq_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dead_letters_decoded(spark, sf_dir).groupBy("error_type").agg(F.count(F.lit(1)).alias("pending"), F.min("t").alias("oldest_t"))


_CELLS = "SELECT event_id % 4 AS job_id, event_id, event_id % 11 = 0 AS bad_time, event_id % 5 = 0 AS bad_a FROM events"


@query(f"""WITH c AS ({_CELLS}) SELECT job_id, count(*) AS rows_read, sum(CASE WHEN bad_time THEN 0 WHEN bad_a THEN 1 ELSE 2 END)::BIGINT AS points, sum(CASE WHEN bad_time THEN 2 WHEN bad_a THEN 1 ELSE 0 END)::BIGINT AS failed,
        sum(CASE WHEN bad_time THEN 0 WHEN bad_a THEN 1 ELSE 2 END)::BIGINT // 1000 AS progress_marks, CASE WHEN sum(CASE WHEN bad_time OR bad_a THEN 1 ELSE 0 END) = 0 THEN 'completed' ELSE 'completed_with_errors' END AS status FROM c GROUP BY job_id""")
def csv_job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of jobs over wide files: what was read, what became points, what failed, and the final status; one row per job, so its status is a filter away."""
    e = F.col("event_id")
    wide = readings.table(spark, sf_dir, "events").select((e % 4).alias("job_id"), F.when(e % 11 == 0, "bad").otherwise("2024-01-01 00:00:00").alias("at"), F.when(e % 5 == 0, "x").otherwise("1").alias("a"), F.lit("2").alias("b"))
    good = F.when(F.try_to_timestamp("at").isNull(), 0).otherwise(F.col("a").try_cast("double").isNotNull().cast("int") + F.col("b").try_cast("double").isNotNull().cast("int"))
    log = wide.withColumn("good", good).groupBy("job_id").agg(F.count(F.lit(1)).alias("rows_read"), F.sum("good").alias("points"), F.sum(2 - F.col("good")).alias("failed"))
    return log.select("*", F.expr("points div 1000").alias("progress_marks"), F.when(F.col("failed") == 0, "completed").otherwise("completed_with_errors").alias("status"))


_STORED = f"""{POINTS}, sp AS (SELECT domain, CASE WHEN sequence % 13 = 0 THEN repeat('s', 256) ELSE source_id END AS source_id, CASE WHEN sequence % 13 = 1 THEN NULL ELSE stream_id END AS stream_id,
        CASE sequence % 13 WHEN 2 THEN NULL WHEN 3 THEN 'nan'::DOUBLE ELSE value END AS value, CASE WHEN sequence % 13 <> 4 THEN t END AS t, sequence FROM p)"""


@query(f"""WITH {_STORED} SELECT sequence, CASE WHEN stream_id IS NULL THEN 'stream_id is null' WHEN value IS NULL THEN 'value is null' WHEN t IS NULL THEN 'timestamp is null' WHEN isnan(value) THEN 'value isn''t finite' WHEN length(source_id) > 255 THEN 'source_id is longer than 255' END AS error,
        CASE WHEN stream_id IS NULL OR value IS NULL OR t IS NULL OR isnan(value) OR length(source_id) > 255 THEN 'dead_letters' ELSE 'data_points' END AS target FROM sp""")
def stored_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of points against the rules of their table, each row by itself: what breaks one goes to the dead letters, all others are stored."""
    m = F.col("sequence") % 13
    p = readings.event_points(spark, sf_dir).select(
        "domain", F.when(m == 0, F.repeat(F.lit("s"), F.lit(256))).otherwise(F.col("source_id")).alias("source_id"), F.when(m != 1, F.col("stream_id")).alias("stream_id"),
        F.when(m == 3, float("nan")).when(m != 2, F.col("value")).alias("value"), F.when(m != 4, F.timestamp_micros("t")).alias("timestamp"), "sequence",
    )
    error = tables.DATA_POINTS.broken()
    told = tables.DATA_POINTS.conformed(p, F.timestamp_micros(F.lit(NOW))).withColumn("error", error)
    return told.select("sequence", "error", F.when(F.col("error").isNull(), "data_points").otherwise("dead_letters").alias("target"))


@query(f"""WITH {POINTS}, c AS (SELECT domain, source_id, stream_id, count(*) AS n, max(sequence) AS newest FROM p GROUP BY ALL)
    SELECT domain, source_id, stream_id, CASE WHEN newest % 5 = 0 THEN 'm/s' WHEN newest % 3 = 0 THEN 'renamed' ELSE 'first' END AS unit,
        {NOW} AS created_at, {NOW} + CASE WHEN newest % 5 = 0 THEN 2 WHEN newest % 3 = 0 THEN 1 ELSE 0 END * {S} AS updated_at FROM c""")
def stream_config_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configuration of streams, written by three commits (all, every third, every fifth) and read back with the times of its first and last change."""
    p = readings.event_points(spark, sf_dir).groupBy("domain", "source_id", "stream_id").agg(F.max("sequence").alias("newest"))
    table = snapshots.SnapshotTable(spark, lineage.folder(spark, "stream_configs"), ["domain", "source_id", "stream_id"])
    for k, (unit, every) in enumerate((("first", 1), ("renamed", 3), ("m/s", 5))):
        rows = p.where(F.col("newest") % every == 0).select("domain", "source_id", "stream_id", F.lit(unit).alias("unit"))
        for _ in range(2):  # a batch that comes twice counts once
            table.write(rows, NOW + k * S, "configs", k)
    return table.read()


_HEARD = f"""{_MESSAGES.replace("SELECT sequence, k, value, t,", "SELECT sequence, k, value, t, event_type,", 1)}, {BOUNDS_SQL},
    p2 AS (SELECT 'health' AS domain, CAST(sensor_id AS VARCHAR) AS source_id, 'bpm' AS stream_id, 'health:' || sensor_id || ':bpm' AS series_id, value, t, sequence FROM ms WHERE k % 8 NOT IN (0, 1, 2))"""
_HEARD_CLASSES = universal.CLASSIFIED.replace(f"{POINTS}, {BOUNDS_SQL}", _HEARD, 1).replace("FROM p LEFT JOIN bounds", "FROM p2 p LEFT JOIN bounds", 1)


@query(f"""WITH {_HEARD_CLASSES} SELECT ms.sequence, CASE WHEN k % 8 = 1 THEN 'parse_error' WHEN k % 8 = 0 THEN 'invalid_domain' WHEN k % 8 = 2 THEN 'validation_error' END AS error, c.classification,
        CASE WHEN k % 8 IN (0, 1, 2) THEN 'dead_letters' ELSE 'data_points' END AS target, coalesce(c.classification IN ('critical', 'warning'), false) AS alert FROM ms LEFT JOIN classified c ON c.sequence = ms.sequence""")
def message_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages from their text to the table that they end in, in one plan: parsed, checked, classified against bounds and history, judged by the rules of the table."""
    r, d = readings.event_readings(spark, sf_dir), F.col("k") % 8
    topic = F.concat_ws("/", F.when(d == 0, "iot").otherwise("health"), F.col("sensor_id").cast("string"), F.lit("bpm"), F.lit("data"))
    at = F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    made = F.to_json(F.struct(F.when(d != 2, F.col("value")).alias("value"), at.alias("timestamp"), F.create_map(F.lit("sequence"), F.col("sequence").cast("string")).alias("metadata")))
    raw = r.select(topic.alias("topic"), F.when(d == 1, F.concat(F.lit("{oops "), F.col("sequence").cast("string"))).otherwise(made).alias("payload"))
    m = readings.messages(raw, NOW)
    m = m.withColumn("sequence", F.coalesce("sequence", F.regexp_extract("payload", r"^\{oops (\d+)$", 1).try_cast("long")))
    part = lambda k: series.part(F.col("series_id"), k)
    good = m.where("error is null").select("series_id", part(1).alias("domain"), part(2).alias("source_id"), part(3).alias("stream_id"), "value", "t", "sequence")
    told = universal.classified(good, bounds(spark)).select("domain", "source_id", "stream_id", "value", F.timestamp_micros("t").alias("timestamp"), "classification", "sequence")
    told = tables.DATA_POINTS.conformed(told, F.timestamp_micros(F.lit(NOW))).withColumn("error", tables.DATA_POINTS.broken())
    bad = m.where("error is not null").select("sequence", "error", F.lit(None).cast("string").alias("classification"))
    out = told.select("sequence", "error", "classification").unionByName(bad)
    target = F.when(F.col("error").isNull(), "data_points").otherwise("dead_letters")
    return out.select("sequence", "error", "classification", target.alias("target"), F.coalesce(rules.should_alert(F.col("classification")), F.lit(False)).alias("alert"))


QUERIES, ORACLE_SQL = query.queries, query.sql
