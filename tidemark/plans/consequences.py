"""What alerts, warnings and predictions leave behind: notifications with their texts, payloads, the prediction cycle, lookups of state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.functions import rules, series
from tidemark.operators import history, lineage, metrics, predict
from tidemark.plans.base import NOW, POINTS, READINGS, THRESHOLDS_SQL, Registry, thresholds
from tidemark.plans.outcomes import _AVERAGE, _ELIGIBLE, _OFFSETS, _SHORT, _TITLE, _VIOLATIONS, _average, _eligible, _offsets, _violations
from tidemark.plans.sequences import _STATS, _stats
from tidemark.sources import readings, sinks
from tidemark.sources.snapshots import FileStatistics, SnapshotTable

query = Registry()
KEYS, ORDER = ["sensor_id"], ["t", "sequence"]
S = K.SECOND
#: How long an unread notification keeps others back: five minutes, or days where readings are hours apart.
UNREAD = 5 * 86400


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.event_readings(spark, sf_dir)


_ALERTS = f"""{_VIOLATIONS}, al AS (SELECT sequence AS id, sensor_id, value, t, low, high, CASE WHEN k % 3 = 0 THEN 'resolved' ELSE 'active' END AS status FROM vio JOIN rg USING (sensor_id)),
    nt AS (SELECT id AS source_event_id, id % 4 = 0 AS is_read, t AS created_t FROM al WHERE id % 2 = 0),
    un AS (SELECT DISTINCT sensor_id FROM al WHERE status = 'active' AND id IN (SELECT source_event_id FROM nt WHERE NOT is_read AND created_t >= {NOW} - {UNREAD * S}))"""


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _violations(spark, sf_dir)
    return v.select(F.col("sequence").alias("id"), "sensor_id", "value", "t", "low", "high", F.when(F.col("k") % 3 == 0, "resolved").otherwise("active").alias("status"))


def _notifications(alerts: DataFrame) -> DataFrame:
    """A fixture: what was told before, by the alert that it was about."""
    return alerts.where("id % 2 = 0").select(F.col("id").alias("source_event_id"), (F.col("id") % 4 == 0).alias("is_read"), F.col("t").alias("created_t"))


def held_back(alerts: DataFrame, notifications: DataFrame, now: int, seconds: float = K.COOLDOWN_SECONDS) -> DataFrame:
    """(sensor_id): sensors with an unread notification, not older than this, of an alert that is still active."""
    recent = notifications.where(~F.col("is_read") & (F.col("created_t") >= now - int(seconds * K.SECOND)))
    return alerts.where("status = 'active'").join(recent, F.col("id") == F.col("source_event_id"), "left_semi").select("sensor_id").distinct()


@query(f"WITH {_ALERTS} SELECT sensor_id FROM un")
def recent_unread_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _alerts(spark, sf_dir)
    return held_back(a, _notifications(a), NOW, UNREAD)


def named(newest: DataFrame, devices: DataFrame) -> DataFrame:
    """newest with title and message. newest: (sensor_id, x: t, id, value, low, high)."""
    j = newest.withColumn("device_id", F.col("sensor_id") % 10 + 1).join(devices, "device_id", "left")
    number = lambda c: F.coalesce(F.format_string("%.2f", c), F.lit("-")) if c is not None else F.lit("-")
    bound = lambda c: F.when(F.col(c).isNull(), "-").otherwise(number(F.col(c)))
    name = F.coalesce("device_name", F.concat(F.lit("Dispositivo "), F.col("device_id").cast("string")))
    # Fixed: the words of the texts.
    message = F.concat(F.lit("Valor "), number(F.col("x.value")), F.lit(" fuera de rango físico ["), bound("x.low"), F.lit(" - "), bound("x.high"), F.lit("] en "), name)
    title = F.concat(F.lit("🚨 ALERTA CRÍTICA: Sensor "), F.col("sensor_id").cast("string"))
    return j.select(*newest.columns, title.alias("title"), message.alias("message"))


def notified(alerts: DataFrame, back: DataFrame, devices: DataFrame) -> DataFrame:
    """A notification for each sensor with an active alert that isn't held back: the alert's id, the newest value, and the texts.

    devices: (device_id, device_name). A bound that lacks is written as a dash.
    """
    newest = alerts.where("status = 'active'").groupBy("sensor_id").agg(F.min("id").alias("alert_id"), F.max(F.struct("t", "id", "value", "low", "high")).alias("x"))
    j = named(newest.join(back, "sensor_id", "left_anti"), devices)
    return j.select(
        "sensor_id", F.lit("alert").alias("source"), F.col("alert_id").alias("source_event_id"), F.lit("critical").alias("severity"),
        "title", "message", F.lit(False).alias("is_read"), F.col("x.t").alias("created_t"),
    )


_TOLD = f"""{_ALERTS}, nw AS (SELECT sensor_id, min(id) AS alert_id, arg_max(struct_pack(v := value, lo := low, hi := high, t := t), (t, id)) AS x FROM al WHERE status = 'active' AND sensor_id NOT IN (SELECT sensor_id FROM un) GROUP BY sensor_id),
    tl AS (SELECT sensor_id, 'alert' AS source, alert_id AS source_event_id, 'critical' AS severity, '🚨 ALERTA CRÍTICA: Sensor ' || sensor_id AS title,
        'Valor ' || printf('%.2f', x.v) || ' fuera de rango físico [' || CASE WHEN x.lo IS NULL THEN '-' ELSE printf('%.2f', x.lo) END || ' - ' || CASE WHEN x.hi IS NULL THEN '-' ELSE printf('%.2f', x.hi) END || '] en ' || coalesce(s_name, 'Dispositivo ' || (sensor_id % 10 + 1)) AS message,
        false AS is_read, x.t AS created_t FROM nw LEFT JOIN supplier ON s_suppkey = sensor_id % 10 + 1 AND s_suppkey % 3 <> 0)"""


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _alerts(spark, sf_dir)
    devices = readings.table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("device_id"), F.col("s_name").alias("device_name"))
    return notified(a, held_back(a, _notifications(a), NOW, UNREAD), devices)


@query(f"WITH {_TOLD} SELECT * FROM tl")
def alert_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(spark, sf_dir)


@query(f"WITH {_TOLD} SELECT source_event_id AS alert_id, created_t, 'pending' AS status, 0 AS attempts FROM tl")
def push_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sender outside of the engine has to push: a row for each new notification."""
    return _told(spark, sf_dir).select(F.col("source_event_id").alias("alert_id"), "created_t", F.lit("pending").alias("status"), F.lit(0).alias("attempts"))


def alert_run(alerts: DataFrame, notifications: DataFrame, devices: DataFrame, now: int, seconds: float = K.COOLDOWN_SECONDS) -> DataFrame:
    """The alert path in one plan: a row for each sensor with an active alert, with the alert as it stands after all its updates, the sensor's state,
    and the notification and push that follow, or null texts and `held_back` where an unread one of the last seconds is about the sensor.

    Alerts meet their notifications by id, then one aggregate by sensor, combined before its exchange, says all.
    """
    unread = notifications.where(~F.col("is_read") & (F.col("created_t") >= now - int(seconds * K.SECOND))).select(F.col("source_event_id").alias("id"), F.lit(True).alias("unread")).distinct()
    by_sensor = alerts.where("status = 'active'").join(unread, "id", "left").groupBy("sensor_id").agg(
        F.min("id").alias("alert_id"), F.max(F.struct("t", "id", "value", "low", "high")).alias("x"), F.count(F.lit(1)).alias("updates"), F.bool_or(F.coalesce("unread", F.lit(False))).alias("held"),
    )
    free = ~F.col("held")
    return named(by_sensor, devices).select(
        "sensor_id", "alert_id", F.col("x.value").alias("value"), F.col("x.t").alias("t"), "updates", F.lit("ALERT").alias("state"),
        F.when(free, F.col("title")).alias("title"), F.when(free, F.col("message")).alias("message"), F.when(free, "pending").otherwise("held_back").alias("push"),
    )


@query(f"""WITH {_TOLD}, aa AS (SELECT sensor_id, min(id) AS alert_id, arg_max(value, (t, id)) AS value, max(t) AS t, count(*) AS updates FROM al WHERE status = 'active' GROUP BY sensor_id)
    SELECT aa.sensor_id, alert_id, value, t, updates, 'ALERT' AS state, title, message, CASE WHEN tl.sensor_id IS NULL THEN 'held_back' ELSE 'pending' END AS push FROM aa LEFT JOIN tl USING (sensor_id)""")
def alert_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From violating readings to the alert, the state, the notification and the push of each sensor."""
    a = _alerts(spark, sf_dir)
    devices = readings.table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("device_id"), F.col("s_name").alias("device_name"))
    return alert_run(a, _notifications(a), devices, NOW, UNREAD)


_MESSAGE = """'El valor ' || CASE WHEN d > 0 THEN 'subió' ELSE 'cambió' END || ' ' || printf('%.2f', d) || ' unidades desde ' || printf('%.2f', previous_value) || CASE WHEN list_contains(triggered, 'abs_slope') OR list_contains(triggered, 'rel_slope') THEN '. en ' || printf('%.0f', s) || ' segundos' ELSE '' END"""


@query(f"""WITH {_ELIGIBLE}, w AS (SELECT * FROM el WHERE open_ AND NOT band AND coalesce(len(triggered), 0) > 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY t DESC, sequence DESC) AS place FROM w)
    SELECT sensor_id, {_TITLE} AS title, {_MESSAGE} AS message, '{{"sensor_id":' || sensor_id || ',"sequence":' || sequence || ',"triggered":["' || array_to_string(triggered, '","') || '"],"delta":"' || printf('%.2f', d) || '"}}' AS payload, t AS created_t FROM n WHERE place = 1""")
def warning_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active warning of each sensor with its title, message and JSON payload."""
    w = _eligible(spark, sf_dir).where("open and not band and spiked")
    delta, seconds = F.abs(F.col("value") - F.col("previous_value")), (F.col("t") - F.col("previous_t")) / 1e6
    payload = F.to_json(F.struct("sensor_id", "sequence", "triggered", F.format_string("%.2f", delta).alias("delta")))
    w = w.select("sensor_id", "t", "sequence", rules.spike_title(F.lit("warning"), F.col("triggered")).alias("title"), rules.spike_message(delta, F.col("previous_value"), seconds, F.col("triggered")).alias("message"), payload.alias("payload"), F.col("t").alias("created_t"))
    return sinks.latest(w, KEYS, ORDER, ["title", "message", "payload", "created_t"])


_MODELS = "md AS (SELECT sensor_id, arg_max(sequence, (t, sequence)) AS model_id FROM r WHERE k < 30 AND k % 2 = 0 GROUP BY sensor_id)"


@query(f"""WITH {_AVERAGE}, {_OFFSETS}, {_MODELS}, nn AS (SELECT sensor_id, max(sequence) AS newest, count(*) AS n_all FROM r GROUP BY sensor_id),
        pe AS (SELECT sensor_id, coalesce(last, 0) AS last, newest FROM nn LEFT JOIN off_ USING (sensor_id) WHERE newest > coalesce(last, 0))
    SELECT pe.sensor_id, coalesce(model_id, -pe.sensor_id) AS model_id, CASE WHEN predicted_value IS NOT NULL THEN newest * 1000 + pe.sensor_id % 1000 END AS prediction_id, predicted_value, last AS offset_before, CASE WHEN predicted_value IS NOT NULL THEN newest ELSE last END AS offset_after
    FROM pe LEFT JOIN pd USING (sensor_id) LEFT JOIN md USING (sensor_id)""")
def prediction_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cycle over all sensors with news: a prediction with its id and model, and offsets that move only where there is one."""
    r = _readings(spark, sf_dir)
    models = sinks.latest(r.where("k < 30 and k % 2 = 0").select("sensor_id", F.col("sequence").alias("model_id"), F.col("t").alias("trained_t")), KEYS, ["trained_t", "model_id"], ["model_id"])
    return predict.cycle(predict.pending(r, _offsets(r)), _average(spark, sf_dir), models)


@query(f"""WITH {_SHORT}, {_OFFSETS}, {_MODELS}, {THRESHOLDS_SQL}, nn AS (SELECT sensor_id, max(sequence) AS newest FROM r GROUP BY sensor_id),
        pe AS (SELECT sensor_id, coalesce(last, 0) AS last, newest FROM nn LEFT JOIN off_ USING (sensor_id) WHERE newest > coalesce(last, 0)),
        f AS (SELECT sensor_id, min(id) AS id FROM th WHERE id % 10 <> 1 OR sensor_id % 3 = 0 GROUP BY sensor_id),
        b AS (SELECT sensor_id, low AS wl, high AS wh FROM th WHERE id % 10 = 1 AND sensor_id % 3 = 0),
        ev AS (SELECT pd.sensor_id, th.id AS threshold_id, CASE WHEN severity IN ('critical', 'warning') THEN severity ELSE 'notice' END AS event_type FROM pd JOIN f USING (sensor_id) JOIN th ON th.id = f.id LEFT JOIN b ON b.sensor_id = pd.sensor_id
            WHERE NOT (wl IS NOT NULL AND predicted_value >= wl AND predicted_value <= wh)
                AND CASE condition_type WHEN 'greater_than' THEN predicted_value > low WHEN 'less_than' THEN predicted_value < low ELSE low IS NOT NULL AND high IS NOT NULL AND (predicted_value < low OR predicted_value > high) END
                AND pd.sensor_id NOT IN (SELECT sensor_id FROM r WHERE event_type = 'error' AND t >= {NOW} - {36 * 3600 * S}))
    SELECT pe.sensor_id, coalesce(model_id, -pe.sensor_id) AS model_id, CASE WHEN predicted_value IS NOT NULL THEN newest * 1000 + pe.sensor_id % 1000 END AS prediction_id, predicted_value, last AS offset_before, CASE WHEN predicted_value IS NOT NULL THEN newest ELSE last END AS offset_after, threshold_id, event_type
    FROM pe LEFT JOIN pd USING (sensor_id) LEFT JOIN md USING (sensor_id) LEFT JOIN ev USING (sensor_id)""")
def incremental_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cycle over a stored table of three commits, older readings first: only files with the last values of sensors with news are opened."""
    r = _readings(spark, sf_dir).select("sensor_id", "t", "sequence", "value", "k", "event_type")
    table = SnapshotTable(spark, lineage.folder(spark, "readings"), statistics=FileStatistics())
    edges = [NOW - days * 86400 * S for days in (20, 10)]
    for n, (lo, hi) in enumerate(zip([None, *edges], [*edges, None])):
        rows = r.where((F.lit(True) if lo is None else F.col("t") >= lo) & (F.lit(True) if hi is None else F.col("t") < hi))
        table.write(rows, NOW, "readings", n)
    models = sinks.latest(r.where("k < 30 and k % 2 = 0").select("sensor_id", F.col("sequence").alias("model_id"), F.col("t").alias("trained_t")), KEYS, ["trained_t", "model_id"], ["model_id"])
    recent = r.where("event_type = 'error'").select("sensor_id", F.lit("PRED_THRESHOLD_BREACH").alias("event_code"), F.lit("acknowledged").alias("status"), F.col("t").alias("created_t"))
    rules_ = thresholds(spark, sf_dir).where("id % 10 <> 1 or sensor_id % 3 = 0")
    return predict.cycle_from_files(table, _offsets(r), models, rules_, recent, NOW, 3, 36 * 3600)


_DELTAS = f"{READINGS}, dt AS (SELECT sequence AS id, sensor_id, value AS abs_delta, CASE WHEN k % 5 = 0 THEN NULL ELSE 'warning' END AS severity, k % 3 <> 0 AS is_active, CASE WHEN k % 4 = 0 THEN k % 6 END AS consecutive FROM r WHERE k < 40)"


@query(f"""WITH {_DELTAS} SELECT sensor_id, arg_min(abs_delta, id) FILTER (WHERE is_active) AS abs_delta, arg_min(coalesce(severity, 'warning'), id) FILTER (WHERE is_active) AS severity,
    coalesce(nullif(arg_min(consecutive, id) FILTER (WHERE is_active AND consecutive IS NOT NULL), 0), 3) AS required FROM dt GROUP BY sensor_id""")
def delta_threshold_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each sensor its first active rule for changes, and how many violations in a row make an alert: the first setting that is given, else three."""
    k = F.col("k")
    d = _readings(spark, sf_dir).where("k < 40").select(F.col("sequence").alias("id"), "sensor_id", F.col("value").alias("abs_delta"), F.when(k % 5 != 0, "warning").alias("severity"), (k % 3 != 0).alias("is_active"), F.when(k % 4 == 0, k % 6).alias("consecutive"))
    first = F.min(F.when(F.col("is_active"), F.struct("id", "abs_delta", F.coalesce("severity", F.lit("warning")).alias("severity")))).alias("x")
    need = F.min(F.when(F.col("is_active") & F.col("consecutive").isNotNull(), F.struct("id", "consecutive"))).alias("c")
    return d.groupBy("sensor_id").agg(first, need).select("sensor_id", "x.abs_delta", "x.severity", F.coalesce(F.nullif("c.consecutive", F.lit(0)), F.lit(K.CONSECUTIVE)).alias("required"))


@query(f"WITH {THRESHOLDS_SQL} SELECT sensor_id, min(id) AS threshold_id, arg_min(struct_pack(low := low, high := high), id).low AS low, arg_min(struct_pack(low := low, high := high), id).high AS high FROM th WHERE condition_type = 'out_of_range' GROUP BY sensor_id")
def physical_range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each sensor its first rule of the kind out_of_range."""
    th = thresholds(spark, sf_dir).where("condition_type = 'out_of_range'")
    return th.groupBy("sensor_id").agg(F.min(F.struct("id", "low", "high")).alias("x")).select("sensor_id", F.col("x.id").alias("threshold_id"), "x.low", "x.high")


_SENSORS = "sn AS (SELECT sensor_id, CASE sensor_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'normal' WHEN 2 THEN 'WARNING' WHEN 3 THEN 'ALERT' WHEN 4 THEN 'stale' ELSE 'broken' END AS state, CASE WHEN sensor_id % 4 <> 0 THEN sensor_id % 20 END AS valid_count, CASE WHEN sensor_id % 5 <> 0 THEN 12 END AS least FROM (SELECT DISTINCT sensor_id FROM r) WHERE sensor_id % 7 <> 0)"


def _sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, m = F.col("sensor_id"), F.col("sensor_id") % 6
    state = F.when(m == 1, "normal").when(m == 2, "WARNING").when(m == 3, "ALERT").when(m == 4, "stale").when(m == 5, "broken")
    return _readings(spark, sf_dir).select("sensor_id").distinct().where("sensor_id % 7 <> 0").select("sensor_id", state.alias("state"), F.when(s % 4 != 0, s % 20).alias("valid_count"), F.when(s % 5 != 0, 12).alias("least"))


@query(f"""WITH {READINGS}, {_SENSORS}, q AS (SELECT DISTINCT sensor_id FROM r), st AS (SELECT q.sensor_id, CASE WHEN sn.sensor_id IS NULL THEN 'UNKNOWN' WHEN upper(coalesce(state, 'INITIALIZING')) IN ('INITIALIZING', 'NORMAL', 'WARNING', 'ALERT', 'STALE', 'UNKNOWN') THEN upper(coalesce(state, 'INITIALIZING')) ELSE 'UNKNOWN' END AS state,
        coalesce(valid_count, 0) AS valid_count, coalesce(least, 10) AS least FROM q LEFT JOIN sn USING (sensor_id))
    SELECT *, state IN ('NORMAL', 'WARNING', 'ALERT') AS can_generate, CASE WHEN state NOT IN ('NORMAL', 'WARNING', 'ALERT') THEN state END AS blocked_by FROM st""")
def sensor_state_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each sensor that sends, with what stands in where it isn't known, and whether it may raise events."""
    asked = _readings(spark, sf_dir).select("sensor_id").distinct()
    j = asked.join(_sensors(spark, sf_dir).withColumn("known", F.lit(True)), "sensor_id", "left")
    state = rules.state_of(F.coalesce("known", F.lit(False)), F.col("state"))
    j = j.select("sensor_id", state.alias("state"), F.coalesce("valid_count", F.lit(0)).alias("valid_count"), F.coalesce("least", F.lit(K.WARM_UP_READINGS)).alias("least"))
    return j.select("*", (~F.col("state").isin(*K.BLOCKING_STATES)).alias("can_generate"), F.when(F.col("state").isin(*K.BLOCKING_STATES), F.col("state")).alias("blocked_by"))


@query(f"WITH {READINGS}, {_SENSORS} SELECT sensor_id FROM sn WHERE upper(state) IN ('NORMAL', 'WARNING', 'ALERT') ORDER BY sensor_id")
def active_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sensors(spark, sf_dir).where(F.upper("state").isin("NORMAL", "WARNING", "ALERT")).select("sensor_id").orderBy("sensor_id")


@query(f"""WITH {READINGS} SELECT sequence, CAST(sensor_id AS VARCHAR) AS sensor_id, CAST(value AS VARCHAR) AS value, CAST(CASE WHEN k % 3 = 0 THEN t ELSE t + 1000 END AS VARCHAR) AS at, sensor_id % 2 = 0 AS iot, 'sensor_' || sensor_id AS source_id, CAST(sensor_id AS VARCHAR) AS stream_id FROM r""")
def stream_sink_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as rows of text for a stream, and as points: the device's time goes before that of arrival."""
    r = _readings(spark, sf_dir).withColumn("device_t", F.when(F.col("k") % 3 == 0, F.col("t"))).withColumn("arrived", F.col("t") + 1000)
    text = lambda c: F.col(c).cast("string")
    key = series.of_sensor(F.col("sensor_id"))
    return r.select("sequence", text("sensor_id").alias("sensor_id"), text("value").alias("value"), F.coalesce("device_t", "arrived").cast("string").alias("at"), (F.col("sensor_id") % 2 == 0).alias("iot"), series.part(key, 2).alias("source_id"), series.part(key, 3).alias("stream_id"))


@query(f"""WITH {POINTS}, ep AS (SELECT *, count(*) FILTER (WHERE sequence % 23 = 0) OVER (PARTITION BY series_id ORDER BY t, sequence ROWS UNBOUNDED PRECEDING) AS epoch FROM p)
    SELECT sequence, epoch, lag(value) OVER (PARTITION BY series_id, epoch ORDER BY t, sequence) AS previous_value FROM ep""")
def history_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value before, in series whose history is cleared now and then: each reset begins an epoch of its own."""
    order = ["t", "sequence"]
    p = readings.event_points(spark, sf_dir)
    p = p.withColumn("epoch", F.count_if(F.col("sequence") % 23 == 0).over(history.upto(["series_id"], order)))
    return p.select("sequence", "epoch", F.lag("value").over(history.by(["series_id", "epoch"], order)).alias("previous_value"))


@query(f"""WITH {_STATS} SELECT sensor_id, readings, round(avg_lag_ms, 2) AS avg_lag_ms, max_lag_ms, out_of_order, CASE WHEN out_of_order::DOUBLE / readings > 0.01 THEN 'FAIL' WHEN coalesce(max_lag_ms > 200, false) THEN 'WARN' ELSE 'OK' END AS verdict FROM st WHERE sensor_id = 7""")
def sensor_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diagnostics report of one sensor: the filter goes down to the scan, before the windows."""
    verdict, _ = metrics.verdict(F.col("max_lag_ms"), F.col("out_of_order"), F.col("readings"))
    return _stats(spark, sf_dir).where("sensor_id = 7").select("sensor_id", "readings", F.round("avg_lag_ms", 2).alias("avg_lag_ms"), "max_lag_ms", "out_of_order", verdict.alias("verdict"))


QUERIES, ORACLE_SQL = query.queries, query.sql
