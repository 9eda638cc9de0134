"""The prediction cycle: sensors with news since their offset, the mean of their last values, threshold events, new offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.functions import rules
from tidemark.operators import history, lineage
from tidemark.sources.snapshots import SnapshotTable


def pending(readings: DataFrame, offsets: DataFrame) -> DataFrame:
    """(sensor_id, last, newest) of sensors with readings after their offset; sensors without one start from 0. readings: (sensor_id, sequence)."""
    newest = readings.groupBy("sensor_id").agg(F.max("sequence").alias("newest"))
    j = newest.join(offsets, "sensor_id", "left").withColumn("last", F.coalesce("last", F.lit(0).cast("long")))
    return j.where("newest > last").select("sensor_id", "last", "newest")


def moving_average(readings: DataFrame, window: int = 60, least: int = 2, oldest_first: bool = True) -> DataFrame:
    """(sensor_id, predicted_value, confidence, n): the mean of each sensor's last `window` values, if there are `least` of them.

    Null values are left out (oldest_first) or count as 0. confidence is our own: the share of the window that is filled.
    """
    r = readings.where(F.col("value").isNotNull() & ~F.isnan("value")) if oldest_first else readings.withColumn("value", F.coalesce("value", F.lit(0.0)))
    last = history.newest(r, ["sensor_id"], [F.desc("t"), F.desc("sequence")], window)
    p = last.groupBy("sensor_id").agg(F.avg("value").alias("predicted_value"), F.count(F.lit(1)).alias("n"))
    return p.where(F.col("n") >= least).withColumn("confidence", F.col("n") / float(window))


def breaches(predictions: DataFrame, thresholds: DataFrame, recent: DataFrame, now: int, gap_seconds: float = K.EVENT_SECONDS) -> DataFrame:
    """Events of predictions that break their sensor's first rule: none inside of the warning band, none if one like it is recent.

    recent: (sensor_id, event_code, status, created_t).
    """
    band = thresholds.where("severity = 'warning' and condition_type = 'out_of_range'").groupBy("sensor_id").agg(F.min_by(F.struct("low", "high"), "id").alias("band"))
    first = thresholds.groupBy("sensor_id").agg(F.min(F.struct("id", "condition_type", "low", "high", "severity")).alias("r"))
    j = predictions.join(first, "sensor_id").join(band, "sensor_id", "left")
    v = F.col("predicted_value")
    inside = F.coalesce(rules.within_band(v, F.col("band.low"), F.col("band.high")), F.lit(False))
    j = j.where(~inside & rules.violates_batch(F.col("r.condition_type"), F.col("r.low"), F.col("r.high"), v))
    same = recent.where((F.col("event_code") == "PRED_THRESHOLD_BREACH") & F.col("status").isin("active", "acknowledged") & (F.col("created_t") >= now - int(gap_seconds * K.SECOND)))
    j = j.join(same.select("sensor_id").distinct(), "sensor_id", "left_anti")
    return j.select("sensor_id", v, F.col("r.id").alias("threshold_id"), rules.event_type_batch(F.col("r.severity")).alias("event_type"), F.lit("PRED_THRESHOLD_BREACH").alias("event_code"), F.lit("active").alias("status"))


def advanced(offsets: DataFrame, done: DataFrame) -> DataFrame:
    """Offsets after a cycle: new sensors are added, those with news move on. done: (sensor_id, newest)."""
    j = offsets.join(done.select("sensor_id", "newest"), "sensor_id", "full")
    return j.select("sensor_id", F.coalesce("newest", "last").alias("last"))


def to_explain(predictions: DataFrame, score: float = K.EXPLAIN_SCORE, n: int = K.EXPLAIN_BATCH) -> DataFrame:
    """The n newest anomalous predictions without an explanation."""
    blank = F.trim(F.coalesce("explanation", F.lit(""))) == ""
    return predictions.where(F.col("is_anomaly") & (F.col("anomaly_score") >= score) & blank).orderBy(F.desc("target_t"), F.desc("id")).limit(n)


def explanation_requests(anomalies: DataFrame, ranges: DataFrame) -> DataFrame:
    """(id, sensor_id, request): what an explainer outside of the engine is asked about each anomalous prediction, as JSON.

    anomalies: (id, sensor_id, predicted_value, anomaly_score); those without a value can't be asked about and go.
    ranges: (sensor_id, expected_range); sensors without one are `unknown`.
    """
    j = anomalies.where("predicted_value is not null").join(ranges, "sensor_id", "left")
    # Fixed: the names and the texts of a request.
    output = F.struct(
        F.lit("generic").alias("metric"), F.col("predicted_value").alias("observed_value"), F.coalesce("expected_range", F.lit("unknown")).alias("expected_range"), "anomaly_score",
        F.lit("sklearn_regression_iforest").alias("model"), F.lit("1.0.0").alias("model_version"),
    )
    return j.select("id", "sensor_id", F.to_json(F.struct(F.lit("industrial_iot_monitoring").alias("context"), output.alias("model_output"))).alias("request"))


def cycle(news: DataFrame, predictions: DataFrame, models: DataFrame) -> DataFrame:
    """One run over all sensors with news: (sensor_id, model_id, prediction_id, predicted_value, offset_before, offset_after).

    An id is made of the newest reading and the sensor, so a cycle that runs again gives the same. A sensor without a
    model gets one with its negative number; one without a prediction keeps its offset and is tried again.
    """
    j = news.join(predictions.select("sensor_id", "predicted_value"), "sensor_id", "left").join(models, "sensor_id", "left")
    made = F.col("predicted_value").isNotNull()
    return j.select(
        "sensor_id", F.coalesce("model_id", -F.col("sensor_id")).alias("model_id"), F.when(made, F.col("newest") * 1000 + F.col("sensor_id") % 1000).alias("prediction_id"), "predicted_value",
        F.col("last").alias("offset_before"), F.when(made, F.col("newest")).otherwise(F.col("last")).alias("offset_after"),
    )


def cycle_from_files(table: SnapshotTable, offsets: DataFrame, models: DataFrame, thresholds: DataFrame, recent: DataFrame, now: int, window: int = 60, gap_seconds: float = K.EVENT_SECONDS, digits: int = 6) -> DataFrame:
    """cycle() and breaches() in one, of a table of readings with statistics: event_type and threshold_id are null where a prediction breaks no rule.

    Which sensors have news is known from the files' statistics alone. Of the readings only files are opened that can hold one of
    the last `window` values of a sensor with news, all of one version. The next cycle takes offset_after for its offsets.
    """
    version = table.version()
    stats = table.file_statistics(version)
    news = lineage.cut(pending(stats.select("sensor_id", F.col("newest").alias("sequence")), offsets))
    rows = table.newest(news, window, version).join(news.select("sensor_id"), "sensor_id", "left_semi")
    made = moving_average(rows, window).withColumn("predicted_value", F.round("predicted_value", digits))
    made = lineage.cut(made)  # a row for each sensor with news; cycle and events both begin with it
    events = breaches(made, thresholds, recent, now, gap_seconds).select("sensor_id", "threshold_id", "event_type")
    return cycle(news, made, models).join(events, "sensor_id", "left")
