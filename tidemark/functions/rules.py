"""Threshold rules, the warning band and the classes of a point, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.functions.guards import below_or_above


def violates_online(condition: Column, low: Column, high: Column, value: Column) -> Column:
    """greater_than tests the minimum, less_than the maximum; out_of_range takes one-sided bounds."""
    hit = F.when(condition == "greater_than", value > low).when(condition == "less_than", value < high).when(condition == "out_of_range", below_or_above(value, low, high))
    return F.coalesce(hit & ~F.isnan(value), F.lit(False))


def violates_batch(condition: Column, low: Column, high: Column, value: Column) -> Column:
    """greater_than and less_than both test the minimum; out_of_range needs both bounds; equal_to tests the minimum."""
    both = low.isNotNull() & high.isNotNull() & below_or_above(value, low, high)
    hit = F.when(condition == "greater_than", value > low).when(condition == "less_than", value < low).when(condition == "out_of_range", both).when(condition == "equal_to", value == low)
    return F.coalesce(hit & ~F.isnan(value), F.lit(False))


def within_band(value: Column, low: Column, high: Column) -> Column:
    """Inside of a band that has a bound at least, ends included."""
    return (low.isNotNull() | high.isNotNull()) & ~below_or_above(value, low, high)


def violated_bound(value: Column, bounds: dict[str, Column]) -> Column:
    """The first bound that the value breaks: physical, critical, operational, then warning; null if none."""
    out = None
    for zone in ("physical", "critical", "operational", "warning"):
        for side in ("min", "max"):
            name = f"{zone}_{side}"
            hit = (value < bounds[name]) if side == "min" else (value > bounds[name])
            hit = F.coalesce(hit & ~F.isnan(value), F.lit(False))
            out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def class_of(bound: Column, delta: Column) -> Column:
    """critical for physical and critical bounds, warning for the others, anomaly for a change that is too large, else normal."""
    return F.when(bound.rlike("^(physical|critical)_"), "critical").when(bound.isNotNull(), "warning").when(delta.isNotNull(), "anomaly").otherwise("normal")


def should_alert(class_: Column) -> Column:
    return class_.isin("critical", "warning")


def should_persist(class_: Column) -> Column:
    return class_ != "rejected"


def should_publish(class_: Column) -> Column:
    return class_ == "normal"


def alert_severity(class_: Column) -> Column:
    return F.when(class_ == "critical", "CRITICAL").when(class_ == "warning", "WARNING").when(class_ == "anomaly", "ANOMALY").otherwise("INFO")


def final_state(alert: Column, warning: Column, prediction: Column) -> Column:
    return F.when(alert, "ALERT").when(warning, "WARNING").when(prediction, "PREDICTION").otherwise("UNKNOWN")


def event_type_batch(severity: Column) -> Column:
    return F.when(severity.isin("critical", "warning"), severity).otherwise("notice")


def event_type_online(severity: Column) -> Column:
    return F.when(severity.isin("info", "warning", "critical"), severity).otherwise("warning")


def spike(value: Column, micros: Column, last_value: Column, last_micros: Column, thresholds: dict[str, Column], noise_abs: Column, noise_rel: Column, least_slope_seconds: float = 0.0) -> Column:
    """The thresholds (array<string>) that a change reaches, empty if it is noise or reaches none; null without a value before.

    thresholds: abs_delta, rel_delta, abs_slope, rel_slope, of which null ones don't bind. Slopes are only looked at from
    least_slope_seconds on; a distance of zero or less counts as a millisecond.
    """
    delta = F.abs(value - last_value)
    relative = F.when(F.abs(last_value) > 1e-6, F.abs(delta / F.nullif(last_value, F.lit(0.0)))).otherwise(0.0)
    seconds = (micros - last_micros) / float(K.SECOND)
    seconds = F.when(seconds <= 0, 0.001).otherwise(seconds)
    sloped = seconds >= least_slope_seconds
    found = {"abs_delta": delta, "rel_delta": relative, "abs_slope": F.when(sloped, delta / seconds), "rel_slope": F.when(sloped, relative / seconds)}
    hits = F.array(*(F.when(found[k] >= thresholds[k], k) for k in found))
    quiet = (delta < noise_abs) & (relative < noise_rel)
    return F.when(last_value.isNull(), None).when(quiet, F.array().cast("array<string>")).otherwise(F.filter(hits, lambda x: x.isNotNull()))


def spike_title(severity: Column, triggered: Column) -> Column:
    deltas = F.array_contains(triggered, "abs_delta") | F.array_contains(triggered, "rel_delta")
    slopes = F.array_contains(triggered, "abs_slope") | F.array_contains(triggered, "rel_slope")
    # Fixed: the titles' words.
    return F.when(severity == "critical", "Cambio crítico detectado").when(deltas, "Cambio significativo en valor").when(slopes, "Cambio rápido detectado").otherwise("Variación inusual detectada")


def expected_range(low: Column, high: Column) -> Column:
    low_, high_ = low.cast("string"), high.cast("string")
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(low_, F.lit("-"), high_)).when(low.isNotNull(), F.concat(F.lit(">= "), low_)).when(high.isNotNull(), F.concat(F.lit("<= "), high_)).otherwise("unknown")


def backoff_seconds(attempt: Column, base: float = 1.0, cap: float = 30.0, factor: float = 2.0) -> Column:
    """The wait before a further attempt (from 0), without jitter."""
    return F.least(F.lit(base) * F.pow(F.lit(factor), attempt), F.lit(cap))


def dead_letter_fate(recovered: Column, retries: Column, age_seconds: Column, most: int = K.DLQ_RETRIES, max_age: int = K.DLQ_MAX_AGE) -> Column:
    """What becomes of a dead letter: recovered ones and those too old go, those tried often enough are archived, the rest go back."""
    return F.when(recovered | (age_seconds > max_age), "deleted").when(retries >= most, "archived").otherwise("requeued")


def persists_reading(class_: Column) -> Column:
    """Alerts and warnings leave their reading; clean values only renew the newest one."""
    return class_.isin("ALERT", "WARNING")


def goes_to_learning(class_: Column) -> Column:
    """Only clean values go to the learning side, never alerts or warnings."""
    return class_ == "ML_PREDICTION"


def store_of(domain: Column) -> Column:
    return F.when(F.coalesce(domain, F.lit("")) == "", "unsupported").when(domain == "iot", "iot").otherwise("universal")


def state_of(known: Column, state: Column) -> Column:
    """A sensor's state: UNKNOWN for one that isn't known or whose state can't be read, INITIALIZING for one without a state."""
    name = F.upper(F.coalesce(state, F.lit("INITIALIZING")))
    return F.when(known & name.isin(*K.TRANSITIONS, "UNKNOWN"), name).otherwise("UNKNOWN")


def spike_message(delta: Column, last_value: Column, seconds: Column, triggered: Column) -> Column:
    sloped = F.array_contains(triggered, "abs_slope") | F.array_contains(triggered, "rel_slope")
    # Fixed: the message's words.
    moved = F.when(delta > 0, "subió").otherwise("cambió")
    told = F.concat(F.lit("El valor "), moved, F.lit(" "), F.format_string("%.2f", delta), F.lit(" unidades desde "), F.format_string("%.2f", last_value))
    return F.when(sloped & (seconds > 0), F.concat(told, F.lit(". en "), F.format_string("%.0f", seconds), F.lit(" segundos"))).otherwise(told)


def change_bound(value: Column, before: Column, most: Column, most_percent: Column) -> Column:
    """The bound on changes that a value breaks against the one before: the absolute one goes first; null if it breaks none or has none before."""
    change = value - before
    relative = (before != 0) & (F.abs(change / F.nullif(before, F.lit(0.0))) * 100 > most_percent)
    return F.when(F.abs(change) > most, "max_abs_delta").when(relative, "max_rel_delta")
