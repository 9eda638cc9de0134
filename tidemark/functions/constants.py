"""Fixed values of the domain: limits, noise floors, default bounds and intervals."""

# Fixed: hard limits of a value by sensor type.
GUARD_LIMITS = {
    "temperature": (-100.0, 500.0),
    "humidity": (0.0, 100.0),
    "pressure": (0.0, 2000.0),
    "air_quality": (0.0, 10000.0),
    "voltage": (0.0, 1000.0),
    "power": (0.0, 1_000_000.0),
    "ph": (0.0, 14.0),
}
# Fixed: the narrower ranges of the message path; types that aren't listed take those of "unknown".
MESSAGE_RANGES = {
    "temperature": (-50.0, 100.0),
    "humidity": (0.0, 100.0),
    "pressure": (800.0, 1200.0),
    "co2": (0.0, 10000.0),
    "unknown": (-1e9, 1e9),
}
# Fixed: absolute and relative changes below which a value's change is noise.
NOISE_FLOORS = {
    "temperature": (0.5, 0.02),
    "humidity": (2.0, 0.03),
    "air_quality": (50.0, 0.10),
    "voltage": (1.0, 0.05),
    "power": (10.0, 0.10),
    "pressure": (0.5, 0.005),
    "default": (0.1, 0.01),
}
# Fixed: types for which a value of zero is suspicious.
SUSPICIOUS_ZERO_TYPES = ("temperature", "humidity", "pressure", "ph")
BOUNDS = (
    "physical_min", "physical_max", "operational_min", "operational_max", "warning_min", "warning_max",
    "critical_min", "critical_max", "max_abs_delta", "max_rel_delta",
)
# Fixed: bounds by domain and stream, in the order of BOUNDS.
STREAM_BOUNDS = {
    ("infrastructure", "cpu"): (0.0, 100.0, 0.0, 90.0, None, 80.0, None, 95.0, None, None),
    ("infrastructure", "memory"): (0.0, 100.0, 0.0, 90.0, None, 85.0, None, 95.0, None, None),
    ("infrastructure", "disk"): (0.0, 100.0, 0.0, 85.0, None, 80.0, None, 90.0, None, None),
    ("finance", "price"): (0.0, None, None, None, None, None, None, None, None, 10.0),
    ("finance", "volume"): (0.0, None, None, None, None, None, None, None, None, None),
    ("health", "bpm"): (30.0, 220.0, 50.0, 180.0, 45.0, 160.0, 40.0, 200.0, None, None),
    ("health", "spo2"): (0.0, 100.0, 90.0, 100.0, 88.0, None, 85.0, None, None, None),
}
# Fixed: states of a sensor and the states that may follow each.
TRANSITIONS = {
    "INITIALIZING": ("NORMAL", "STALE"),
    "NORMAL": ("WARNING", "ALERT", "STALE"),
    "WARNING": ("NORMAL", "ALERT", "STALE"),
    "ALERT": ("NORMAL", "STALE"),
    "STALE": ("INITIALIZING",),
}
BLOCKING_STATES = ("UNKNOWN", "INITIALIZING", "STALE")

SECOND = 1_000_000  # microseconds
# Fixed: intervals and limits.
FUTURE_SECONDS, PAST_SECONDS, MESSAGE_PAST_SECONDS = 300, 30 * 86400, 86400
MESSAGE_VALUE_LIMIT = 1e12
ZERO_TOLERANCE, MESSAGE_ZERO_TOLERANCE = 1e-6, 1e-10
FRESH_SECONDS, COOLDOWN_SECONDS, DEDUP_SECONDS, THROTTLE_SECONDS, EVENT_SECONDS = 600, 300, 300, 1, 600
LEAST_SLOPE_SECONDS, GENERIC_NOISE = 1.0, (0.1, 0.01)
WARM_UP_READINGS, CONSECUTIVE = 10, 3
LIMITER_SECONDS = 300
RATE_WINDOW_SECONDS, SENSOR_LIMIT, DEVICE_LIMIT, IP_LIMIT = 60, 60, 300, 1000
TIMING_SAMPLES, EXPECTED_MS, TOLERANCE_MS, LAG_WARN_MS, OUT_OF_ORDER_FAIL = 100, 1000.0, 100.0, 200.0, 0.01
EXPLAIN_SCORE, EXPLAIN_BATCH = 0.8, 50
DLQ_LENGTH, DLQ_PAYLOAD, DLQ_ERROR, DLQ_RETRIES, DLQ_MAX_AGE = 10_000, 5000, 1000, 3, 3600
BREAKER_FAILURES, BREAKER_RECOVERY_SECONDS, BREAKER_SUCCESSES = 5, 30, 2
