"""The stored tables: columns, what must be there, and what a row breaks, judged row by row so that one bad row stops no other."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Kept:
    """A column: its DDL type, whether it must be there, its greatest length, and what stands in for a null (`now`: the time of writing)."""

    kind: str
    required: bool = False
    most: int | None = None
    default: object = None


@dataclass(frozen=True)
class Table:
    name: str
    columns: dict[str, Kept]
    keys: tuple[str, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)

    def schema(self) -> T.StructType:
        ddl = ", ".join(f"{c} {k.kind}{' not null' if k.required else ''}" for c, k in self.columns.items())
        return T.StructType.fromDDL(ddl)

    def conformed(self, rows: DataFrame, now: Column) -> DataFrame:
        """rows with the table's columns and types; columns that they lack are null, nulls get their defaults."""
        def one(c: str, k: Kept) -> Column:
            value = F.col(c) if c in rows.columns else F.lit(None)
            other = now if k.default == "now" else F.lit(k.default)
            return (value if k.default is None else F.coalesce(value.cast(k.kind), other.cast(k.kind))).cast(k.kind).alias(c)

        return rows.select(*(one(c, k) for c, k in self.columns.items()), *(F.col(c) for c in rows.columns if c not in self.columns))

    def broken(self) -> Column:
        """The first rule that a row of the table's columns breaks, null if none."""
        rules = [F.when(F.col(c).isNull(), f"{c} is null") for c, k in self.columns.items() if k.required]
        rules += [F.when(F.isnan(c) | (F.abs(c) == float("inf")), f"{c} isn't finite") for c, k in self.columns.items() if k.kind == "double"]
        rules += [F.when(F.length(c) > k.most, f"{c} is longer than {k.most}") for c, k in self.columns.items() if k.most]
        rules += [F.when(~F.coalesce(F.expr(check), F.lit(True)), f"breaks {name}") for name, check in self.checks.items()]
        return F.coalesce(*rules, F.lit(None).cast("string"))


NAME, SHORT, TIME = Kept("string", True, 255), Kept("string", True, 50), Kept("timestamp", default="now")
META = Kept("map<string,string>")
LIMITS = ("physical_min", "physical_max", "operational_min", "operational_max", "warning_min", "warning_max", "critical_min", "critical_max", "max_abs_delta", "max_rel_delta", "noise_abs_threshold")
# Fixed: the stored tables of points, their streams, bounds, alerts, files, keys and audit.
STREAM_CONFIGS = Table("stream_configs", {
    "stream_id": NAME, "source_id": NAME, "domain": Kept("string", True, 50, "generic"), "display_name": Kept("string", most=255), "unit": Kept("string", most=50),
    "enable_ml_prediction": Kept("boolean", default=True), "enable_alerting": Kept("boolean", default=True), "domain_metadata": META, "created_at": TIME, "updated_at": TIME,
}, ("stream_id", "source_id", "domain"))
VALUE_CONSTRAINTS = Table("value_constraints", {
    "stream_config_id": Kept("long", True), **dict.fromkeys(LIMITS, Kept("double")), "z_score_threshold": Kept("double", default=3.0),
    "consecutive_violations_required": Kept("int", default=1), "cooldown_seconds": Kept("int", default=300), "created_at": TIME, "updated_at": TIME,
}, ("stream_config_id",))
DATA_POINTS = Table("data_points", {
    "stream_id": NAME, "source_id": NAME, "domain": SHORT, "value": Kept("double", True), "timestamp": Kept("timestamp", True), "classification": Kept("string", most=50, default="normal"),
    "sequence": Kept("long"), "domain_metadata": META, "ingested_at": TIME,
})
STREAM_ALERTS = Table("stream_alerts", {
    "stream_id": NAME, "source_id": NAME, "domain": SHORT, "severity": Kept("string", True, 20), "value": Kept("double", True), "threshold_violated": Kept("string", most=100), "message": Kept("string"),
    "triggered_at": TIME, "resolved_at": Kept("timestamp"), "is_active": Kept("boolean", default=True), "resolution_reason": Kept("string", most=255),
})
CSV_IMPORT_JOBS = Table("csv_import_jobs", {
    "id": Kept("string", True, 36), "source_id": Kept("string", most=255), "domain": Kept("string", most=50), "filename": Kept("string", most=500), "status": Kept("string", most=20, default="pending"),
    **dict.fromkeys(("total_rows", "processed_rows", "inserted_rows", "rejected_rows"), Kept("int", default=0)), "error": Kept("string"), "created_at": TIME, "started_at": Kept("timestamp"), "completed_at": Kept("timestamp"),
}, ("id",))
API_KEYS = Table("api_keys", {
    "key_hash": Kept("string", True, 64), "key_prefix": Kept("string", True, 8), "role": Kept("string", True, 20, "source_writer"), "allowed_source_id": Kept("string", most=255), "allowed_domains": Kept("array<string>"),
    "is_active": Kept("boolean", default=True), "created_at": TIME, "last_used_at": Kept("timestamp"), "created_by": Kept("string", most=255),
}, ("key_hash",), {"chk_role": "role in ('admin', 'source_writer', 'read_only')", "chk_admin_permissions": "role <> 'source_writer' or allowed_source_id is not null"})
INGESTION_AUDIT_LOG = Table("ingestion_audit_log", {
    "series_id": Kept("string", True, 500), "domain": SHORT, "source_id": NAME, "value": Kept("double"), "classification": Kept("string", most=50), "transport": Kept("string", True, 20), "api_key_hash": Kept("string", most=64),
    "client_ip": Kept("string"), "data_timestamp": Kept("timestamp", True), "ingested_at": TIME, "status": Kept("string", True, 20), "error_message": Kept("string"), "metadata": META,
})
TABLES = {t.name: t for t in (STREAM_CONFIGS, VALUE_CONSTRAINTS, DATA_POINTS, STREAM_ALERTS, CSV_IMPORT_JOBS, API_KEYS, INGESTION_AUDIT_LOG)}
