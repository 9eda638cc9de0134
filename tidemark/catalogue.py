"""All registered queries of the engine's own operators, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import consequences, guarding, ingestion, outcomes, points, sequences, upkeep

_PLANS = (points, guarding, sequences, outcomes, upkeep, ingestion, consequences)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for plan in _PLANS for name, f in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _PLANS for name, sql in plan.ORACLE_SQL.items()}
