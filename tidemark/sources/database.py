"""A table of a database as a DataFrame, read in parts by ranges of a number column, with filters pushed down.

Any Python database module (DB-API 2.0) serves: tasks connect by themselves, each for its own range, and fetch rows in batches.
Rows whose number is null are in the first part, so the parts together are the table. Filters that the database can judge as
Spark does are put into its query; Spark checks the others.

    spark.dataSource.register(database.DatabaseSource)
    spark.read.format("database").schema(ddl).options(module="sqlite3", connect='{"database": "/shared/x.db"}', table="readings", partition_column="id", partitions=8).load()

Filters are pushed if spark.sql.python.filterPushdown.enabled is set in the session.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import datasource as D
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a task fetches at once.
BATCH = 10_000
_COMPARED = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}


def quoted(name: str) -> str:
    """A name of the database: parts between dots, each in quotes."""
    return ".".join('"' + part.replace('"', '""') + '"' for part in name.split("."))


def ranges(low: int | None, high: int | None, parts: int) -> list[tuple[int | None, int | None]]:
    """[from, to) of each part, None without an end: all numbers are in one of them, also those that come after low and high were asked for."""
    if low is None or parts <= 1 or high <= low:
        return [(None, None)]
    parts = min(parts, high - low + 1)
    cuts = [low + (high - low + 1) * k // parts for k in range(1, parts)]
    return list(zip([None, *cuts], [*cuts, None]))


@dataclass
class Range(InputPartition):
    low: int | None
    high: int | None

    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class DatabaseReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options, self.where = schema, dict(options), []
        self.mark = {"qmark": "?", "format": "%s", "pyformat": "%s"}[importlib.import_module(options["module"]).paramstyle]

    def _connect(self):
        return importlib.import_module(self.options["module"]).connect(**json.loads(self.options.get("connect", "{}")))

    def pushFilters(self, filters: list) -> Iterable:  # noqa: N802  the interface's name
        kinds = {f.name: f.dataType.typeName() for f in self.schema}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            number = kinds.get(name) in ("byte", "short", "integer", "long", "double", "float")
            if name in kinds and isinstance(f, (D.IsNull, D.IsNotNull)):
                self.where.append((f"{quoted(name)} IS {'NOT ' if isinstance(f, D.IsNotNull) else ''}NULL", ()))
            elif type(f) in _COMPARED and number and f.value == f.value:  # texts and times may compare by other rules there
                self.where.append((f"{quoted(name)} {_COMPARED[type(f)]} {self.mark}", (f.value,)))
            elif isinstance(f, D.In) and number and f.value and all(v is not None and v == v for v in f.value):
                self.where.append((f"{quoted(name)} IN ({', '.join([self.mark] * len(f.value))})", tuple(f.value)))
            else:
                yield f

    def _query(self, what: str, more: list[tuple[str, tuple]]) -> tuple[str, list]:
        where = [*self.where, *more]
        text = f"SELECT {what} FROM {quoted(self.options['table'])}" + (" WHERE " + " AND ".join(f"({w})" for w, _ in where) if where else "")
        return text, [v for _, values in where for v in values]

    def partitions(self) -> list[Range]:
        column, parts = self.options.get("partition_column"), int(self.options.get("partitions", "1"))
        if column is None or parts <= 1:
            return [Range(None, None)]
        db = self._connect()
        try:
            cursor = db.cursor()
            cursor.execute(*self._query(f"min({quoted(column)}), max({quoted(column)})", []))
            low, high = cursor.fetchone()
        finally:
            db.close()
        return [Range(*r) for r in ranges(low, high, parts)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(self.schema)
        column, more = quoted(self.options.get("partition_column", "")), []
        if partition.low is not None:
            more.append((f"{column} >= {self.mark}", (partition.low,)))
        if partition.high is not None:  # the first part has the nulls
            more.append((f"{column} < {self.mark}" + (f" OR {column} IS NULL" if partition.low is None else ""), (partition.high,)))
        db = self._connect()
        try:
            cursor = db.cursor()
            cursor.execute(*self._query(", ".join(quoted(f.name) for f in self.schema), more))
            while rows := cursor.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(values, f.type) for values, f in zip(zip(*rows), kind)], schema=kind)
        finally:
            db.close()


class DatabaseSource(DataSource):
    """The format `database`."""

    @classmethod
    def name(cls) -> str:
        return "database"

    def reader(self, schema: StructType) -> DatabaseReader:
        return DatabaseReader(schema, self.options)
