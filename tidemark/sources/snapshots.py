"""Tables that are written by commits: readers see whole commits only, a batch that comes twice counts once, writers are told apart.

A table is a folder with Parquet files below `data`, each commit's in a folder of its own, and small files below `commits`,
one for each version, that list the folders a reader takes. A commit is one file that must not be there yet: it is written
aside and renamed, which fails if another writer was first; then the commit is tried again on what that one has left. Files
of a job that broke are in no version, so nobody reads them.

Changes by key are written as they come and joined when read: of the rows of a key those of the newest commit stand, with the
time of the first as created_at and that of the last as updated_at. compacted writes them as one.

A table with statistics says for each of its files which keys it has, how many rows of each, and between which times. So a
reader that wants the newest rows of some keys opens no other files. They are written before the commit, and one with it.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: How often a commit is tried again if other writers are first.
TRIES = 50


class Conflict(Exception):
    """Another writer has changed what this commit is made from."""


@dataclass(frozen=True)
class FileStatistics:
    """What is kept of each file and key: n, first_t and last_t of the rows with a value, and newest, the largest sequence of all rows.

    files: how many a commit has; by default as many as its size asks for.
    """

    key: str = "sensor_id"
    time: str = "t"
    sequence: str = "sequence"
    value: str = "value"
    files: int | None = None

    def laid_out(self, rows: DataFrame) -> DataFrame:
        """rows by ranges of key and time, so that a file has few keys, and a key of many rows has files of its own."""
        return rows.repartitionByRange(*([self.files] if self.files else []), self.key, self.time).sortWithinPartitions(self.key, self.time)

    def of(self, rows: DataFrame) -> DataFrame:
        """rows: with their file. Null and NaN values count as none; rows without a time are older than all others."""
        valued = F.col(self.value).isNotNull() & ~F.isnan(F.col(self.value).cast("double"))
        t = F.when(valued, F.coalesce(F.col(self.time).cast("long"), F.lit(-(2**63))))
        return rows.groupBy("file", self.key).agg(F.count(t).alias("n"), F.min(t).alias("first_t"), F.max(t).alias("last_t"), F.max(self.sequence).alias("newest"))

    def holders(self, stats: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
        """(file): files that can hold one of the n newest rows of a wanted key. wanted: (key), each once.

        Going back from the file that begins last, the first time of the file with which n rows are together is a bound: n rows at
        least aren't older. A file that ends before it has none of the newest n, ties included.
        """
        own = stats.where("n > 0").join(wanted.select(self.key), self.key, "left_semi")
        back = Window.partitionBy(self.key).orderBy(F.desc("first_t"), "file")
        held = F.sum("n").over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        bound = F.max(F.when(F.col("held") >= n, F.col("first_t"))).over(Window.partitionBy(self.key))
        found = own.withColumn("held", held).withColumn("bound", bound)
        return found.where(F.col("bound").isNull() | (F.col("last_t") >= F.col("bound"))).select("file").distinct()


class SnapshotTable:
    """A table below a folder. keys: columns that tell rows apart; without them rows are only added. statistics: of a table without keys."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str] | None = None, statistics: FileStatistics | None = None):
        if keys and statistics:
            raise ValueError("rows of a table with keys can be replaced, so its files have no statistics")
        self.spark, self.folder, self.keys, self.statistics = spark, folder.rstrip("/"), keys, statistics
        jvm = spark.sparkContext._jvm
        self._path, self._io = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        root = self._path(self.folder)
        self._fs = root.getFileSystem(conf)
        self._fs.mkdirs(self._path(f"{self.folder}/commits"))
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), conf)
        self._once = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        self._once[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE

    def _name(self, version: int):
        return self._path(f"{self.folder}/commits/{version:020d}.json")

    def version(self) -> int:
        """The newest version; 0 for a table without commits."""
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/commits"))]
        return max((int(n[:-5]) for n in found if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{parts: [[folder, version of its commit, time]], batches: {writer: newest batch}} of a version."""
        version = self.version() if version is None else version
        if version == 0:
            return {"parts": [], "batches": {}}
        stream = self._fs.open(self._name(version))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, manifest: dict) -> bool:
        """Whether this is now that version: no other may be it already."""
        aside, name = self._path(f"{self.folder}/commits/.{uuid.uuid4().hex}"), self._name(version)
        if self._fs.getScheme() == "file":  # a rename there would write over what is there
            own, target = aside.toUri().getPath(), name.toUri().getPath()
            with open(own, "w") as f:
                json.dump(manifest, f)
            try:
                os.link(own, target)
                return True
            except FileExistsError:
                return False
            finally:
                os.remove(own)
        stream = self._fs.create(aside, False)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        try:
            self._context.rename(aside, name, self._once)
            return True
        except Exception:
            if not self._fs.exists(name):
                raise
            self._fs.delete(aside, False)
            return False

    def _write(self, rows: DataFrame) -> str:
        part = f"data/{uuid.uuid4().hex}"
        if self.statistics is None:
            rows.write.parquet(f"{self.folder}/{part}")
            return part
        self.statistics.laid_out(rows).write.parquet(f"{self.folder}/{part}")
        written = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{part}")
        named = written.withColumn("file", F.concat(F.lit(f"{part}/"), F.col("_metadata.file_name")))
        self.statistics.of(named).write.parquet(f"{self.folder}/{self._stats(part)}")
        return part

    @staticmethod
    def _stats(part: str) -> str:
        return part.replace("data/", "stats/", 1)

    def write(self, rows: DataFrame, at: int, writer: str | None = None, batch: int | None = None) -> int:
        """Adds rows (by key: in place of those with their keys) and returns the version. at: the commit's time in microseconds.

        A batch of a writer that is not newer than its last one changes nothing. With keys, rows must hold a key once.
        """
        part = None
        for _ in range(TRIES):
            version = self.version()
            now = self.manifest(version)
            if writer is not None and now["batches"].get(writer, -1) >= batch:
                return version
            part = part or self._write(rows)
            batches = now["batches"] | ({writer: batch} if writer is not None else {})
            if self._commit(version + 1, {"parts": [*now["parts"], [part, version + 1, at]], "batches": batches}):
                return version + 1
        raise Conflict(f"{self.folder}: other writers were first {TRIES} times")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the newest). By key: also created_at and updated_at, the times of the first and the last commit with the key."""
        parts = self.manifest(version)["parts"]
        if not parts:
            raise ValueError(f"{self.folder} has no commit yet")
        return self._joined(parts)

    def _joined(self, parts: list) -> DataFrame:
        if self.keys is None:
            return self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.folder}/{p}" for p, _, _ in parts))
        out = None
        for part, version, at in parts:
            rows = self.spark.read.parquet(f"{self.folder}/{part}").withColumn("_version", F.lit(version))
            times = {c: (F.coalesce(F.col(c), F.lit(at)) if c in rows.columns else F.lit(at)).cast("long") for c in ("created_at", "updated_at")}
            rows = rows.withColumns(times)
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        kept = [c for c in out.columns if c not in (*self.keys, "_version", "created_at", "updated_at")]
        newest = F.max_by(F.struct(*kept), "_version").alias("x")
        return out.groupBy(*self.keys).agg(newest, F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at")).select(*self.keys, "x.*", "created_at", "updated_at")

    def file_statistics(self, version: int | None = None) -> DataFrame:
        """(file, key, n, first_t, last_t, newest) of the files of a version (the newest)."""
        parts = self.manifest(version)["parts"]
        if self.statistics is None or not parts:
            raise ValueError(f"{self.folder} has no commit yet" if self.statistics else f"{self.folder} is kept without statistics")
        return self.spark.read.parquet(*(f"{self.folder}/{self._stats(p)}" for p, _, _ in parts))

    def newest(self, wanted: DataFrame, n: int, version: int | None = None) -> DataFrame:
        """All rows of the files that can hold one of the n newest rows of a wanted key; no other file is opened.

        The files' names come to the driver, as they do for any scan of them. The rows of other keys in these files come along.
        """
        version = self.version() if version is None else version
        files = [r["file"] for r in self.statistics.holders(self.file_statistics(version), wanted, n).collect()]
        kind = self.spark.read.parquet(*(f"{self.folder}/{p}" for p, _, _ in self.manifest(version)["parts"][-1:])).schema
        if not files:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*(f"{self.folder}/{f}" for f in sorted(files)))

    def compacted(self, at: int) -> int:
        """Writes the newest version's rows as one part; what others add meanwhile stays behind it."""
        version = self.version()
        old = self.manifest(version)["parts"]
        if len(old) < 2:
            return version
        part = self._write(self._joined(old))
        for _ in range(TRIES):
            version = self.version()
            now = self.manifest(version)
            if now["parts"][: len(old)] != old:
                raise Conflict(f"{self.folder}: compacted by another writer meanwhile")
            if self._commit(version + 1, {"parts": [[part, old[-1][1], at], *now["parts"][len(old) :]], "batches": now["batches"]}):
                return version + 1
        raise Conflict(f"{self.folder}: other writers were first {TRIES} times")


def writing(table: SnapshotTable, writer: str):
    """For foreachBatch: a micro-batch is one commit, once, however often it runs; its time is the newest of its rows' t."""

    def write(batch: DataFrame, batch_id: int) -> None:
        at = batch.agg(F.max("t")).first()[0]
        if at is not None:
            table.write(batch, at, writer, batch_id)

    return write
