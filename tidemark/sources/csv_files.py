"""CSV files with the number of each row, whatever splits the files are read in.

Lines are read as text with the place of their split. Within a split rows are in order; each split counts its own lines, and a
window over the splits of a file, of which there are few, carries the counts on. One line is one row: a quoted cell can't
hold a line break. Blank lines aren't counted, rows with bad cells are. Files must have the same header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import guards, series


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of the lines that aren't blank, lines from 0."""
    text = spark.read.text(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    # the id rises by one from row to row of a split, for a task reads its splits one after the other
    text = text.where(F.col("text").rlike(r"\S")).withColumn("id", F.monotonically_increasing_id())
    splits = text.groupBy("file", "start").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "start", (F.coalesce(ahead, F.lit(0)) - F.col("first")).alias("shift"))
    return text.join(splits, ["file", "start"]).select("file", (F.col("id") + F.col("shift")).alias("line"), "text")


def rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, csv_row, cells): the rows below the headers, numbered from 0 in each file; cells holds texts by column."""
    found = lines(spark, path)
    headers = [r["text"] for r in found.where("line = 0").select("text").distinct().limit(2).collect()]
    if len(headers) > 1:
        raise ValueError(f"files have different headers: {headers}")
    if not headers:
        return spark.createDataFrame([], "file string, csv_row long, cells map<string, string>")
    names = spark.createDataFrame([(headers[0],)], "text string").select(F.from_csv("text", ", ".join(f"_{k} string" for k in range(headers[0].count(",") + 1))).alias("x")).first()["x"]
    names = [n for n in names if n is not None]
    kind = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    cells = F.from_csv("text", kind)
    pairs = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(cells[n] for n in names)))
    return found.where("line > 0").select("file", (F.col("line") - 1).alias("csv_row"), pairs.alias("cells"))


def points(rows: DataFrame, time_col: str, value_cols: list[str], source_id: Column, domain: str, prefix: str = "") -> DataFrame:
    """(series_id, stream_id, t, value, metadata): a point for each cell that is a number, in rows with a readable time. metadata tells its csv_row and csv_column."""
    if not value_cols:
        raise ValueError("value columns must be named")
    t = F.unix_micros(F.try_to_timestamp(F.try_element_at("cells", F.lit(time_col))))
    each = rows.withColumn("t", t).where("t is not null").withColumn("c", F.explode(F.array(*map(F.lit, value_cols))))
    value = F.try_element_at("cells", F.col("c")).try_cast("double")
    stream = F.concat(F.lit(prefix), F.col("c"))
    found = each.withColumn("value", value).where("value is not null and not isnan(value)")
    where = F.create_map(F.lit("csv_row"), F.col("csv_row").cast("string"), F.lit("csv_column"), F.col("c"))
    return found.select(series.build(F.lit(domain), source_id, stream).alias("series_id"), stream.alias("stream_id"), "t", "value", where.alias("metadata"))


def submit_error(domain: Column, value_columns: Column) -> Column:
    """Why the submission of a file is turned away; null if it isn't. value_columns: a JSON array of column names as text."""
    names = F.from_json(value_columns, "array<string>", {"mode": "PERMISSIVE"})
    listed = F.coalesce(value_columns.rlike(r"^\s*\["), F.lit(False)) & names.isNotNull()
    return F.when(~guards.not_iot(domain), "invalid_domain").when(~listed | (F.size(names) == 0), "invalid_value_columns")
