def tables_in(spark, folder, **tables):
    """Writes tables, each (rows, ddl), as the Parquet files that queries read."""
    for name, (rows, ddl) in tables.items():
        spark.createDataFrame(rows, ddl).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
