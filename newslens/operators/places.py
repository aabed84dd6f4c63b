"""Places of rows in an order, without a window over all rows.

Rows are written in order: range partitions, each a file or several, whose names rise with the ranges. A row's place is
its place in its file plus the rows of the files before it, and only the files' sizes, one row per file, are
added up in one task. The written table also fixes the ranges, which are drawn by sampling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newslens.session import shared_path


def file_places(spark: SparkSession, path: str, into: str = "place") -> DataFrame:
    """The rows of a Parquet table that was written in order, with their places in it from 1 on."""
    table = spark.read.parquet(path)
    rows = table.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    # one row per file
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    before = sizes.select("_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return rows.join(before, "_file").select(*table.columns, (F.col("_before") + F.col("_at") + 1).alias(into))


def numbered(rows: DataFrame, order: list[Column], into: str = "rank") -> DataFrame:
    """``rows``, written once in ``order``, with their place in it; the order must leave no ties for places to be the same in every run."""
    path = shared_path(rows.sparkSession, "in-order")
    rows.orderBy(*order).write.parquet(path)
    return file_places(rows.sparkSession, path, into)
