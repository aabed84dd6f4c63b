"""Readers for label tables and raw classifier answers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.operators.resume import as_label_rows, latest_labels
from newslens.schema import LABEL_COLUMNS, LABEL_SCHEMA, RESPONSE_SCHEMA
from newslens.sources.sinks import current_path


def read_labels(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Label rows as stored, plainly or by ``replace_table``; cleaning decides what counts as missing.

    CSV files have a header, and every column is text: types are never guessed,
    because a month would turn into a timestamp. A byte-order mark is skipped and
    an empty cell is NULL. A quoted cell may hold line breaks, so one CSV file is
    one task; keep large label tables in Parquet.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.options(header=True, inferSchema=False, multiLine=True, escape='"')
    return reader.load(current_path(spark, path))


def read_existing(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """An earlier run's label rows, one per key, for ``upsert_labels``; empty where ``path`` does not exist.

    They have the label columns that are stored, in their types, and the key, label and event key in any case.
    Where a key has several rows the last one counts: in the order of file names, and within
    a file in that of its rows (a CSV file is read by one task, in order).
    """
    try:
        rows = read_labels(spark, path, fmt)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], LABEL_SCHEMA)
    place = F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id())
    had = {"recordKey", "label", "evento_chave", *rows.columns}
    return as_label_rows(latest_labels(rows.withColumn("_place", place), "_place"), [c for c in LABEL_COLUMNS if c in had])


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Raw classifier answers as landed by the classification stage."""
    return spark.read.schema(RESPONSE_SCHEMA).parquet(path)
