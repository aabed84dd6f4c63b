"""Resuming a classification: what is done, what is pending, what replaces what."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newslens.functions.text import first_filled
from newslens.schema import LABEL_COLUMNS, LABEL_SCHEMA


def row_key(rows: DataFrame) -> Column:
    """``recordKey``, else ``id``; NULL if both are missing or empty."""
    names = [c for c in ("recordKey", "id") if c in rows.columns]
    if not names:
        raise ValueError("label rows need a recordKey or an id column")
    return F.nullif(first_filled(*[F.col(c) for c in names]), F.lit(""))


def latest_labels(rows: DataFrame, version: str) -> DataFrame:
    """One row per key, the one with the highest ``version``; rows without a key are skipped.

    ``version`` must order the rows of a key (write time, batch number, position).
    """
    last = Window.partitionBy("recordKey").orderBy(F.col(version).desc_nulls_last())
    return (
        rows.withColumn("recordKey", row_key(rows))
        .where(F.col("recordKey").isNotNull())
        .withColumn("_nth", F.row_number().over(last))
        .where("_nth = 1")
        .drop("_nth")
    )


def completed(labels: DataFrame) -> DataFrame:
    """Label rows that need no further call: label and event key are filled."""
    filled = [F.length(F.coalesce(F.col(c), F.lit(""))) > 0 for c in ("label", "evento_chave")]
    return labels.where(filled[0] & filled[1])


def pending_articles(articles: DataFrame, labels: DataFrame) -> DataFrame:
    """Articles without a completed label row; failed calls are pending again.

    A key may have many stored rows, so the keys are made distinct before they
    are shuffled.
    """
    done = completed(labels).select("recordKey").distinct()
    return articles.join(done, "recordKey", "left_anti")


def as_label_rows(rows: DataFrame, names: Sequence[str] = LABEL_COLUMNS) -> DataFrame:
    """The 25 label columns, or those of them in ``names``, in their types: absent ones NULL, unreadable numbers NULL."""
    return rows.select(
        *[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).try_cast(f.dataType).alias(f.name)
            for f in LABEL_SCHEMA.fields
            if f.name in names
        ]
    )


def upsert_labels(existing: DataFrame, new: DataFrame, candidates: DataFrame) -> DataFrame:
    """Stored rows with the new ones in place of theirs, for current candidates only.

    Both sides are brought to the 25 label columns, so a store may be a CSV file (all
    text) or lack columns. Each side should hold one row per key; of several, the greatest
    by its columns in order counts. One shuffle of the label rows and one of the candidates' keys; columns
    that neither side has are added behind them.
    """
    had = [c for c in LABEL_COLUMNS if c in existing.columns or c in new.columns]
    both = as_label_rows(existing, had).withColumn("_new", F.lit(0)).unionByName(
        as_label_rows(new, had).withColumn("_new", F.lit(1))
    )
    newest = Window.partitionBy("recordKey").orderBy(F.col("_new").desc(), *[F.col(c).desc() for c in had])
    kept = both.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1")
    return as_label_rows(kept.join(candidates.select("recordKey"), "recordKey", "left_semi"))
