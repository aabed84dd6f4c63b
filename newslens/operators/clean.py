"""Cleaning of label rows for the sentiment stage and for the event stage.

The two stages read the same rows under different rules: the sentiment stage
turns missing-value spellings into NULL, the event stage keeps empty text as a
value. They are separate functions on purpose.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newslens.functions.labels import (
    label_strict,
    month_of,
    na_to_null,
    parse_timestamp,
    score_repair,
    to_article_id,
    to_number,
)
from newslens.functions.text import or_empty, slug_ranker
from newslens.session import require_utc

EVENT_REQUIRED = ["articleId", "recordKey", "title", "label", "evento_chave"]
EVENT_OPTIONAL = ["evento", "evento_id"]


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    """Fail at plan time, naming the columns that are missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"label rows lack columns: {', '.join(missing)}")


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def _article_id(df: DataFrame) -> Column:
    if isinstance(df.schema["articleId"].dataType, T.IntegralType):
        return F.col("articleId").cast("bigint")
    return to_article_id(F.col("articleId"))


def _score(df: DataFrame) -> Column:
    if "sentiment_score" not in df.columns:
        return F.lit(None).cast("double")
    if isinstance(df.schema["sentiment_score"].dataType, T.NumericType):
        return F.col("sentiment_score").cast("double")
    return to_number(F.col("sentiment_score"))


def _timestamp(df: DataFrame, name: str, formats: Sequence[str]) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("timestamp")
    if _is_text(df, name):
        return parse_timestamp(F.col(name), formats)
    return F.col(name).cast("timestamp")


def dedupe_articles(rows: DataFrame) -> DataFrame:
    """Earliest row per ``articleId``: dated before undated, then by ``recordKey``.

    Each task keeps one row per article before the shuffle, so an article with
    very many copies does not load the task that receives it.
    """
    order = [F.col("publishedAt").asc_nulls_last(), F.col("recordKey").asc_nulls_last()]
    if "jsonIndex" in rows.columns:
        order.append(F.col("jsonIndex").asc_nulls_last())
    first = Window.partitionBy("articleId").orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def sentinels_to_null(rows: DataFrame) -> DataFrame:
    """Apply the missing-value rule to every text column."""
    return rows.select(
        *[na_to_null(F.col(c)).alias(c) if _is_text(rows, c) else F.col(c) for c in rows.columns]
    )


def clean_labels(rows: DataFrame, timestamp_formats: Sequence[str] = ()) -> DataFrame:
    """Rows of the sentiment stage: NULLs, strict label, timestamp, month, one per article.

    Without an ``articleId`` column nothing is dropped or deduplicated.
    """
    require_columns(rows, ["id", "label"])
    require_utc(rows.sparkSession)
    rows = sentinels_to_null(rows)
    rows = rows.withColumns(
        {
            "label": label_strict(F.col("label")),
            "publishedAt": _timestamp(rows, "publishedAt", timestamp_formats),
        }
    ).withColumn("month", month_of(F.col("publishedAt")))
    if "sentiment_score" in rows.columns:
        rows = rows.withColumn("sentiment_score", _score(rows))
    if "articleId" not in rows.columns:
        return rows
    require_columns(rows, ["recordKey"])
    return dedupe_articles(
        rows.withColumn("articleId", _article_id(rows)).where(F.col("articleId").isNotNull())
    )


def clean_event_rows(rows: DataFrame, timestamp_formats: Sequence[str] = ()) -> DataFrame:
    """Rows of the event stage: empty text kept, score and event fields completed, one per article."""
    require_columns(rows, EVENT_REQUIRED)
    require_utc(rows.sparkSession)
    for name in EVENT_OPTIONAL:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(""))
    article_id, score = _article_id(rows), _score(rows)
    published = _timestamp(rows, "publishedAt", timestamp_formats)
    texts = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)]
    rows = rows.withColumns(
        {
            **{c: or_empty(F.col(c)) for c in texts if c not in ("publishedAt", "sentiment_score")},
            "articleId": article_id,
            "publishedAt": published,
            "label": label_strict(F.col("label")),
            "sentiment_score": score,
        }
    ).where(F.col("articleId").isNotNull())
    rows = rows.withColumns(
        {
            "sentiment_score": score_repair(F.col("sentiment_score"), F.col("label")),
            "evento": stored_event_name(F.col("evento"), F.col("evento_chave")),
            "evento_id": stored_event_id(F.col("evento_id"), F.col("evento_chave")),
        }
    )
    return dedupe_articles(rows)


def stored_event_name(name: Column, key: Column) -> Column:
    """Stored event name, else its key."""
    return F.when(F.length(name) > 0, name).otherwise(key)


def stored_event_id(stored: Column, key: Column) -> Column:
    """Stored event id, else the ranking slug of the key."""
    return F.when(F.length(stored) > 0, stored).otherwise(slug_ranker(key))
