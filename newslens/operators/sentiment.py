"""Sentiment tables and chart series over cleaned, deduplicated articles.

Counts per label are conditional counts in one aggregate. That is one shuffle
with partial sums, however many rows a month or source has, and it gives every
label a column whether or not it occurs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslens.functions.rounding import round4
from newslens.schema import LABEL_DIMENSION, LABELS, NEGATIVE, NO_LABEL, POSITIVE

# First month of the charts, sizes of the two source lists, and
# the left edges of the score bins (each one wide, the last one closed).
CHART_START = "2018-01"
TOP_SOURCES = 12
LISTED_SOURCES = 10
SCORE_BINS = [-2.5, -1.5, -0.5, 0.5, 1.5]

LINE_LABELS = [label for label in LABELS if label not in ("neutro", NO_LABEL)]


def label_counts() -> list[Column]:
    return [F.count_if(F.col("label") == label).alias(label) for label in LABELS]


def _total() -> Column:
    return reduce(lambda a, b: a + b, [F.col(label) for label in LABELS])


def _rows_of(wide: DataFrame, *structs: Column) -> DataFrame:
    """Turn columns of one aggregate row into rows."""
    return wide.select(F.inline(F.array(*structs)))


def sentiment_counts(articles: DataFrame) -> DataFrame:
    """Count and percent per label: six rows, in label order, also for absent labels."""
    counts = articles.agg(F.count("*").alias("_all"), *label_counts())
    whole = F.nullif(F.col("_all"), F.lit(0))
    return _rows_of(
        counts,
        *[
            F.struct(
                F.lit(label).alias("label"),
                F.col(label).alias("n_articles"),
                round4(F.col(label) / whole * 100).alias("percent"),
            )
            for label in LABELS
        ],
    )


def label_dimension(spark) -> DataFrame:
    """The six labels with their order, score and display name."""
    rows = [(i, label, score, shown) for i, (label, score, shown) in enumerate(LABEL_DIMENSION)]
    return spark.createDataFrame(rows, "ord int, label string, score int, display string")


def label_bars(articles: DataFrame) -> DataFrame:
    """Bars of the overall distribution: display name, score and count per label."""
    names = F.broadcast(label_dimension(articles.sparkSession))  # six rows
    return (
        sentiment_counts(articles)
        .join(names, "label")
        .select("ord", "label", "display", "score", "n_articles")
    )


def monthly_sentiment_counts(articles: DataFrame) -> DataFrame:
    """Month by label counts, for months that occur; undated rows are left out."""
    return articles.where(F.col("month").isNotNull()).groupBy("month").agg(*label_counts())


def _monthly_shares(articles: DataFrame) -> DataFrame:
    total = _total()
    return monthly_sentiment_counts(articles).select(
        "month", *[(F.col(label) / total * 100).alias(label) for label in LABELS]
    )


def monthly_sentiment_percent(articles: DataFrame) -> DataFrame:
    """Month by label percentages, rounded."""
    return _monthly_shares(articles).select(
        "month", *[round4(F.col(label)).alias(label) for label in LABELS]
    )


def since(monthly: DataFrame, start: str = CHART_START) -> DataFrame:
    """Months from ``start`` (``YYYY-MM``) on."""
    return monthly.where(F.col("month") >= start)


def percent_lines(articles: DataFrame, start: str = CHART_START) -> DataFrame:
    """Unrounded monthly percentages in long form, without neutral and n/a."""
    return since(_monthly_shares(articles), start).select(
        "month",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(label).alias("label"), F.col(label).alias("percent"))
                    for label in LINE_LABELS
                ]
            )
        ),
    )


def stacked_area(articles: DataFrame, start: str = CHART_START) -> DataFrame:
    """Unrounded monthly percentages stacked in label order: lower and upper edge of each band."""
    bands, lower = [], F.lit(0.0)
    for position, label in enumerate(LABELS):
        upper = lower + F.col(label)
        bands.append(
            F.struct(
                F.lit(position).alias("ord"),
                F.lit(label).alias("label"),
                F.col(label).alias("percent"),
                lower.alias("lower"),
                upper.alias("upper"),
            )
        )
        lower = upper
    return since(_monthly_shares(articles), start).select("month", F.inline(F.array(*bands)))


def monthly_volume(articles: DataFrame, start: str = CHART_START) -> DataFrame:
    """Dated articles per month."""
    monthly = since(articles.where(F.col("month").isNotNull()), start)
    return monthly.groupBy("month").agg(F.count("*").alias("n_articles"))


def _with_source(articles: DataFrame) -> DataFrame:
    return articles.where(F.col("sourceHost").isNotNull())


def top_sources(articles: DataFrame, n: int = TOP_SOURCES) -> DataFrame:
    """Label counts of the ``n`` largest sources, largest first, ties by name."""
    return (
        _with_source(articles)
        .groupBy("sourceHost")
        .agg(*label_counts())
        .orderBy(_total().desc(), "sourceHost")
        .limit(n)
    )


def source_volume(articles: DataFrame, n: int = LISTED_SOURCES) -> DataFrame:
    """Article counts of the ``n`` largest sources."""
    return (
        _with_source(articles)
        .groupBy("sourceHost")
        .agg(F.count("*").alias("n_articles"))
        .orderBy(F.col("n_articles").desc(), "sourceHost")
        .limit(n)
    )


def score_histogram(articles: DataFrame, score: str = "sentiment_score") -> DataFrame:
    """Articles per score bin: five rows, scores outside the bins ignored."""
    value, last = F.col(score), SCORE_BINS[-1]
    counts = articles.agg(
        *[
            F.count_if(
                (value >= left) & ((value <= left + 1) if left == last else (value < left + 1))
            ).alias(f"_{i}")
            for i, left in enumerate(SCORE_BINS)
        ]
    )
    return _rows_of(
        counts,
        *[
            F.struct(
                F.lit(left).alias("bin_from"),
                F.lit(left + 1).alias("bin_to"),
                F.col(f"_{i}").alias("n_articles"),
            )
            for i, left in enumerate(SCORE_BINS)
        ],
    )


def corpus_funnel(articles: DataFrame, matched: Column, dated: Column) -> DataFrame:
    """Corpus size at each step: raw, phrase-matched, unique, unique with a date.

    Rows are reduced to one per article first; the counts of distinct articles
    then need no set of ids.
    """
    per_article = articles.groupBy("articleId").agg(
        F.count("*").alias("n"),
        F.count_if(matched).alias("n_matched"),
        F.count_if(matched & dated).alias("n_dated"),
    )
    return per_article.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_raw"),
        F.coalesce(F.sum("n_matched"), F.lit(0)).alias("n_matched"),
        F.count_if(F.col("n_matched") > 0).alias("n_unique"),
        F.count_if(F.col("n_dated") > 0).alias("n_dated"),
    )


def polarity_share(articles: DataFrame) -> DataFrame:
    """Positive-side and negative-side totals and their percentages of all articles."""
    counts = articles.agg(
        F.count("*").alias("n_articles"),
        F.count_if(F.col("label").isin(POSITIVE)).alias("n_positive"),
        F.count_if(F.col("label").isin(NEGATIVE)).alias("n_negative"),
    )
    whole = F.nullif(F.col("n_articles"), F.lit(0))
    return counts.withColumns(
        {
            "percent_positive": round4(F.col("n_positive") / whole * 100),
            "percent_negative": round4(F.col("n_negative") / whole * 100),
        }
    )


def date_coverage(articles: DataFrame) -> DataFrame:
    """First and last valid date."""
    return articles.agg(
        F.min("publishedAt").alias("first_date"), F.max("publishedAt").alias("last_date")
    )
