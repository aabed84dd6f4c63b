"""Event summary and rankings.

A single event can hold a large part of the corpus: every article without an
event key shares one. So nothing gathers an event's articles. Counts are plain
partial sums. Modes and titles are first reduced to one row per event and
distinct value, which spreads a large event over all tasks, and each task then
keeps only the values that can win before it hands them to the event's task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newslens.functions.rounding import round4, share4
from newslens.operators.places import numbered
from newslens.operators.sentiment import label_counts
from newslens.schema import EVENT_SUMMARY_COLUMNS, LABELS

# Titles shown per event, their separator, events listed, and the
# report sentences of a listed event.
EXAMPLE_TITLES = 5
TITLE_SEPARATOR = " | "
LISTED_EVENTS = 25
POSITIVE_LINE = (
    "%d. **%s** - score medio %s; %d noticia(s); positivos=%d; "
    "muito positivos=%d; negativos=%d. Exemplos: %s"
)
NEGATIVE_LINE = (
    "%d. **%s** - score medio %s; %d noticia(s); negativos=%d; "
    "muito negativos=%d; positivos=%d. Exemplos: %s"
)

_MODES = {
    # summary column: article column
    "evento": "evento_chave",
    "evento_exemplo": "evento",
    "tipo_evento": "tipo_evento",
    "local": "local",
}


def event_counts(rows: DataFrame) -> DataFrame:
    """Per event: articles per label, all articles, scored articles, sum of scores."""
    return rows.groupBy("evento_id").agg(*_sums(label_counts()))


def _sums(per_label: list[Column]) -> list[Column]:
    return [
        *per_label,
        F.count("*").alias("n_artigos"),
        F.count("sentiment_score").alias("n_classificados"),
        F.sum(F.col("sentiment_score").cast("double")).alias("_scores"),
    ]


def event_modes(rows: DataFrame) -> DataFrame:
    """Per event: the most frequent key, name, type and place, ties to the smallest text.

    A field the rows lack is empty.
    """
    return event_counts_and_modes(rows).select("evento_id", *_MODES)


def event_counts_and_modes(rows: DataFrame) -> DataFrame:
    """``event_counts`` and ``event_modes`` from one pass over the rows.

    Rows are first summed per distinct combination of the four fields. Only those
    sums are taken apart by field; the counts are carried by the first field alone.
    """
    fields = list(_MODES.values())
    for absent in [f for f in fields if f not in rows.columns]:
        rows = rows.withColumn(absent, F.lit(""))
    combined = rows.groupBy("evento_id", *fields).agg(*_sums(label_counts()))
    sums = [c for c in combined.columns if c not in ("evento_id", *fields)]
    values = [F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]
    per_value = (
        combined.select("evento_id", *sums, F.inline(F.array(*values)))
        .groupBy("evento_id", "field", "value")
        .agg(*[F.sum(f"`{c}`").alias(c) for c in sums])
    )
    candidate = F.when(F.col("value").isNotNull(), F.struct(-F.col("n_artigos"), F.col("value")))

    def mode_of(field: str) -> Column:
        return F.min(F.when(F.col("field") == field, candidate))["value"]

    return per_value.groupBy("evento_id").agg(
        *[F.sum(F.when(F.col("field") == fields[0], F.col(f"`{c}`"))).alias(c) for c in sums],
        *[mode_of(field).alias(name) for name, field in _MODES.items()],
    )


def event_titles(rows: DataFrame, n: int = EXAMPLE_TITLES) -> DataFrame:
    """First ``n`` distinct titles per event, in date and article order, undated last."""
    seen = F.struct(
        F.col("publishedAt").isNull().alias("undated"),
        F.col("publishedAt").alias("publishedAt"),
        F.col("articleId").alias("articleId"),
    )
    titles = rows.groupBy("evento_id", "title").agg(F.min(seen).alias("seen"))
    earliest = Window.partitionBy("evento_id").orderBy("seen")
    leading = titles.withColumn("nth", F.row_number().over(earliest)).where(F.col("nth") <= n)
    in_order = [F.max(F.when(F.col("nth") == i, F.col("title"))) for i in range(1, n + 1)]
    return leading.groupBy("evento_id").agg(
        F.concat_ws(TITLE_SEPARATOR, *in_order).alias("titulos_exemplo")
    )


def event_summary(
    rows: DataFrame, min_articles: int = 1, n_titles: int = EXAMPLE_TITLES
) -> DataFrame:
    """One row of 26 columns per event: counts, mean score, shares, weights, examples.

    Both parts are partitioned by event already, so joining them shuffles
    nothing. Each reads its own columns of ``rows``; pass rows that are stored
    rather than the end of a long plan.
    """
    events = event_counts_and_modes(rows).join(event_titles(rows, n_titles), "evento_id", "left")
    if min_articles > 1:
        events = at_least(events, min_articles)
    very_bad, bad, _, good, very_good, _ = [F.col(label) for label in LABELS]
    n, scored = F.col("n_artigos"), F.col("n_classificados")
    mean = round4(F.col("_scores") / F.nullif(scored, F.lit(0)))
    scored_or_all = F.when(scored > 0, scored).otherwise(n)
    return events.withColumns(
        {
            "score_medio": mean,
            "media_sentimento": mean,
            "muito_negativo": very_bad,
            "muito_positivo": very_good,
            "n_positivas": good + very_good,
            "n_negativas": bad + very_bad,
            "n_muito_positivas": very_good,
            "n_muito_negativas": very_bad,
            "share_positivo": share4(good + very_good, n),
            "share_negativo": share4(bad + very_bad, n),
            "share_muito_positivo": share4(very_good, scored_or_all),
            "share_muito_negativo": share4(very_bad, scored_or_all),
            "peso_positivo": good + 2 * very_good,
            "peso_negativo": bad + 2 * very_bad,
        }
    ).select(*EVENT_SUMMARY_COLUMNS)


def at_least(summary: DataFrame, min_articles: int) -> DataFrame:
    """Events with enough articles."""
    return summary.where(F.col("n_artigos") >= min_articles)


def in_summary_order(summary: DataFrame) -> DataFrame:
    """Largest events first, then highest score, events without a score last."""
    return summary.orderBy(
        F.col("n_artigos").desc(), F.col("score_medio").desc_nulls_last(), "evento_id"
    )


def event_count(rows: DataFrame) -> DataFrame:
    """Exact number of distinct events."""
    return rows.agg(F.countDistinct("evento_id").alias("n_eventos"))


def rankable(summary: DataFrame, min_articles: int = 1, min_classified: int | None = None) -> DataFrame:
    """Events that may be ranked; the score threshold defaults to the article threshold."""
    needed = min_articles if min_classified is None else min_classified
    return at_least(summary, min_articles).where(
        F.col("score_medio").isNotNull() & (F.col("n_classificados") >= needed)
    )


def _ranking_order(positive: bool) -> list[Column]:
    side = "positivo" if positive else "negativo"
    score = F.col("score_medio")
    return [
        score.desc() if positive else score.asc(),
        F.col(f"share_{side}").desc(),
        F.col(f"share_muito_{side}").desc(),
        F.col(f"peso_{side}").desc(),
        F.col("n_artigos").desc(),
        F.col("evento_id").asc(),
    ]


def _ranked(summary: DataFrame, positive: bool, thresholds: tuple) -> DataFrame:
    more, fewer = ("n_positivas", "n_negativas") if positive else ("n_negativas", "n_positivas")
    score = F.col("score_medio")
    return rankable(summary, *thresholds).where(
        (score > 0 if positive else score < 0) & (F.col(more) > F.col(fewer))
    )


def rank_positive(
    summary: DataFrame, min_articles: int = 1, min_classified: int | None = None, ranks: bool = False
) -> DataFrame:
    """Predominantly positive events, best first. Order keys are the rounded values.

    With ``ranks`` the ranking is written and every event has its ``rank``, in place of the order of rows.
    """
    ranked = _ranked(summary, True, (min_articles, min_classified))
    return numbered(ranked, _ranking_order(True)) if ranks else ranked.orderBy(*_ranking_order(True))


def rank_negative(
    summary: DataFrame, min_articles: int = 1, min_classified: int | None = None, ranks: bool = False
) -> DataFrame:
    """Predominantly negative events, worst first; ``ranks`` as for the positive ones."""
    ranked = _ranked(summary, False, (min_articles, min_classified))
    return numbered(ranked, _ranking_order(False)) if ranks else ranked.orderBy(*_ranking_order(False))


def _top(summary: DataFrame, positive: bool, n: int, thresholds: tuple) -> DataFrame:
    order = _ranking_order(positive)
    listed = _ranked(summary, positive, thresholds).orderBy(*order).limit(n)
    # a window over the n listed rows only
    return listed.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def top_positive(
    summary: DataFrame, n: int = LISTED_EVENTS, min_articles: int = 1, min_classified: int | None = None
) -> DataFrame:
    """The first ``n`` events of the positive ranking with their rank."""
    return _top(summary, True, n, (min_articles, min_classified))


def top_negative(
    summary: DataFrame, n: int = LISTED_EVENTS, min_articles: int = 1, min_classified: int | None = None
) -> DataFrame:
    """The first ``n`` events of the negative ranking with their rank."""
    return _top(summary, False, n, (min_articles, min_classified))


def score_text(score: Column) -> Column:
    """A score rounded to four decimals as plain decimal text (``2.0``, ``0.3333``, ``0.0005``)."""
    tiny = (score != 0) & (F.abs(score) < 0.001)
    return F.when(tiny, F.format_string("%.4f", score)).otherwise(score.cast("string"))


def ranking_lines(top: DataFrame, positive: bool) -> DataFrame:
    """The report sentence of each listed event."""
    counts = ["n_positivas", "n_muito_positivas", "n_negativas"]
    if not positive:
        counts = ["n_negativas", "n_muito_negativas", "n_positivas"]
    line = F.format_string(
        POSITIVE_LINE if positive else NEGATIVE_LINE,
        "rank",
        "evento_exemplo",
        score_text(F.col("score_medio")),
        "n_artigos",
        *counts,
        "titulos_exemplo",
    )
    return top.select("rank", line.alias("line"))


def ranking_header(
    rows: DataFrame, min_articles: int = 1, min_classified: int | None = None
) -> DataFrame:
    """One row for the report's head: corpus size, distinct events, thresholds."""
    needed = min_articles if min_classified is None else min_classified
    return rows.agg(
        F.count("*").alias("n_noticias"), F.countDistinct("evento_id").alias("n_eventos")
    ).withColumns({"min_articles": F.lit(min_articles), "min_classified": F.lit(needed)})
