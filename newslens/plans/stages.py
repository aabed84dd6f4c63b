"""The three stages and the whole run, composed from the operators.

Stages hand over written tables. The classifier's answers are kept as they come, so a broken
run goes on where it stopped, and no answer is paid for twice.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from newslens.functions.text import render_prompt
from newslens.operators import events, sentiment
from newslens.operators.classify import answer_durably, article_text, latest_answers, phrase_articles
from newslens.operators.clean import clean_event_rows, clean_labels
from newslens.operators.responses import label_rows
from newslens.operators.resume import completed, upsert_labels
from newslens.plans.progress import Progress, input_of
from newslens.schema import LABEL_SCHEMA, RESPONSE_SCHEMA, TEXT_SLOT
from newslens.sources.labels import read_existing
from newslens.sources.sinks import (
    current_path,
    label_table,
    landed,
    replace_table,
    write_article_events,
    write_classified,
    write_small_tables,
    write_tables,
)


def label_articles(
    articles: DataFrame,
    existing: DataFrame,
    phrase: str,
    fn: Callable[[str], str],
    model: str,
    work: str,
    resume: bool = True,
    template: str = TEXT_SLOT,
    max_chars: int | None = None,
    caps: Mapping[str, int] | None = None,
    progress: Progress | None = None,
    **ask_options,
) -> DataFrame:
    """Stage 1: label rows of all phrase articles, calling ``fn`` only for pending ones.

    Matching articles, with their prompts in place of the texts, are written below the folder
    ``work``, so texts are searched and stored once. Answers are added there as tasks
    end. A broken run, started again with the same ``work``, keeps them and asks for the rest;
    :func:`forget_answers` starts afresh. ``existing`` holds one label row per key (see ``read_existing``).
    ``max_chars`` and ``caps`` cut the input text and the answer's fields; by default both are whole.
    With ``progress`` the search is not repeated by a run that goes on.
    """
    prompt = render_prompt(template, article_text(), max_chars)
    matched = phrase_articles(articles, phrase).withColumn("prompt", prompt).drop("rawText", "summaryPreview")
    named = {"articles": input_of(articles), "phrase": phrase, "template": template, "max_chars": max_chars} if progress else {}
    (progress or Progress()).stage("candidates", named, lambda: landed(matched, f"{work}/candidates"))
    candidates = articles.sparkSession.read.schema(matched.schema).parquet(f"{work}/candidates")
    done = completed(existing) if resume else None
    answers = latest_answers(answer_durably(candidates.select("recordKey", "prompt"), fn, f"{work}/answers", done=done, **ask_options))
    rows = label_rows(candidates.drop("prompt"), answers, model, caps)
    return upsert_labels(existing, rows, candidates)


def forget_answers(spark: SparkSession, work: str) -> None:
    """Empty the answers below ``work``: the run they belong to has ended."""
    spark.createDataFrame([], RESPONSE_SCHEMA).write.mode("overwrite").parquet(f"{work}/answers")


def sentiment_tables(classified: DataFrame) -> dict[str, DataFrame]:
    """Stage 2 tables, each of a bounded number of rows (labels, months, top sources)."""
    return {
        "sentiment_counts": sentiment.sentiment_counts(classified),
        "monthly_sentiment_counts": sentiment.monthly_sentiment_counts(classified).orderBy("month"),
        "monthly_sentiment_percent": sentiment.monthly_sentiment_percent(classified).orderBy("month"),
        "top_sources_sentiment_counts": sentiment.top_sources(classified),
    }


def event_tables(
    rows: DataFrame,
    min_articles: int = 1,
    min_classified: int | None = None,
    summary: DataFrame | None = None,
    ranks: bool = False,
) -> dict[str, DataFrame]:
    """Stage 3 tables: all events, and both rankings in order, or with ``ranks`` numbered.

    Pass a stored ``summary`` of ``rows``, or each table computes it.
    """
    summary = events.event_summary(rows) if summary is None else summary
    return {
        "eventos_resumo": events.in_summary_order(summary),
        "eventos_muito_positivos": events.rank_positive(summary, min_articles, min_classified, ranks),
        "eventos_muito_negativos": events.rank_negative(summary, min_articles, min_classified, ranks),
    }


def analyse_labels(
    labels: DataFrame,
    folder: str,
    min_articles: int = 1,
    min_classified: int | None = None,
    timestamp_formats: Sequence[str] = (),
    ordered: bool = False,
    progress: Progress | None = None,
) -> None:
    """Stages 2 and 3 over label rows; every table goes below ``folder``.

    ``ordered`` writes the article tables sorted by date. With ``progress`` finished tables are not written again.

    The deduplicated articles and the event summary are each computed once and
    read back from their written tables.
    """
    spark = labels.sparkSession
    folder = folder.rstrip("/")
    progress = progress or Progress()
    thresholds = {"min_articles": min_articles, "min_classified": min_classified}

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}")

    def rankings() -> None:
        rows, summary = read("eventos_por_noticia"), read("eventos_resumo")
        tables = event_tables(rows, min_articles, min_classified, summary=summary, ranks=True)
        write_tables({k: v for k, v in tables.items() if k != "eventos_resumo"}, folder)
        write_small_tables(
            {
                "ranking_resumo": events.ranking_header(rows, min_articles, min_classified),
                "ranking_positivo": events.ranking_lines(events.top_positive(summary, **thresholds), True).orderBy("rank"),
                "ranking_negativo": events.ranking_lines(events.top_negative(summary, **thresholds), False).orderBy("rank"),
            },
            folder,
        )

    progress.stage(
        "classified",
        {"formats": list(timestamp_formats), "ordered": ordered},
        lambda: write_classified(clean_labels(labels, timestamp_formats), f"{folder}/noticias_classificadas", ordered=ordered),
    )
    progress.stage("sentiment", {}, lambda: write_small_tables(sentiment_tables(read("noticias_classificadas")), folder))
    progress.stage(
        "event_rows",
        {},
        lambda: write_article_events(clean_event_rows(read("noticias_classificadas")), f"{folder}/eventos_por_noticia", ordered=ordered),
    )
    progress.stage(
        "summary",
        {},
        lambda: write_tables({"eventos_resumo": events.in_summary_order(events.event_summary(read("eventos_por_noticia")))}, folder),
    )
    progress.stage("rankings", thresholds, rankings)


def run_all(
    spark: SparkSession,
    articles: DataFrame,
    existing: DataFrame | None,
    phrase: str,
    fn: Callable[[str], str],
    model: str,
    folder: str,
    min_articles: int = 1,
    min_classified: int | None = None,
    timestamp_formats: Sequence[str] = (),
    ordered: bool = False,
    **label_options,
) -> None:
    """All three stages. Without ``existing`` the run resumes from the labels of an earlier one in ``folder``.

    A run that broke, started again with the same inputs and parameters, skips its finished
    stages. The labels are replaced as a whole (``read_existing`` reads them).
    """
    folder = folder.rstrip("/")
    progress = Progress(spark, f"{folder}/work/finished")
    named = {"existing": input_of(existing), "model": model, "ordered": ordered, "resume": label_options.get("resume", True), "caps": label_options.get("caps")}

    def label() -> None:
        stored = read_existing(spark, f"{folder}/labels", "parquet") if existing is None else existing
        labels = label_articles(articles, stored, phrase, fn, model, f"{folder}/work", progress=progress, **label_options)
        replace_table(label_table(labels, ordered), f"{folder}/labels")
        forget_answers(spark, f"{folder}/work")

    named |= {"articles": input_of(articles), "phrase": phrase, "template": label_options.get("template"), "max_chars": label_options.get("max_chars")}
    progress.stage("labels", named, label)
    labels = spark.read.schema(LABEL_SCHEMA).parquet(current_path(spark, f"{folder}/labels"))
    analyse_labels(labels, folder, min_articles, min_classified, timestamp_formats, ordered, progress)
    progress.end()
