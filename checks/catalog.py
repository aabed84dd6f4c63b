"""Every operator as a query over the driver tables, with the SQL it must equal.

``@check(sql, name)`` registers a function, by default under its own name. The SQL is written for
DuckDB and independently of the Spark code; ``None`` means rows-only.
"""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks.fixtures import PHRASE, table, view, with_views
from newslens.functions import labels as L
from newslens.functions import text as X
from newslens.operators import events, sentiment
from newslens.operators.classify import article_text, classify, phrase_articles
from newslens.operators.clean import (
    clean_event_rows,
    clean_labels,
    sentinels_to_null,
    stored_event_id,
    stored_event_name,
)
from newslens.operators.responses import (
    answer_fields,
    cap,
    event_key,
    event_name,
    label_rows,
    parse_answers,
    reason_text,
)
from newslens.operators.places import file_places
from newslens.operators.resume import latest_labels, pending_articles, upsert_labels
from newslens.plans.stages import label_articles, run_all
from newslens.schema import FIELD_CAPS, LABEL_COLUMNS, LABELS, MAX_INPUT_CHARS, NA_SENTINELS
from newslens.session import shared_path
from newslens.sources.articles import article_quality as quality_counts
from newslens.sources.articles import (
    corpus_to_parquet,
    normalize_articles,
    read_articles,
    sorted_keys,
    with_record_keys,
)
from newslens.sources.labels import read_existing
from newslens.sources.labels import read_labels as read_label_files
from newslens.sources.sinks import (
    CSV_ROWS,
    article_event_columns,
    classified_columns,
    landed,
    write_article_events,
    write_classified,
    write_labels,
    write_tables,
)
from newslens.streaming.incremental import classify_stream, stored_labels

# the stand-in classifiers below travel to the executors with the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(sql: str | None, name: str | None = None):
    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


# --------------------------------------------------------------------------
# SQL parts
# --------------------------------------------------------------------------

_LABELS_SQL = ", ".join(f"'{label}'" for label in LABELS)
_DIMENSION_SQL = """(VALUES (0,'muito negativo',-2,'Muito negativo'), (1,'negativo',-1,'Negativo'),
  (2,'neutro',0,'Neutro'), (3,'positivo',1,'Positivo'), (4,'muito positivo',2,'Muito positivo'),
  (5,'n/a',NULL,'Não aplicável')) AS dim(ord, label, score, display)"""


def _score_sql(label: str) -> str:
    return (
        f"CASE {label} WHEN 'muito negativo' THEN -2 WHEN 'negativo' THEN -1 WHEN 'neutro' THEN 0 "
        "WHEN 'positivo' THEN 1 WHEN 'muito positivo' THEN 2 END"
    )


def _round4_sql(value: str) -> str:
    return f"round_even(({value}) * 10000, 0) / 10000"


def _share_sql(part: str, whole: str) -> str:
    """Exact half-way quotients go to the side their double lies on, others round plainly."""
    part, whole = f"({part})", f"({whole})"
    q = f"({part} / {whole})"
    steps = f"CAST({part} * 20000 // {whole} AS BIGINT)"
    high = f"(floor({q} * 1073741824) / 1073741824)"
    error = f"(({high} * 20000 - {steps}) + ({q} - {high}) * 20000)"
    down = f"({steps} // 2)"
    return (
        f"CASE WHEN ({part} * 20000) % {whole} = 0 AND {steps} % 2 = 1 THEN "
        f"(CASE WHEN {error} > 0 THEN {down} + 1 WHEN {error} < 0 THEN {down} "
        f"ELSE {down} + {down} % 2 END) / 10000 ELSE {_round4_sql(q)} END"
    )


#: fx_labels after the sentiment stage: one row per article, with month
_CLEAN = with_views("fx_labels") + f""", clean AS (
  SELECT *, strftime(publishedAt, '%Y-%m') AS month, {_score_sql('label')} AS sentiment_score
  FROM (SELECT *, row_number() OVER (PARTITION BY articleId
               ORDER BY publishedAt ASC NULLS LAST, recordKey) AS nth FROM fx_labels) r
  WHERE nth = 1)"""

_DAY = "%Y-%m-%d %H:%M:%S"

_COUNTS_SQL = ", ".join(
    f"""CAST(count(*) FILTER (label = '{label}') AS BIGINT) AS "{label}\"""" for label in LABELS
)
_SUM_SQL = " + ".join(f'"{label}"' for label in LABELS)

_MONTHLY = _CLEAN + f""", monthly AS (
  SELECT month, {_COUNTS_SQL} FROM clean WHERE month IS NOT NULL GROUP BY month),
  pct AS (SELECT month, {', '.join(f'"{l}" / ({_SUM_SQL}) * 100 AS "{l}"' for l in LABELS)} FROM monthly)"""


def _mode_sql(column: str) -> str:
    return f"""(SELECT evento_id, value FROM (
      SELECT evento_id, {column} AS value, row_number() OVER (PARTITION BY evento_id
             ORDER BY count(*) DESC, {column}) AS nth
      FROM clean GROUP BY evento_id, {column}) m WHERE nth = 1)"""


_TITLES_SQL = """(SELECT evento_id, string_agg(title, ' | ' ORDER BY nth) AS titulos_exemplo FROM (
    SELECT evento_id, title, row_number() OVER (PARTITION BY evento_id
           ORDER BY publishedAt ASC NULLS LAST, articleId) AS nth
    FROM (SELECT *, row_number() OVER (PARTITION BY evento_id, title
                 ORDER BY publishedAt ASC NULLS LAST, articleId) AS copy FROM clean) c
    WHERE copy = 1) t WHERE nth <= 5 GROUP BY evento_id)"""

_EVENTS = _CLEAN + f""", counted AS (
  SELECT evento_id, count(*) AS n, count(sentiment_score) AS scored,
         avg(sentiment_score) AS mean, {_COUNTS_SQL}
  FROM clean GROUP BY evento_id),
summary AS (
  SELECT c.evento_id, ek.value AS evento, ev.value AS evento_exemplo, et.value AS tipo_evento,
    el.value AS local, n AS n_artigos, scored AS n_classificados,
    {_round4_sql('mean')} AS score_medio, {_round4_sql('mean')} AS media_sentimento,
    "muito negativo" AS muito_negativo, negativo, neutro, positivo,
    "muito positivo" AS muito_positivo, "n/a",
    positivo + "muito positivo" AS n_positivas, negativo + "muito negativo" AS n_negativas,
    "muito positivo" AS n_muito_positivas, "muito negativo" AS n_muito_negativas,
    {_share_sql('positivo + "muito positivo"', 'n')} AS share_positivo,
    {_share_sql('negativo + "muito negativo"', 'n')} AS share_negativo,
    {_share_sql('"muito positivo"', 'CASE WHEN scored > 0 THEN scored ELSE n END')} AS share_muito_positivo,
    {_share_sql('"muito negativo"', 'CASE WHEN scored > 0 THEN scored ELSE n END')} AS share_muito_negativo,
    positivo + 2 * "muito positivo" AS peso_positivo, negativo + 2 * "muito negativo" AS peso_negativo,
    titulos_exemplo
  FROM counted c
  JOIN {_mode_sql('evento_chave')} ek ON ek.evento_id = c.evento_id
  JOIN {_mode_sql('evento')} ev ON ev.evento_id = c.evento_id
  JOIN {_mode_sql('tipo_evento')} et ON et.evento_id = c.evento_id
  JOIN {_mode_sql('local')} el ON el.evento_id = c.evento_id
  JOIN {_TITLES_SQL} ti ON ti.evento_id = c.evento_id)"""

_POSITIVE_ORDER = """score_medio DESC, share_positivo DESC, share_muito_positivo DESC,
  peso_positivo DESC, n_artigos DESC, evento_id"""
_NEGATIVE_ORDER = """score_medio, share_negativo DESC, share_muito_negativo DESC,
  peso_negativo DESC, n_artigos DESC, evento_id"""
_RANKS = _EVENTS + f""", good AS (SELECT * FROM summary
    WHERE n_classificados >= 1 AND score_medio > 0 AND n_positivas > n_negativas),
  bad AS (SELECT * FROM summary
    WHERE n_classificados >= 1 AND score_medio < 0 AND n_negativas > n_positivas),
  top_good AS (SELECT *, CAST(row_number() OVER (ORDER BY {_POSITIVE_ORDER}) AS INTEGER) AS rank FROM good
    ORDER BY {_POSITIVE_ORDER} LIMIT 25),
  top_bad AS (SELECT *, CAST(row_number() OVER (ORDER BY {_NEGATIVE_ORDER}) AS INTEGER) AS rank FROM bad
    ORDER BY {_NEGATIVE_ORDER} LIMIT 25)"""

_FOLD = "lower(strip_accents({}))"
_TEXT = "title || chr(10) || chr(10) || summaryPreview || chr(10) || chr(10) || rawText"
_MATCH = rf"regexp_matches({_FOLD.format(_TEXT)}, '\b{PHRASE}\b')"
_SLUG_TAIL = "trim(regexp_replace({}, '[^a-z0-9]+', '-', 'g'), '-')"


def _slug_sql(text: str) -> str:
    known = f"translate(lower({text}), 'áàãâéêíóôõúç', 'aaaaeeiooouc')"
    return f"coalesce(nullif({_SLUG_TAIL.format(known)}, ''), 'evento-sem-chave')"


def _ascii_slug_sql(text: str) -> str:
    plain = f"lower(regexp_replace(strip_accents({text}), '[^\\x00-\\x7F]+', '', 'g'))"
    return f"coalesce(nullif({_SLUG_TAIL.format(plain)}, ''), 'evento-sem-chave')"


def _fuzzy_sql(label: str) -> str:
    return f"""CASE WHEN {label} IN ({_LABELS_SQL}) THEN {label}
      WHEN contains({label}, 'muito negativo') THEN 'muito negativo'
      WHEN contains({label}, 'muito positivo') THEN 'muito positivo'
      WHEN contains({label}, 'negativo') THEN 'negativo'
      WHEN contains({label}, 'positivo') THEN 'positivo'
      WHEN contains({label}, 'neutro') THEN 'neutro' ELSE 'n/a' END"""


#: record keys of fx_articles: position of the article among those of its id
_KEYED = with_views("fx_articles") + """, keyed AS (
  SELECT *, CASE WHEN nth = 1 THEN id ELSE concat(id, '__dup', nth) END AS recordKey
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY jsonIndex) AS nth FROM fx_articles) a)"""

# --------------------------------------------------------------------------
# Spark-side inputs
# --------------------------------------------------------------------------


def _labels(spark, sf):
    rows = view(spark, sf, "fx_labels", dealt=True)
    return rows.withColumns(
        {"id": F.col("recordKey"), "sentiment_score": L.label_score(F.col("label"))}
    )


def _clean(spark, sf):
    return clean_labels(_labels(spark, sf).drop("shipped", "lineNumber", "flag", "status"))


def _event_rows(spark, sf):
    return clean_event_rows(_labels(spark, sf).drop("shipped", "lineNumber", "flag", "status"))


def _stored_event_rows(spark, sf):
    """The article-event relation as a written table, the way the whole run hands it over."""
    return landed(article_event_columns(_event_rows(spark, sf)), shared_path(spark, "event-rows"))


def _summary(spark, sf):
    return events.event_summary(_stored_event_rows(spark, sf))


def _raw_articles(spark, sf):
    rows = view(spark, sf, "fx_articles")
    return rows.withColumns(
        {
            "articleId": F.col("articleId").cast("string"),
            "publishedAt": F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
            "targetKeys": _target_keys(),
            "url": F.concat(F.lit("http://"), "sourceHost", F.lit("/"), "id"),
            "storyTitle": F.col("lang"),
        }
    ).drop("published", "lang", "label")


def _target_keys():
    """Repeated and unsorted keys; none for one language."""
    keys = F.array(F.col("sourceHost"), F.lit("geral"), F.col("lang"), F.lit("geral"))
    return F.when(F.col("lang") != "en", keys)


_KEYS_SQL = """CASE WHEN lang <> 'en' THEN list_sort(list_distinct([sourceHost, 'geral', lang])) ELSE [] END"""
_PUBLISHED_SQL = "coalesce(strftime(published, '%Y-%m-%dT%H:%M:%SZ'), '')"


def _articles(spark, sf):
    return normalize_articles(_raw_articles(spark, sf))


def _text_labels(spark, sf):
    return view(spark, sf, "fx_text_labels")


def _day(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


# --------------------------------------------------------------------------
# Sources, article normalisation, text
# --------------------------------------------------------------------------

_ARTICLE_SELECT = f"""SELECT recordKey, jsonIndex, id, articleId, title,
  concat('http://', sourceHost, '/', id) AS url, '' AS sourceName, sourceHost,
  {_PUBLISHED_SQL} AS publishedAt, '' AS publishedDisplay, '' AS rawTextKey, rawText,
  summaryPreview, '' AS summaryLabel, array_to_string({_KEYS_SQL}, '; ') AS targetKeys,
  lang AS storyTitle, CAST(NULL AS VARCHAR) AS storyId FROM keyed"""


@check(f"{_KEYED} {_ARTICLE_SELECT}", "normalize_articles")
def normalize_article_rows(spark, sf):
    return _articles(spark, sf).withColumn("targetKeys", F.array_join("targetKeys", "; "))


@check(f"{_KEYED} {_ARTICLE_SELECT}", "read_articles")
def read_article_files(spark, sf):
    """The corpus as JSON Lines in the shared folder, read back and normalised."""
    path = shared_path(spark, "corpus")
    _raw_articles(spark, sf).write.json(path)
    articles = normalize_articles(read_articles(spark, path, "json"))
    return articles.withColumn("targetKeys", F.array_join("targetKeys", "; "))


@check(f"{_KEYED} SELECT jsonIndex, id, recordKey FROM keyed")
def record_keys(spark, sf):
    return with_record_keys(view(spark, sf, "fx_articles").select("id", "jsonIndex"))


@check(f"""{with_views('fx_articles')}, placed AS (SELECT *, row_number() OVER (ORDER BY jsonIndex) AS pos FROM fx_articles),
       keyed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS nth FROM placed)
       SELECT CASE WHEN nth = 1 THEN id ELSE concat(id, '__dup', nth) END AS recordKey, pos AS jsonIndex,
         articleId, rawText FROM keyed""", "read_corpus")
def read_corpus_files(spark, sf):
    """The corpus as one-object files of 250 articles or fewer, read back, converted to Parquet and normalised."""
    path = shared_path(spark, "corpus-files")
    part = F.lpad(F.floor(F.col("jsonIndex") / 250).cast("string"), 12, "0")
    rows = view(spark, sf, "fx_articles").withColumn("part", part)
    article = F.struct("jsonIndex", F.col("articleId").cast("string").alias("articleId"), "id", "title", "rawText")
    files = rows.groupBy("part").agg(F.sort_array(F.collect_list(article)).alias("articles"))
    files.write.partitionBy("part").json(path)
    articles = normalize_articles(corpus_to_parquet(spark, f"{path}/*", f"{path}-table"))
    return articles.select("recordKey", "jsonIndex", "articleId", "rawText")


@check(f"""{_KEYED} SELECT recordKey, CAST(row_number() OVER (ORDER BY {_PUBLISHED_SQL}, articleId, jsonIndex) AS INTEGER) AS place
       FROM keyed""")
def article_order(spark, sf):
    """The place of each article's row in a label table written in order."""
    path = shared_path(spark, "ordered-labels")
    articles = _articles(spark, sf).withColumn("targetKeys", F.array_join("targetKeys", "; "))
    write_labels(articles, path, ordered=True)
    return _places(spark, path, "recordKey")


def _places(spark, path: str, key: str) -> DataFrame:
    """(key, place): the order in which the files of a table, by name, hold its rows."""
    return file_places(spark, path).select(key, F.col("place").cast("int").alias("place"))


@check(f"""{with_views('fx_articles')} SELECT articleId, array_to_string({_KEYS_SQL}, '; ') AS keys,
       CAST(len({_KEYS_SQL}) AS INTEGER) AS n_keys FROM fx_articles""")
def target_keys(spark, sf):
    keys = sorted_keys(_target_keys())
    return view(spark, sf, "fx_articles").select(
        "articleId", F.array_join(keys, "; ").alias("keys"), F.size(keys).alias("n_keys")
    )


@check(f"""{with_views('fx_articles')} SELECT articleId, {_TEXT} AS full_text,
       substring({_TEXT}, 1, 10000) AS model_text FROM fx_articles""", "compose_text")
def compose_texts(spark, sf):
    return view(spark, sf, "fx_articles").select(
        "articleId",
        article_text().alias("full_text"),
        X.render_prompt("{noticia}", article_text(), MAX_INPUT_CHARS).alias("model_text"),
    )


@check(f"""{with_views('fx_articles')} SELECT articleId,
       'Texto: ' || {_TEXT} || ' -- fim' AS prompt FROM fx_articles""", "render_prompt")
def render_prompts(spark, sf):
    return view(spark, sf, "fx_articles").select(
        "articleId", X.render_prompt("Texto: {noticia} -- fim", article_text()).alias("prompt")
    )


@check("SELECT doc_id, lower(strip_accents(text)) AS folded FROM documents")
def fold_accents(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", X.fold_accents(F.col("text")).alias("folded"))


@check(f"SELECT doc_id, {_slug_sql('text')} AS slug FROM documents")
def slug_classifier(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", X.slug_classifier(F.col("text")).alias("slug"))


@check(f"SELECT doc_id, {_ascii_slug_sql('text')} AS slug FROM documents")
def slug_ranker(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", X.slug_ranker(F.col("text")).alias("slug"))


@check(f"{with_views('fx_articles')} SELECT articleId, sourceHost FROM fx_articles WHERE {_MATCH}")
def phrase_filter(spark, sf):
    rows = view(spark, sf, "fx_articles")
    return phrase_articles(rows, PHRASE).select("articleId", "sourceHost")


# --------------------------------------------------------------------------
# Label, score and date rules
# --------------------------------------------------------------------------


@check(f"""{with_views('fx_text_labels')} SELECT recordKey, label AS given,
       {_fuzzy_sql("lower(trim(label))")} AS label FROM fx_text_labels""")
def label_fuzzy(spark, sf):
    return _text_labels(spark, sf).select(
        "recordKey", F.col("label").alias("given"), L.label_fuzzy(F.col("label")).alias("label")
    )


@check(f"""{with_views('fx_text_labels')} SELECT recordKey, CASE WHEN lower(trim(label)) IN ({_LABELS_SQL})
       THEN lower(trim(label)) ELSE 'n/a' END AS label FROM fx_text_labels""")
def label_strict(spark, sf):
    return _text_labels(spark, sf).select("recordKey", L.label_strict(F.col("label")).alias("label"))


@check(f"""{with_views('fx_labels')} SELECT recordKey, label,
       CAST({_score_sql('label')} AS INTEGER) AS sentiment_score FROM fx_labels""")
def label_score(spark, sf):
    return view(spark, sf, "fx_labels").select(
        "recordKey", "label", L.label_score(F.col("label")).alias("sentiment_score")
    )


@check(f"""{with_views('fx_text_labels')}, strict AS (SELECT recordKey, sentiment_score AS given,
         CASE WHEN lower(trim(label)) IN ({_LABELS_SQL}) THEN lower(trim(label)) ELSE 'n/a' END AS label
         FROM fx_text_labels)
       SELECT recordKey, coalesce(try_cast(given AS DOUBLE), CAST({_score_sql('label')} AS DOUBLE)) AS score
       FROM strict""")
def score_repair(spark, sf):
    label = L.label_strict(F.col("label"))
    return _text_labels(spark, sf).select(
        "recordKey", L.score_repair(L.to_number(F.col("sentiment_score")), label).alias("score")
    )


_NO_SENTINELS = f"""{with_views('fx_text_labels')} SELECT recordKey,
  nullif(nullif(nullif(label, 'n/a'), 'N/A'), 'null') AS label,
  nullif(nullif(sentiment_score, ''), 'n/a') AS sentiment_score,
  CASE WHEN tipo_evento NOT IN ('n/a', 'None') THEN tipo_evento END AS tipo_evento,
  nullif(local, 'NaN') AS local, nullif(evento_id, '') AS evento_id FROM fx_text_labels"""
_SENTINEL_COLUMNS = ["recordKey", "label", "sentiment_score", "tipo_evento", "local", "evento_id"]


@check(_NO_SENTINELS)
def na_sentinels(spark, sf):
    return sentinels_to_null(_text_labels(spark, sf).select(*_SENTINEL_COLUMNS))


_SPELLINGS = [*NA_SENTINELS, "nAn", "n/a "]


@check(f"""{with_views('fx_labels')}, given AS (SELECT recordKey,
         [{', '.join(f"'{x}'" for x in _SPELLINGS)}][CAST(articleId % {len(_SPELLINGS)} AS INTEGER) + 1] AS label FROM fx_labels)
       SELECT recordKey, CASE WHEN label IN ('nAn', 'n/a ') THEN label END AS label FROM given""")
def na_spellings(spark, sf):
    """Every spelling of a missing value, and two that are none."""
    given = F.element_at(F.array(*map(F.lit, _SPELLINGS)), (F.col("articleId") % len(_SPELLINGS) + 1).cast("int"))
    return sentinels_to_null(view(spark, sf, "fx_labels").select("recordKey", given.alias("label")))


@check(_NO_SENTINELS)
def read_labels(spark, sf):
    """The messy label rows as CSV files in the shared folder, read back under the same rule."""
    path = shared_path(spark, "label-files")
    write_labels(_text_labels(spark, sf), path, "csv")
    return sentinels_to_null(read_label_files(spark, path).select(*_SENTINEL_COLUMNS))


@check(f"""{with_views('fx_text_labels')}, ids AS (SELECT articleId AS given, try_cast(articleId AS BIGINT) AS id
         FROM fx_text_labels)
       SELECT count(*) AS n_raw, count(*) FILTER (given = '' OR given IS NULL OR id = 0) AS n_without_id,
         count(*) FILTER (given <> '' AND id IS NULL) AS n_not_numeric, count(*) FILTER (id <> 0) AS n_usable
       FROM ids""")
def article_quality(spark, sf):
    return quality_counts(_text_labels(spark, sf))


@check(f"""{with_views('fx_labels')}, texts AS (SELECT recordKey, CASE lineNumber
         WHEN 1 THEN shipped WHEN 2 THEN shipped - INTERVAL 3 HOUR
         WHEN 3 THEN shipped WHEN 4 THEN shipped + INTERVAL 1500 MILLISECOND
         WHEN 5 THEN shipped END AS ts FROM fx_labels)
       SELECT recordKey, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS published,
              strftime(ts, '%Y-%m') AS month FROM texts""")
def parse_dates(spark, sf):
    """ISO with Z, with offset, date only, fraction, another listed format, and garbage."""
    shipped = F.col("shipped")
    given = (
        F.when(F.col("lineNumber") == 1, F.date_format(shipped, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("lineNumber") == 2, F.date_format(shipped, "yyyy-MM-dd HH:mm:ss'+03:00'"))
        .when(F.col("lineNumber") == 3, F.date_format(shipped, "yyyy-MM-dd"))
        .when(F.col("lineNumber") == 4, F.date_format(shipped, "yyyy-MM-dd'T'HH:mm:'01.5'"))
        .when(F.col("lineNumber") == 5, F.date_format(shipped, "dd/MM/yyyy HH:mm"))
        .when(F.col("lineNumber") == 6, F.date_format(shipped, "'em' MMMM 'de' yyyy"))
    )
    ts = L.parse_timestamp(given, formats=["dd/MM/yyyy HH:mm"])
    return view(spark, sf, "fx_labels").select(
        "recordKey",
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("published"),
        L.month_of(ts).alias("month"),
    )


@check(f"""{with_views('fx_text_labels')} SELECT recordKey,
       CASE WHEN length(tipo_evento) > 3 THEN evento ELSE evento_chave END AS evento,
       CASE WHEN evento_id <> '' THEN evento_id ELSE {_ascii_slug_sql('evento_chave')} END AS evento_id
       FROM fx_text_labels""")
def event_backfill(spark, sf):
    """Names are blanked where the type is a short sentinel; ids are blank for one flag."""
    rows = _text_labels(spark, sf)
    name = F.when(F.length("tipo_evento") > 3, F.col("evento")).otherwise(F.lit(""))
    return rows.select(
        "recordKey",
        stored_event_name(name, F.col("evento_chave")).alias("evento"),
        stored_event_id(F.col("evento_id"), F.col("evento_chave")).alias("evento_id"),
    )


@check(f"""{with_views('fx_text_labels')}, given AS (SELECT recordKey,
         CASE WHEN sentiment_score = '' THEN '' ELSE '  ' || evento || ' ' END AS e,
         CASE WHEN tipo_evento = 'n/a' THEN NULL ELSE evento_chave || chr(10) END AS k FROM fx_text_labels),
       named AS (SELECT recordKey, trim(CASE WHEN e <> '' THEN e ELSE coalesce(k, '') END, chr(10) || ' ') AS evento,
         k FROM given),
       keyed AS (SELECT recordKey, evento, trim(coalesce(k, evento), chr(10) || ' ') AS evento_chave FROM named)
       SELECT recordKey, evento, evento_chave, {_slug_sql('evento_chave')} AS evento_id FROM keyed""", "event_fields")
def event_field_rules(spark, sf):
    event = F.when(F.col("sentiment_score") == "", F.lit("")).otherwise(
        F.concat(F.lit("  "), "evento", F.lit(" "))
    )
    key = F.when(F.col("tipo_evento") != "n/a", F.concat("evento_chave", F.lit("\n")))
    return (
        _text_labels(spark, sf)
        .select("recordKey", event_name(event, key).alias("evento"), key.alias("_key"))
        .withColumn("evento_chave", event_key(F.col("_key"), F.col("evento")))
        .withColumn("evento_id", X.slug_classifier(F.col("evento_chave")))
        .drop("_key")
    )


@check(f"""SELECT doc_id, {', '.join(f"substring(text, 1, {n}) AS {f}" for f, n in FIELD_CAPS.items())},
       CASE WHEN lang <> 'en' THEN text ELSE source END AS why FROM documents""")
def cap_fields(spark, sf):
    """Length caps per field, and the fallback between the two reason fields."""
    docs = table(spark, sf, "documents")
    answer = F.struct(
        F.when(F.col("lang") != "en", F.col("text")).otherwise(F.lit("")).alias("reason_sentimento"),
        F.col("source").alias("reason"),
    )
    return docs.select(
        "doc_id", *[cap(f, F.col("text"), FIELD_CAPS).alias(f) for f in FIELD_CAPS], reason_text(answer).alias("why")
    )


# --------------------------------------------------------------------------
# Answers, classification, resuming
# --------------------------------------------------------------------------

_BODY = "regexp_extract(content, '(?s)\\{.*\\}', 0)"
_ANSWERS = with_views("fx_responses") + f""", body AS (SELECT recordKey, content, {_BODY} AS b FROM fx_responses),
  json AS (SELECT *, json_valid(b) AND b <> '' AS ok FROM body),
  answers AS (SELECT recordKey, content, ok,
    CASE WHEN ok THEN json_extract_string(b, '$.label') END AS raw_label,
    CASE WHEN ok THEN json_extract_string(b, '$.evento') END AS evento,
    CASE WHEN ok THEN json_extract_string(b, '$.evento_chave') END AS evento_chave,
    CASE WHEN ok THEN json_extract_string(b, '$.local') END AS local FROM json),
  labelled AS (SELECT *, {_fuzzy_sql("lower(coalesce(raw_label, ''))")} AS label FROM answers)"""


@check(f"{_ANSWERS} SELECT recordKey, ok AS answered, raw_label AS label, evento, evento_chave, local FROM labelled")
def parse_responses(spark, sf):
    rows = parse_answers(view(spark, sf, "fx_responses"))
    return rows.select(
        "recordKey", "answered", "parsed.label", "parsed.evento", "parsed.evento_chave", "parsed.local"
    )


_RESPONSE_LABELS = f"""{_ANSWERS} SELECT recordKey, label,
  CAST({_score_sql('label')} AS INTEGER) AS sentiment_score,
  CASE WHEN ok THEN '' ELSE trim(content) END AS reason,
  coalesce(evento, '') AS evento, coalesce(evento_chave, '') AS evento_chave,
  {_slug_sql("coalesce(evento_chave, '')")} AS evento_id, local FROM labelled"""


@check(_RESPONSE_LABELS)
def responses_to_labels(spark, sf):
    return answer_fields(view(spark, sf, "fx_responses")).select(
        "recordKey", "label", "sentiment_score", "reason", "evento", "evento_chave", "evento_id", "local"
    )


def stub_answer(prompt: str) -> str:
    """A deterministic stand-in for the external classifier: everything follows from the length."""
    n = len(prompt)
    return json.dumps({"label": LABELS[n % 6], "evento": f"Evento {n % 97}", "evento_chave": f"evento-{n % 97}"})


def failing_answer(prompt: str) -> str:
    """As the stub where the text has a common word; else an error, a non-text answer, a text no file can
    hold, or an error that quotes JSON followed by an empty answer, by the text's length."""
    if " la " in prompt:
        return stub_answer(prompt)
    kind = len(prompt) % 4
    if kind == 0:
        raise RuntimeError("no answer for this text")
    if kind == 1:
        return {"label": "positivo"}
    if kind == 2:
        return "\ud800"
    asked = globals().setdefault("_asked", set())
    if hash(prompt) not in asked:
        asked.add(hash(prompt))
        raise RuntimeError('{"label": "positivo", "evento": "E"}')
    asked.discard(hash(prompt))
    return ""


def short_answer(prompt: str) -> str:
    """As the stub, for short texts only: longer ones must have been answered before."""
    if len(prompt) > 2200:
        raise RuntimeError("asked again")
    return stub_answer(prompt)


def no_answer(prompt: str) -> str:
    raise RuntimeError("asked again")


def no_wait(attempt: int, error: Exception) -> float:
    return 0.0


_STUB_N = f"length({_TEXT})"
_STUB_LABEL = f"[{_LABELS_SQL}][CAST({_STUB_N} % 6 AS INTEGER) + 1]"
_STUB_KEY = f"concat('evento-', {_STUB_N} % 97)"


@check(f"""{_KEYED} SELECT recordKey, {_STUB_LABEL} AS label, concat('Evento ', {_STUB_N} % 97) AS evento,
       {_STUB_KEY} AS evento_id FROM keyed""")
def classify_stub(spark, sf):
    answers = classify(_articles(spark, sf), stub_answer, parallelism=8)
    return answer_fields(answers).select("recordKey", "label", "evento", "evento_id")


_REASONS = f"""CASE {_STUB_N} % 4 WHEN 0 THEN 'API error: no answer for this text'
  WHEN 1 THEN 'API error: the answer is of type dict, not text'
  WHEN 2 THEN 'API error: the answer cannot be stored as UTF-8'
  ELSE '{{"label": "positivo", "evento": "E"}}' END"""


@check(f"""{_KEYED}, asked AS (SELECT *, contains({_TEXT}, ' la ') AS ok FROM keyed)
       SELECT recordKey, CASE WHEN ok THEN {_STUB_LABEL} ELSE 'n/a' END AS label,
       CASE WHEN ok THEN '' ELSE {_REASONS} END AS reason,
       CASE WHEN ok THEN {_STUB_KEY} ELSE 'evento-sem-chave' END AS evento_id FROM asked""")
def classify_errors(spark, sf):
    answers = classify(_articles(spark, sf), failing_answer, parallelism=8, wait=no_wait)
    return answer_fields(answers).select("recordKey", "label", "reason", "evento_id")


def patient_answer(prompt: str) -> str:
    """The number of the attempt that succeeds, by the text's length: 1, 2 or never; some last attempts hang."""
    tried = globals().setdefault("_tried", {})
    n = tried[prompt] = tried.get(prompt, 0) + 1
    if n == 3 or n <= len(prompt) % 3 * 2 - 1:
        if n == 3:
            tried.pop(prompt)
            if len(prompt) % 300 == 2:
                time.sleep(600)
        raise RuntimeError(f"busy {n}")
    tried.pop(prompt)
    return str(n)


@check(f"""{_KEYED}, n AS (SELECT recordKey, {_STUB_N} % 3 AS k, {_STUB_N} % 300 = 2 AS hangs FROM keyed)
       SELECT recordKey, CASE k WHEN 0 THEN '1' WHEN 1 THEN '2' END AS content,
         CASE WHEN hangs THEN 'no answer within 2 s' WHEN k = 2 THEN 'busy 3' END AS error, CASE WHEN k = 1 THEN 'busy 1' END AS earlier,
         CAST(CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS INTEGER) AS attempts FROM n""")
def retries(spark, sf):
    """Some texts are answered at once, some at the second attempt, some never, and some calls hang."""
    return classify(_articles(spark, sf), patient_answer, parallelism=8, wait=no_wait, deadline=2)


_STUB_ROWS = f"""SELECT recordKey, jsonIndex, id, articleId, {_PUBLISHED_SQL} AS publishedAt,
  '' AS publishedDisplay, '' AS sourceName, sourceHost, title, CAST(NULL AS VARCHAR) AS storyId,
  lang AS storyTitle, array_to_string({_KEYS_SQL}, '; ') AS targetKeys, {_STUB_LABEL} AS label,
  CAST({_score_sql(_STUB_LABEL)} AS INTEGER) AS sentiment_score, '' AS reason,
  CAST(NULL AS VARCHAR) AS evidencia_sentimento, concat('Evento ', {_STUB_N} % 97) AS evento,
  {_STUB_KEY} AS evento_chave, {_STUB_KEY} AS evento_id, CAST(NULL AS VARCHAR) AS tipo_evento,
  CAST(NULL AS VARCHAR) AS local, CAST(NULL AS VARCHAR) AS data_evento,
  CAST(NULL AS VARCHAR) AS descricao_curta, CAST(NULL AS VARCHAR) AS evidencia_evento,
  'stub' AS model FROM keyed"""


@check(f"{_KEYED} {_STUB_ROWS}", "label_rows")
def label_row_table(spark, sf):
    articles = _articles(spark, sf)
    return label_rows(articles, classify(articles, stub_answer, parallelism=8), "stub")


#: stored rows under both key columns: one key column may be empty, some rows have neither
_VERSIONED = """SELECT CASE flag WHEN 'A' THEN '' ELSE concat('k-', articleId) END AS recordKey,
  CASE WHEN flag = 'A' AND status = 'F' THEN '' ELSE concat('k-', articleId) END AS id,
  recordKey AS version, label, evento_chave FROM fx_labels"""


@check(f"""{with_views('fx_labels')}, stored AS ({_VERSIONED}), keyed AS (
         SELECT coalesce(nullif(recordKey, ''), nullif(id, '')) AS recordKey, id, version, label, evento_chave
         FROM stored)
       SELECT recordKey, id, version, label, evento_chave FROM (
         SELECT *, row_number() OVER (PARTITION BY recordKey ORDER BY version DESC) AS nth FROM keyed
         WHERE recordKey IS NOT NULL) r WHERE nth = 1""", "latest_labels")
def latest_label_rows(spark, sf):
    view(spark, sf, "fx_labels").createOrReplaceTempView("fx_labels")
    return latest_labels(spark.sql(_VERSIONED), "version")


@check(f"""{with_views('fx_existing')} SELECT recordKey, articleId FROM fx_labels c WHERE NOT EXISTS (
       SELECT 1 FROM fx_existing e WHERE e.recordKey = c.recordKey AND e.label <> '' AND e.evento_chave <> '')""", "pending_articles")
def pending_article_rows(spark, sf):
    candidates = view(spark, sf, "fx_labels").select("recordKey", "articleId")
    return pending_articles(candidates, view(spark, sf, "fx_existing"))


_NEW_LABELS = """SELECT recordKey, 'neutro' AS label, evento_chave, 'new' AS model FROM fx_labels
  WHERE shipped >= TIMESTAMP '1998-01-01 00:00:00'"""


@check(f"""{with_views('fx_existing')}, fresh AS ({_NEW_LABELS}),
       current AS (SELECT recordKey FROM fx_labels WHERE sourceHost <> (SELECT min(sourceHost) FROM fx_labels))
       SELECT * FROM fresh WHERE recordKey IN (SELECT recordKey FROM current)
       UNION ALL SELECT * FROM fx_existing WHERE recordKey NOT IN (SELECT recordKey FROM fresh)
       AND recordKey IN (SELECT recordKey FROM current)""", "upsert_labels")
def upsert_label_rows(spark, sf):
    """New rows replace old ones; the articles of one source have left the corpus."""
    rows = view(spark, sf, "fx_labels")
    rows.createOrReplaceTempView("fx_labels")
    gone = rows.agg(F.min("sourceHost").alias("sourceHost"))
    current = rows.join(F.broadcast(gone), "sourceHost", "left_anti")  # one row
    rows = upsert_labels(view(spark, sf, "fx_existing"), spark.sql(_NEW_LABELS), current)
    return rows.select("recordKey", "label", "evento_chave", "model")


@check(f"""{with_views('fx_existing')}, fresh AS (
         SELECT recordKey, 'neutro' AS label, evento_chave, 'new' AS model, articleId AS jsonIndex, title FROM fx_labels
         WHERE shipped >= TIMESTAMP '1998-01-01 00:00:00')
       SELECT recordKey, label, nullif(evento_chave, '') AS evento_chave, model, jsonIndex, title FROM fresh
       UNION ALL SELECT recordKey, label, nullif(evento_chave, ''), model, NULL, NULL FROM fx_existing
       WHERE recordKey NOT IN (SELECT recordKey FROM fresh)""")
def upsert_from_csv(spark, sf):
    """The store is CSV files with four columns and two rows per key, of which the one in the later file counts."""
    path = shared_path(spark, "store-csv")
    old = view(spark, sf, "fx_existing")
    for turn, part in enumerate((old.withColumn("label", F.lit("negativo")), old)):
        part.write.option("maxRecordsPerFile", CSV_ROWS).csv(f"{path}/turn={turn}", header=True, escape='"')
    rows = view(spark, sf, "fx_labels")
    fresh = view(spark, sf, "fx_labels", dealt=True).where("shipped >= TIMESTAMP '1998-01-01 00:00:00'").select(
        "recordKey", F.lit("neutro").alias("label"), "evento_chave", F.lit("new").alias("model"),
        F.col("articleId").alias("jsonIndex"), "title")
    merged = upsert_labels(read_existing(spark, path), fresh, rows)
    return merged.select("recordKey", "label", F.nullif("evento_chave", F.lit("")).alias("evento_chave"), "model", "jsonIndex", "title")


def _stub_existing(articles: DataFrame) -> DataFrame:
    """Stored rows of an earlier run: English articles, failed where the title is long in words."""
    done = F.size(F.split("title", " ")) < 12
    columns = {c: F.lit(None).cast("string") for c in LABEL_COLUMNS if c not in articles.columns}
    return (
        articles.where("storyTitle = 'en'")
        .withColumns(columns)
        .withColumns(
            {
                "label": F.when(done, F.lit("neutro")).otherwise(F.lit("n/a")),
                "sentiment_score": F.when(done, F.lit(0)),
                "evento_chave": F.when(done, F.lit("antigo")).otherwise(F.lit("")),
                "evento_id": F.when(done, F.lit("antigo")).otherwise(F.lit("evento-sem-chave")),
                "targetKeys": F.array_join("targetKeys", "; "),
                "model": F.lit("old"),
            }
        )
        .select(*LABEL_COLUMNS)
    )


@check(f"""{_KEYED}, stored AS (SELECT recordKey FROM keyed
         WHERE lang = 'en' AND len(string_split(title, ' ')) < 12)
       SELECT recordKey, articleId,
         CASE WHEN recordKey IN (FROM stored) THEN 'neutro' ELSE {_STUB_LABEL} END AS label,
         CASE WHEN recordKey IN (FROM stored) THEN 'antigo' ELSE {_STUB_KEY} END AS evento_id,
         CASE WHEN recordKey IN (FROM stored) THEN 'old' ELSE 'stub' END AS model
       FROM keyed WHERE {_MATCH}""")
def labels_end_to_end(spark, sf):
    """Articles, phrase filter, pending ones, classifier, upsert."""
    folder = shared_path(spark, "labels")
    articles = landed(_articles(spark, sf), f"{folder}/articles")
    existing = landed(_stub_existing(articles), f"{folder}/existing")
    # a run that broke off after the long texts; asking for one of them again would fail it
    pending = pending_articles(phrase_articles(articles, PHRASE), existing)
    classify(pending.where("length(rawText) > 2000"), stub_answer).write.parquet(f"{folder}/answers")
    labels = label_articles(
        articles, existing, PHRASE, short_answer, "stub", folder, parallelism=4, rows_per_task=50, attempts=1)
    return labels.select("recordKey", "articleId", "label", "evento_id", "model")


_WHOLE = f"""{_KEYED}, stored AS (SELECT recordKey FROM keyed
    WHERE lang = 'en' AND len(string_split(title, ' ')) < 12),
  labels AS (SELECT recordKey, articleId, published,
    CASE WHEN recordKey IN (FROM stored) THEN 'neutro' ELSE {_STUB_LABEL} END AS label,
    CASE WHEN recordKey IN (FROM stored) THEN 'antigo' ELSE {_STUB_KEY} END AS evento_id
  FROM keyed WHERE {_MATCH})"""


@check(f"""{_WHOLE} SELECT 'counts' AS part, label AS key, CAST(count(*) AS DOUBLE) AS n FROM labels GROUP BY label
       UNION ALL SELECT 'months', strftime(published, '%Y-%m'), count(*) FROM labels WHERE published IS NOT NULL GROUP BY 2
       UNION ALL SELECT 'events', evento_id, count(*) FROM labels GROUP BY evento_id
       UNION ALL SELECT 'events in order', evento_id, row_number() OVER (ORDER BY count(*) DESC,
         {_round4_sql(f"avg({_score_sql('label')})")} DESC NULLS LAST, evento_id) FROM labels GROUP BY evento_id
       UNION ALL SELECT 'scores', evento_id, {_round4_sql(f"avg({_score_sql('label')})")} FROM labels GROUP BY evento_id""")
def whole_run(spark, sf):
    """All stages twice in one folder; the second resumes from the first's labels and must ask nothing."""
    folder = shared_path(spark, "whole-run")
    articles = landed(_articles(spark, sf), f"{folder}/articles")
    existing = landed(_stub_existing(articles), f"{folder}/existing")
    run_all(spark, articles, existing, PHRASE, stub_answer, "stub", folder, parallelism=4, ordered=True)
    run_all(spark, articles, None, PHRASE, no_answer, "stub", folder, attempts=1)
    labels = read_label_files(spark, f"{folder}/labels", "parquet")
    months = spark.read.csv(f"{folder}/monthly_sentiment_counts", header=True)
    counts = spark.read.csv(f"{folder}/sentiment_counts", header=True)
    summary = spark.read.parquet(f"{folder}/eventos_resumo")
    total = sum((F.col(f"`{label}`").cast("double") for label in LABELS), F.lit(0.0))
    parts = [
        counts.where("n_articles <> '0'").select(
            F.lit("counts").alias("part"), F.col("label").alias("key"), F.col("n_articles").cast("double").alias("n")),
        months.select(F.lit("months"), "month", total),
        labels.groupBy("evento_id").count().select(F.lit("events"), "evento_id", F.col("count").cast("double")),
        _places(spark, f"{folder}/eventos_resumo", "evento_id").select(
            F.lit("events in order"), "evento_id", F.col("place").cast("double")),
        summary.select(F.lit("scores"), "evento_id", "score_medio"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out



_LATER = "jsonIndex > 0.3 * (SELECT max(jsonIndex) FROM keyed)"


@check(f"""{_KEYED} SELECT recordKey, articleId,
         CASE WHEN {_LATER} THEN {_STUB_LABEL} ELSE 'neutro' END AS label,
         CASE WHEN {_LATER} THEN 'stub' ELSE 'old' END AS model
       FROM keyed WHERE {_MATCH} OR NOT ({_LATER})""", "stream_classify")
def classify_arrivals(spark, sf):
    """Articles that arrive in three parts, with repeated ids, on a store with an earlier run's rows.

    The first part is that run's and must not be asked again. Calls of the second part fail for texts without a
    common word; the third holds the rest and the second part's other texts again, and the failed calls are
    repeated with it. The result is the batch result.
    """
    raw = view(spark, sf, "fx_articles").select(
        "articleId", "jsonIndex", "id", "title", "summaryPreview", "rawText", "sourceHost"
    )
    last, place = F.lit(raw.agg(F.max("jsonIndex")).first()[0] or 0), F.col("jsonIndex")
    old, middle = place <= 0.3 * last, (place > 0.3 * last) & (place <= 0.6 * last)
    again = middle & F.contains("rawText", F.lit(" la "))
    existing = normalize_articles(raw).where(old).select(
        "recordKey", "jsonIndex", "id", "articleId", F.lit("neutro").alias("label"),
        F.lit("e").alias("evento_chave"), F.lit("old").alias("model"))
    store = shared_path(spark, "store")
    for part, fn in ((old, no_answer), (middle, failing_answer), ((place > 0.6 * last) | again, stub_answer)):
        raw.where(part).write.mode("append").parquet(f"{store}/in")
        arriving = spark.readStream.schema(raw.schema).parquet(f"{store}/in")
        query = classify_stream(
            arriving, store, f"{store}/checkpoint", fn, "stub", PHRASE, normalize_articles, existing,
            attempts=1, rows_per_task=50)
        query.awaitTermination()
    return stored_labels(spark, store).select("recordKey", "articleId", "label", "model")


# --------------------------------------------------------------------------
# Cleaned rows and sentiment tables
# --------------------------------------------------------------------------


@check(f"{_CLEAN} SELECT articleId, recordKey, strftime(publishedAt, '{_DAY}') AS publishedAt, label FROM clean", "dedupe_articles")
def dedupe_article_rows(spark, sf):
    return _clean(spark, sf).select("articleId", "recordKey", _day("publishedAt"), "label")


_CLASSIFIED = f"""{_CLEAN} SELECT recordKey, recordKey AS id, articleId, strftime(publishedAt, '{_DAY}') AS publishedAt,
       sourceHost, title, nullif(label, '') AS label, CAST(sentiment_score AS DOUBLE) AS sentiment_score,
       evento, evento_chave, evento_id, tipo_evento, local, month FROM clean"""


@check(_CLASSIFIED)
def classified_articles(spark, sf):
    return classified_columns(_clean(spark, sf)).withColumn("publishedAt", _day("publishedAt"))


@check(_CLASSIFIED)
def classified_by_month(spark, sf):
    """Classified articles written as one folder per month and read back."""
    path = shared_path(spark, "classified")
    write_classified(_clean(spark, sf), path)
    return spark.read.parquet(path).withColumn("publishedAt", _day("publishedAt"))


@check(f"""{_CLEAN} SELECT articleId, recordKey, strftime(publishedAt, '{_DAY}') AS publishedAt, sourceHost, title,
       label, CAST(sentiment_score AS DOUBLE) AS sentiment_score, evento, evento_chave, evento_id,
       tipo_evento, local FROM clean""")
def article_events(spark, sf):
    return article_event_columns(_event_rows(spark, sf)).withColumn("publishedAt", _day("publishedAt"))


@check(f"""{with_views('fx_text_labels')}, rows AS (
         SELECT try_cast(articleId AS BIGINT) AS articleId, recordKey, publishedAt, title,
           CASE WHEN lower(trim(label)) IN ({_LABELS_SQL}) THEN lower(trim(label)) ELSE 'n/a' END AS label,
           try_cast(sentiment_score AS DOUBLE) AS given, evento, tipo_evento, local,
           CASE WHEN evento_id <> '' THEN evento_id ELSE {_ascii_slug_sql('evento_chave')} END AS evento_id
         FROM fx_text_labels)
       SELECT articleId, recordKey, strftime(publishedAt, '{_DAY}') AS publishedAt, title, label,
         coalesce(given, CAST({_score_sql('label')} AS DOUBLE)) AS sentiment_score, evento, evento_id,
         tipo_evento, local
       FROM (SELECT *, row_number() OVER (PARTITION BY articleId
             ORDER BY publishedAt ASC NULLS LAST, recordKey) AS nth FROM rows WHERE articleId IS NOT NULL) r
       WHERE nth = 1""")
def load_event_rows(spark, sf):
    return clean_event_rows(_text_labels(spark, sf)).select(
        "articleId", "recordKey", _day("publishedAt"), "title", "label", "sentiment_score", "evento",
        "evento_id", "tipo_evento", "local",
    )


@check(f"""{_CLEAN}, total AS (SELECT label, count(*) AS n FROM clean GROUP BY label)
       SELECT dim.label, coalesce(n, 0) AS n_articles,
         {_round4_sql('coalesce(n, 0) / (SELECT count(*) FROM clean) * 100')} AS percent
       FROM {_DIMENSION_SQL} LEFT JOIN total ON total.label = dim.label""")
def sentiment_counts(spark, sf):
    return sentiment.sentiment_counts(_clean(spark, sf))


@check(f"""{_CLEAN}, total AS (SELECT label, count(*) AS n FROM clean GROUP BY label)
       SELECT ord, dim.label, display, score, coalesce(n, 0) AS n_articles
       FROM {_DIMENSION_SQL} LEFT JOIN total ON total.label = dim.label""", "label_dimension")
def label_bars(spark, sf):
    return sentiment.label_bars(_clean(spark, sf))


@check(f"{_MONTHLY} SELECT * FROM monthly")
def monthly_sentiment_counts(spark, sf):
    return sentiment.monthly_sentiment_counts(_clean(spark, sf))


_PERCENT_SELECT = "SELECT month, " + ", ".join(f'''{_round4_sql(f'"{l}"')} AS "{l}"''' for l in LABELS) + " FROM pct"


@check(f"{_MONTHLY} {_PERCENT_SELECT}")
def monthly_sentiment_percent(spark, sf):
    return sentiment.monthly_sentiment_percent(_clean(spark, sf))


@check(f"{_MONTHLY} {_PERCENT_SELECT} WHERE month >= '1998-01'")
def monthly_percent_since(spark, sf):
    return sentiment.since(sentiment.monthly_sentiment_percent(_clean(spark, sf)), "1998-01")


@check(_MONTHLY + " " + " UNION ALL ".join(
    f"""SELECT month, '{l}' AS label, "{l}" AS percent FROM pct WHERE month >= '1998-01'"""
    for l in ["muito negativo", "negativo", "positivo", "muito positivo"]))
def percent_lines(spark, sf):
    return sentiment.percent_lines(_clean(spark, sf), "1998-01")


def _band_sql(i: int) -> str:
    lower = " + ".join(["0.0"] + [f'"{l}"' for l in LABELS[:i]])
    return f"""SELECT month, {i} AS ord, '{LABELS[i]}' AS label, "{LABELS[i]}" AS percent,
      CAST({lower} AS DOUBLE) AS lower, {lower} + "{LABELS[i]}" AS upper FROM pct WHERE month >= '1998-01'"""


@check(_MONTHLY + " " + " UNION ALL ".join(_band_sql(i) for i in range(6)))
def stacked_area(spark, sf):
    return sentiment.stacked_area(_clean(spark, sf), "1998-01")


@check(f"{_CLEAN} SELECT month, count(*) AS n_articles FROM clean WHERE month >= '1998-01' GROUP BY month")
def monthly_volume(spark, sf):
    return sentiment.monthly_volume(_clean(spark, sf), "1998-01")


@check(f"""{_CLEAN} SELECT sourceHost, {_COUNTS_SQL} FROM clean WHERE sourceHost <> '' GROUP BY sourceHost
       ORDER BY count(*) DESC, sourceHost LIMIT 12""")
def top_sources(spark, sf):
    return sentiment.top_sources(_clean(spark, sf))


@check(f"""{_CLEAN} SELECT sourceHost, count(*) AS n_articles FROM clean WHERE sourceHost <> ''
       GROUP BY sourceHost ORDER BY count(*) DESC, sourceHost LIMIT 10""")
def source_volume(spark, sf):
    return sentiment.source_volume(_clean(spark, sf))


@check(f"""{with_views('fx_labels')}, scored AS (SELECT lineNumber * 0.5 - CASE WHEN flag = 'A' THEN 1.0 ELSE 3.0 END AS s FROM fx_labels),
       bins AS (SELECT * FROM (VALUES (-2.5), (-1.5), (-0.5), (0.5), (1.5)) AS b(f))
       SELECT CAST(f AS DOUBLE) AS bin_from, CAST(f + 1 AS DOUBLE) AS bin_to,
       (SELECT count(*) FROM scored WHERE s >= f AND (s < f + 1 OR f = 1.5 AND s = 2.5)) AS n_articles FROM bins""")
def score_histogram(spark, sf):
    """Scores on every edge of a bin, and beyond the first."""
    score = F.col("lineNumber") * 0.5 - F.when(F.col("flag") == "A", 1.0).otherwise(3.0)
    return sentiment.score_histogram(view(spark, sf, "fx_labels").select(score.alias("sentiment_score")))


@check(f"""{with_views('fx_articles')} SELECT count(*) AS n_raw, count(*) FILTER ({_MATCH}) AS n_matched,
       count(DISTINCT id) FILTER ({_MATCH}) AS n_unique,
       count(DISTINCT id) FILTER ({_MATCH} AND published IS NOT NULL) AS n_dated FROM fx_articles""")
def corpus_funnel(spark, sf):
    """Articles here are one where their ids are equal, so that some repeat."""
    return sentiment.corpus_funnel(
        view(spark, sf, "fx_articles").withColumn("articleId", F.col("id")),
        X.contains_phrase(article_text(), PHRASE),
        F.col("published").isNotNull(),
    )


@check(f"""{_CLEAN}, c AS (SELECT count(*) AS n_articles,
         count(*) FILTER (label IN ('positivo', 'muito positivo')) AS n_positive,
         count(*) FILTER (label IN ('negativo', 'muito negativo')) AS n_negative FROM clean)
       SELECT *, {_round4_sql('n_positive / n_articles * 100')} AS percent_positive,
         {_round4_sql('n_negative / n_articles * 100')} AS percent_negative FROM c""")
def polarity_share(spark, sf):
    return sentiment.polarity_share(_clean(spark, sf))


@check(f"""{_CLEAN} SELECT strftime(min(publishedAt), '{_DAY}') AS first_date,
       strftime(max(publishedAt), '{_DAY}') AS last_date FROM clean""")
def date_coverage(spark, sf):
    return sentiment.date_coverage(_clean(spark, sf)).select(_day("first_date"), _day("last_date"))


# --------------------------------------------------------------------------
# Events and rankings
# --------------------------------------------------------------------------


@check(f"{_EVENTS} SELECT * FROM summary")
def event_summary(spark, sf):
    return _summary(spark, sf)


@check(f"""{_EVENTS} SELECT evento_id, CAST(row_number() OVER (
       ORDER BY n_artigos DESC, score_medio DESC NULLS LAST, evento_id) AS INTEGER) AS place FROM summary""")
def summary_order(spark, sf):
    """The place of each event in the written summary."""
    folder = shared_path(spark, "tables")
    write_tables({"summary": events.in_summary_order(_summary(spark, sf))}, folder)
    return _places(spark, f"{folder}/summary", "evento_id")


@check(f"""{_CLEAN} SELECT articleId, CAST(row_number() OVER (ORDER BY publishedAt NULLS LAST, articleId) AS INTEGER) AS place
       FROM clean""")
def event_row_order(spark, sf):
    """The place of each article in the article-event relation written in order."""
    path = shared_path(spark, "ordered-rows")
    write_article_events(_event_rows(spark, sf), path, ordered=True)
    return _places(spark, path, "articleId")


@check(f"{_EVENTS} SELECT evento_id, n_artigos, score_medio FROM summary WHERE n_artigos >= 5")
def event_min_articles(spark, sf):
    summary = events.event_summary(_stored_event_rows(spark, sf), min_articles=5)
    return summary.select("evento_id", "n_artigos", "score_medio")


@check(f"{_CLEAN} SELECT * FROM {_TITLES_SQL} t")
def event_titles(spark, sf):
    return events.event_titles(_event_rows(spark, sf))


@check(f"{_CLEAN} SELECT count(DISTINCT evento_id) AS n_eventos FROM clean")
def event_count(spark, sf):
    return events.event_count(_event_rows(spark, sf))


@check(f"{_EVENTS} SELECT evento_id, score_medio, (score_medio + 2) / 4 AS score_normalizado FROM summary")
def normalized_score(spark, sf):
    return _summary(spark, sf).select(
        "evento_id", "score_medio", L.presentation_score(F.col("score_medio")).alias("score_normalizado")
    )


@check(f"{_RANKS} SELECT * FROM good")
def rank_positive(spark, sf):
    return events.rank_positive(_summary(spark, sf))


@check(f"{_RANKS} SELECT * FROM bad")
def rank_negative(spark, sf):
    return events.rank_negative(_summary(spark, sf))


@check(f"""{_RANKS} SELECT 'positive' AS side, evento_id, row_number() OVER (ORDER BY {_POSITIVE_ORDER}) AS rank FROM good
       UNION ALL SELECT 'negative', evento_id, row_number() OVER (ORDER BY {_NEGATIVE_ORDER}) FROM bad""")
def full_ranks(spark, sf):
    """The rank of every event of both rankings."""
    summary = _summary(spark, sf)
    good = events.rank_positive(summary, ranks=True).select(F.lit("positive").alias("side"), "evento_id", "rank")
    return good.union(events.rank_negative(summary, ranks=True).select(F.lit("negative"), "evento_id", "rank"))


@check(f"{_RANKS} SELECT * FROM top_good")
def top_positive(spark, sf):
    return events.top_positive(_summary(spark, sf))


@check(f"{_RANKS} SELECT * FROM top_bad")
def top_negative(spark, sf):
    return events.top_negative(_summary(spark, sf))


_LINE = """concat(rank, '. **', evento_exemplo, '** - score medio ', CAST(score_medio AS VARCHAR), '; ',
  n_artigos, ' noticia(s); {}=', {}, '; muito {}=', {}, '; {}=', {}, '. Exemplos: ', titulos_exemplo)"""
_GOOD_LINE = _LINE.format(
    "positivos", "n_positivas", "positivos", "n_muito_positivas", "negativos", "n_negativas")
_BAD_LINE = _LINE.format(
    "negativos", "n_negativas", "negativos", "n_muito_negativas", "positivos", "n_positivas")


@check(f"""{_RANKS} SELECT 'positive' AS side, rank, {_GOOD_LINE} AS line FROM top_good
       UNION ALL SELECT 'negative', rank, {_BAD_LINE} FROM top_bad""")
def ranking_lines(spark, sf):
    summary = landed(_summary(spark, sf), shared_path(spark, "summary"))
    good = events.ranking_lines(events.top_positive(summary), True).withColumn("side", F.lit("positive"))
    bad = events.ranking_lines(events.top_negative(summary), False).withColumn("side", F.lit("negative"))
    return good.unionByName(bad).select("side", "rank", "line")


@check(f"""{_CLEAN} SELECT count(*) AS n_noticias, count(DISTINCT evento_id) AS n_eventos,
       2 AS min_articles, 2 AS min_classified FROM clean""")
def ranking_header(spark, sf):
    return events.ranking_header(_event_rows(spark, sf), min_articles=2)
