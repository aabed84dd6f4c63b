"""Incremental classification of arriving articles.

The store has these tables:

* ``keys``: every article that has arrived, with its number among those of its id. New ones are in one folder per
  micro-batch; :func:`compact_store` moves them to a base that is laid out by a hash of the id, in so many
  buckets that one holds about ``ROWS_PER_BUCKET`` articles, however many there are;
* ``pending``: per micro-batch, the articles whose call has failed so far, with their prompts. A batch reads the
  one before it, so what it reads grows with the failures, not with the store;
* ``answers``: what the classifier said, kept as tasks end;
* ``labels``: label rows, which no batch reads; a reader takes the newest row per key.

An article is known by id, ``articleId`` and position. One that arrives again is not
classified again; a new one with a known id gets the next number of that id. Articles whose
call failed are asked again with every later micro-batch, whether they arrive again or not.

A repeated micro-batch overwrites its own folders and reads only those before it. A batch reads the buckets of its
own ids and the key folders since the last compaction; :func:`classify_stream` compacts every ``fold_every`` batches.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from newslens.functions.text import render_prompt
from newslens.operators.classify import answer_durably, article_text, latest_answers, phrase_articles
from newslens.operators.responses import label_rows
from newslens.operators.resume import as_label_rows, completed, latest_labels
from newslens.schema import LABEL_COLUMNS, LABEL_SCHEMA, TEXT_SLOT
from newslens.sources.sinks import Folder, current_path, landed, replace_table

_BATCH = T.StructField("batch", T.LongType())
_KEYS = "id string, articleId bigint, jsonIndex bigint, nth bigint, recordKey string, batch bigint"
_IDENTITY = ["id", "articleId", "jsonIndex"]

#: Articles per bucket of the key base, and the most buckets.
ROWS_PER_BUCKET = 100_000
MAX_BUCKETS = 4096
#: Batches after which a stream compacts its keys.
FOLD_EVERY = 50


def create_store(spark: SparkSession, store: str, existing: DataFrame | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> None:
    """A label store, empty or with the label rows of an earlier run; left as it is if there is one."""
    rows = as_label_rows(existing) if existing is not None else spark.createDataFrame([], LABEL_SCHEMA)
    rows.write.mode("ignore").parquet(f"{store}/labels/batch=-1")
    if current_path(spark, f"{store}/keys") != f"{store}/keys":
        return
    number = F.coalesce(F.regexp_extract("recordKey", r"__dup(\d+)$", 1).try_cast("bigint"), F.lit(1))
    nth = F.when(F.col("recordKey") == F.col("id"), F.lit(1)).otherwise(number).cast("bigint").alias("nth")
    known = spark.read.schema(LABEL_SCHEMA).parquet(f"{store}/labels/batch=-1")
    known = known.select(*_IDENTITY, nth, "recordKey", F.lit(-1).cast("bigint").alias("batch"))
    _write_base(known, store, rows_per_bucket)


def stored_rows(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(T.StructType([*LABEL_SCHEMA.fields, _BATCH])).parquet(current_path(spark, f"{store}/labels"))


def stored_labels(spark: SparkSession, store: str) -> DataFrame:
    """The current label row of every article."""
    return latest_labels(stored_rows(spark, store), "batch").drop("batch")


def _bucket(buckets: Column) -> Column:
    return F.pmod(F.xxhash64("id"), buckets).cast("int")


def _write_base(keys: DataFrame, store: str, rows_per_bucket: int) -> None:
    """The key base anew, with a power of two of buckets; its folders name their number."""
    n, buckets = keys.count(), 1
    while buckets < MAX_BUCKETS and buckets * rows_per_bucket < n:
        buckets *= 2
    laid = keys.withColumns({"buckets": F.lit(buckets), "bucket": _bucket(F.lit(buckets))})
    # A task writes whole buckets; an id with very many articles is one bucket of several files.
    replace_table(laid.hint("rebalance", F.col("bucket")), f"{store}/keys", partition_by=["buckets", "bucket"])


def known_keys(spark: SparkSession, store: str, arrived: DataFrame, batch: int) -> DataFrame:
    """The stored keys that may have an id of ``arrived``: its buckets of the base, and what came since, before ``batch``."""
    base = current_path(spark, f"{store}/keys")
    known = spark.createDataFrame([], _KEYS)
    for layout in Folder(spark, base).names(hidden=False):
        buckets = int(layout.split("=")[1])
        touched = [r[0] for r in arrived.select(_bucket(F.lit(buckets))).distinct().collect()]
        keys = spark.read.schema(f"{_KEYS}, buckets int, bucket int").parquet(base)
        known = known.unionByName(keys.where(F.col("bucket").isin(touched)).drop("buckets", "bucket"))
    arrivals = f"{store}/arrivals"
    if Folder(spark, arrivals).names(hidden=False):
        known = known.unionByName(spark.read.schema(_KEYS).parquet(arrivals))
    return known.where(F.col("batch") < batch)


def number_arrivals(arrived: DataFrame, known: DataFrame) -> DataFrame:
    """Keys (``id, articleId, jsonIndex, nth, recordKey``) of the articles in ``arrived`` that ``known`` lacks.

    Numbering goes on from the highest number ``known`` has for an id, in the order of positions.
    """
    mine = arrived.select(*_IDENTITY).distinct()
    before = known.join(mine.select("id").distinct(), "id", "left_semi")
    highest = before.groupBy("id").agg(F.max("nth").alias("_highest"))
    new = mine.join(before.select(*_IDENTITY), _IDENTITY, "left_anti").join(highest, "id", "left")
    in_order = Window.partitionBy("id").orderBy("jsonIndex", "articleId")
    nth = F.row_number().over(in_order) + F.coalesce("_highest", F.lit(0))
    return new.withColumn("nth", nth.cast("bigint")).select(
        *_IDENTITY, "nth", F.when(F.col("nth") == 1, F.col("id")).otherwise(F.concat("id", F.lit("__dup"), F.col("nth").cast("string"))).alias("recordKey")
    )


def _complete(spark: SparkSession, store: str) -> list[int]:
    """Batches that have ended, whose failures are written last."""
    pending = Folder(spark, f"{store}/pending")
    batches = [int(n.split("=")[1]) for n in pending.names(hidden=False)]
    return sorted(b for b in batches if "_SUCCESS" in pending.names(f"batch={b}"))


def classify_batch(
    articles: DataFrame,
    batch: int,
    store: str,
    fn: Callable[[str], str],
    model: str,
    phrase: str | None = None,
    template: str = TEXT_SLOT,
    max_chars: int | None = None,
    caps: Mapping[str, int] | None = None,
    **ask_options,
) -> None:
    """Classify a micro-batch's new articles, and stored ones whose call has failed so far.

    ``articles`` is the normalised article table of the micro-batch; its record keys are
    not used, because numbers go on from the store's.
    """
    spark = articles.sparkSession
    arrived = landed(articles.select(*_IDENTITY).distinct(), f"{store}/arrived")
    keys = landed(number_arrivals(arrived, known_keys(spark, store, arrived, batch)), f"{store}/arrivals/batch={batch}")
    # an article may arrive twice in one batch: either copy will do
    fresh = articles.drop("recordKey").dropDuplicates(_IDENTITY).join(keys.drop("nth"), _IDENTITY)
    if phrase is not None:
        fresh = phrase_articles(fresh, phrase)
    prompt = render_prompt(template, article_text(), max_chars)
    added = landed(
        fresh.withColumn("prompt", prompt).drop("rawText", "summaryPreview"), f"{store}/candidates/batch={batch}"
    )
    before = [b for b in _complete(spark, store) if b < batch][-1:]
    candidates = added
    for last in before:
        candidates = added.unionByName(spark.read.schema(added.schema).parquet(f"{store}/pending/batch={last}"))
    answers = answer_durably(
        candidates.select("recordKey", "prompt"), fn, f"{store}/answers/batch={batch}", **ask_options
    )
    labels = landed(
        label_rows(candidates.drop("prompt"), latest_answers(answers), model, caps), f"{current_path(spark, f'{store}/labels')}/batch={batch}"
    )
    failed = candidates.join(completed(labels).select("recordKey"), "recordKey", "left_anti")
    failed.write.mode("overwrite").parquet(f"{store}/pending/batch={batch}")


def compact_keys(spark: SparkSession, store: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> None:
    """Move the keys of all batches that have ended to the base. Not while a batch runs."""
    ended = _complete(spark, store)
    folder = Folder(spark, f"{store}/arrivals")
    folded = [b for b in (int(n.split("=")[1]) for n in folder.names(hidden=False)) if b in ended]
    if not folded:
        return
    base = spark.read.schema(f"{_KEYS}, buckets int, bucket int").parquet(current_path(spark, f"{store}/keys")).drop("buckets", "bucket")
    since = spark.read.schema(_KEYS).parquet(f"{store}/arrivals").where(F.col("batch").isin(folded))
    # after a break before the folders are gone the base has their keys already
    _write_base(base.unionByName(since).distinct(), store, rows_per_bucket)
    for batch in folded:
        folder.delete(f"batch={batch}")
    pending, candidates = Folder(spark, f"{store}/pending"), Folder(spark, f"{store}/candidates")
    for batch in ended[:-2]:
        pending.delete(f"batch={batch}")
    for batch in ended:
        candidates.delete(f"batch={batch}")


def compact_store(spark: SparkSession, store: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> None:
    """Fold all label and key folders of batches that have ended into one, one row per article. Not while a stream runs."""
    compact_keys(spark, store, rows_per_bucket)
    current = stored_labels(spark, store).select(*LABEL_COLUMNS)
    replace_table(current.withColumn("batch", F.lit(-1).cast("bigint")), f"{store}/labels", partition_by=["batch"])


def classify_stream(
    articles: DataFrame,
    store: str,
    checkpoint: str,
    fn: Callable[[str], str],
    model: str,
    phrase: str | None = None,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
    existing: DataFrame | None = None,
    fold_every: int = FOLD_EVERY,
    **options,
) -> StreamingQuery:
    """Start the incremental job over a stream of articles.

    ``prepare`` turns a micro-batch into the article table (joins, normalising).
    ``existing`` are an earlier run's label rows, for a store that is not there yet.
    All input available now is processed, then the query stops; run it again
    with the same ``checkpoint`` for what has arrived since. ``options`` are those of :func:`classify_batch`.
    """
    create_store(articles.sparkSession, store, existing)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if len(Folder(spark, f"{store}/arrivals").names(hidden=False)) >= fold_every:
            compact_keys(spark, store)
        classify_batch(prepare(batch), batch_id, store, fn, model, phrase, **options)

    return (
        articles.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
