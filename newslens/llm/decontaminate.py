"""Benchmark decontamination by winnowing.

Documents and benchmark items are cut into lower-case words. A *window* is
``WINDOW`` consecutive words of an item, or the whole of a shorter item. A
document word inside any occurrence of a window is hit.

1. Both sides are winnowed: of every ``WINDOW - GRAM + 1`` consecutive hashes
   of ``GRAM`` words the rightmost least one is kept. A span of ``WINDOW`` shared
   words holds the same hashes on both sides and so keeps the same one.
2. A Bloom filter of fixed size holds the item side's kept hashes and goes to
   all tasks. A document's kept hash that passes is a seed; it is extended to
   each of the document's windows around it. Items shorter than ``WINDOW`` are
   winnowed by their own length and a width of one, for each such length.
3. The extended windows, as 128-bit digests, are joined with the item windows.
   A false positive of the filter or a seed whose surroundings differ ends here.

The filter has a fixed size whatever the benchmark's; the join is Spark's, which
sends the item windows to all tasks only where it finds them small, and splits a
passage that very many documents hold. A window that many items share is one row
in that join; its items are listed per document afterwards.

Cases: a null or empty text has no words; an item without words has no window.
Rows of one item id are one item; an item without id hits words but is not
listed. Rows equal in ``doc_id`` and text are one document and get one result
each. Empty tables give no hits. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newslens.llm.common import (
    as_bytes,
    bloom_filter,
    gram_hashes,
    passes,
    slices,
    stored,
    table,
    text_digest,
    window_minima,
    with_small_batches,
    word_hashes,
)

WINDOW = 10
GRAM = 6
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def benchmark_words(data: bytes | None) -> list[bytes]:
    return _WORD.findall((data or b"").lower())


def _digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def fingerprints(words: list[bytes], gram: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions kept by winnowing, and all gram hashes."""
    hashes = gram_hashes(word_hashes(words), gram)
    return window_minima(hashes, width), hashes


def item_windows(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Rows of (item_id, length, window digest, kept hashes of the window)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, lengths, digests, kept = [], [], [], []
            for item, data in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                words = benchmark_words(data)
                length = min(window, len(words))
                for i in range(len(words) - length + 1 if words else 0):
                    part = words[i : i + length]
                    k = gram if length == window else length
                    at, hashes = fingerprints(part, k, length - k + 1)
                    ids.append(item)
                    lengths.append(length)
                    digests.append(_digest(part))
                    kept.append(hashes[at].astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.column(0).type), pa.array(lengths, pa.int32()), pa.array(digests, pa.binary()), pa.array(kept, pa.list_(pa.int64()))],
                names=["item_id", "length", "window", "kept"],
            )

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.select("item_id", "text").mapInArrow(
        cut, f"item_id {kind}, length int, window binary, kept array<bigint>"
    )


def document_windows(
    docs: DataFrame, field: np.ndarray, short: list[int], window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """Per document: ``n_words`` and the windows found around seeds that pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    # (window length, gram length, winnowing width)
    schemes = [(window, gram, window - gram + 1), *((n, n, 1) for n in sorted(short))]

    @F.arrow_udf("struct<n_words:bigint,windows:array<struct<start:int,length:int,window:binary>>>")
    def scan(texts: pa.Array) -> pa.Array:
        counts, offsets, starts, lengths, digests = [], [0], [], [], []
        for begin in range(0, len(texts), 512):
            for data in as_bytes(texts.slice(begin, 512)):
                words = benchmark_words(data)
                counts.append(len(words))
                one = word_hashes(words)
                for length, k, width in schemes:
                    if len(words) < length:
                        continue
                    hashes = gram_hashes(one, k)
                    at = window_minima(hashes, width)
                    hit = passes(shared.value, hashes[at])
                    around = {
                        s
                        for p in at[hit].tolist()
                        for s in range(max(0, p + k - length), min(p, len(words) - length) + 1)
                    }
                    for s in sorted(around):
                        starts.append(s)
                        lengths.append(length)
                        digests.append(_digest(words[s : s + length]))
                offsets.append(len(starts))
        found = pa.StructArray.from_arrays(
            [pa.array(starts, pa.int32()), pa.array(lengths, pa.int32()), pa.array(digests, pa.binary())],
            ["start", "length", "window"],
        )
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found)],
            ["n_words", "windows"],
        )

    scanned = docs.withColumn("found", scan("text"))
    return scanned.select("doc_id", text_digest(F.col("text")).alias("digest"), "found.n_words", "found.windows")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs``: doc_id, digest of its text, n_words, n_hit and the sorted ids of the items found in it."""
    docs = with_small_batches(docs)
    if not 0 < gram <= window:
        raise ValueError("a gram has at least one word and at most as many as a window")
    items = stored(item_windows(benchmark, window, gram), "item-windows")
    short = [r[0] for r in items.where(F.col("length") < window).select("length").distinct().collect()]
    field = bloom_filter(items.select(F.explode("kept").alias("kept")))
    scanned = stored(document_windows(docs.select("doc_id", "text"), field, short, window, gram), "document-windows")
    row = ["doc_id", "digest"]
    seeds = (
        scanned.where(F.size("windows") > 0)
        .dropDuplicates(row)
        .select(*row, F.explode("windows").alias("w"))
        .select(*row, "w.*")
    )
    # One row per document, place and window: this is what the two sides share.
    # Item windows are written before they are met, so that Spark can split a passage that very many documents hold.
    shared = stored(seeds.join(stored(items.select("window").distinct(), "windows"), "window"), "shared-windows")
    before = Window.partitionBy(*row).orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    covered = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))))
    words = shared.withColumn("new", covered).groupBy(*row).agg(F.sum("new").cast("long").alias("n_hit"))
    listed = (
        shared.select(*row, "window")
        .distinct()
        .join(stored(items.where(F.col("item_id").isNotNull()).select("window", "item_id").distinct(), "window-items"), "window")
        .select(*row, "item_id")
        .distinct()
        .groupBy(*row)
        .agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    )
    none = F.array().cast("array<string>")
    base = scanned.select(*row, "n_words")
    for side in (words, listed):
        side = side.withColumnsRenamed({c: f"r_{c}" for c in row})
        base = base.join(side, F.col("doc_id").eqNullSafe(F.col("r_doc_id")) & (F.col("digest") == F.col("r_digest")), "left").drop("r_doc_id", "r_digest")
    return base.select(
        *row,
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", none).alias("items"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), placed AS (
  SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS said FROM placed
), cut AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
), hits AS (
  SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS said FROM cut)
  JOIN windows USING (n, said)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words ON doc.doc_id = words.doc_id LEFT JOIN items ON doc.doc_id = items.doc_id
"""
