"""Quality rules: base counts, then a hashed n-gram likelihood ratio of trusted against raw text.

Words and word pairs are hashed to ``buckets`` bins. Two multinomials are
counted over the bins: one from trusted documents, one from every document of
the corpus. A document's score is the mean over its n-grams of
``log p_trusted(bin) - log p_raw(bin)``, in which a trusted document is left out of
the trusted counts; it is kept when the base rules pass and the score reaches ``threshold``.

The fewer the trusted words, the lower every other document scores. So all scores are
moved by one number, found on the labelled documents that pass the base rules: the
cut that best parts good from bad ones (greatest sum of the shares kept and
rejected) comes to lie at ``threshold``. Where none of them is bad, the cut is the
lowest score of a good one. Of the ``SMOOTHINGS`` the one that parts them best is
used, of equals the least.

Trusted documents are those labelled ``quality = 1``. They are a bounded sample
of labelled rows: the ``trusted_limit`` ones lowest by a hash of their id, so the
sample is the same in every run and small enough to be sent to all tasks. The
raw multinomial covers all words of all documents.

Cases: a null or empty text has no words, fails the base rules and scores 0.
A row of any id, repeated or null, gets its own verdict. An id labelled both good and bad
is good. No labels, or none trusted: both multinomials are the raw one, every score
is 0 and only the base rules decide. No good document passes the base rules: there is
no cut, and scores are the plain ratios. Other columns pass
through, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.llm.common import (
    SPACE,
    as_bytes,
    bloom_filter,
    free_name,
    gram_hashes,
    mixed,
    passes,
    slices,
    table,
    with_small_batches,
    word_hashes,
)

BUCKETS = 1 << 16
TRUSTED_LIMIT = 20_000
THRESHOLD = -0.1
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
#: Pseudo-counts per bin of the trusted table to choose from, and steps per unit in which scores are counted to find the cut.
SMOOTHINGS = (0.1, 0.01, 0.001)
STEPS = 1000
#: Bits of the filter that tells the tasks which documents may be labelled (1 MB).
LABELLED_BITS = 1 << 23

VERDICT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, llr double, kept boolean"
)


def repeated_words(words: list[bytes], hashes: np.ndarray) -> int:
    """Words inside three-word windows that occur twice or more.

    Equal windows have equal hashes, so only the windows that share one are compared.
    """
    windows = gram_hashes(hashes, 3)
    ordered = np.sort(windows)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    places = np.flatnonzero(np.isin(windows, again)).tolist()
    found = [tuple(words[i : i + 3]) for i in places]
    times = Counter(found)
    inside, end = 0, 0
    for i, window in zip(places, found):
        if times[window] > 1:
            inside += i + 3 - max(i, end)
            end = i + 3
    return inside


def base_counts(data: bytes, words: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int, int, bool]:
    n = len(words)
    lines = [line for line in data.split(b"\n") if line.strip(SPACE)]
    repeats = repeated_words(words, hashes)
    return (
        n,
        len(b"".join(words).decode("utf-8")),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeats,
        n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n,
    )


def grams(words: list[bytes], buckets: int) -> np.ndarray:
    """Bins of the words and of the word pairs of one text."""
    return gram_bins(word_hashes(words), buckets)


def gram_bins(one: np.ndarray, buckets: int) -> np.ndarray:
    """``grams`` of the text whose words have these hashes."""
    with np.errstate(over="ignore"):
        two = mixed(one[:-1] * np.uint64(3) + one[1:])
    return (np.concatenate([one, two]) % np.uint64(buckets)).astype(np.int64)


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_LIMIT) -> DataFrame:
    """At most ``limit`` ids labelled good, by a hash order that is the same in every run."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def gram_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Occurrences per bin in all documents (``raw``) and in trusted ones: one small row per bin."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in slices(batches, 64):
            found = [grams((data or b"").split(), buckets) for data in as_bytes(batch.column(0))]
            raw += np.bincount(np.concatenate(found), minlength=buckets)
            own = [bins for bins, chosen in zip(found, batch.column(1).to_pylist()) if chosen]
            if own:
                good += np.bincount(np.concatenate(own), minlength=buckets)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(good[seen])], names=["bin", "raw", "good"])

    marked = docs.select("doc_id", "text").join(
        F.broadcast(trusted.select("doc_id", F.lit(True).alias("chosen"))), "doc_id", "left"
    )
    return (
        marked.select("text", "chosen")
        .mapInArrow(count, "bin long, raw long, good long")
        .groupBy("bin")
        .agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    )


@dataclass
class Ratios:
    """Trusted counts and their sum, raw shares per bin and their logarithms, and the logarithm of the ratio by smoothing."""

    good: np.ndarray
    total: float
    share: np.ndarray
    log_share: np.ndarray
    tables: list[np.ndarray]

    def score(self, bins: np.ndarray, held_out: bool = False, which: int = 0) -> float:
        """Mean log ratio over a text's bins (see :meth:`scores`)."""
        return self.scores(bins, held_out, [which])[0]

    def scores(self, bins: np.ndarray, held_out: bool = False, smoothings: Sequence[int] = range(len(SMOOTHINGS))) -> list[float]:
        """Mean log ratio over a text's bins by smoothing; ``held_out`` takes its occurrences out of the trusted counts.

        The total stays the one that documents outside the trusted set are scored with.
        """
        if not len(bins):
            return [0.0] * len(smoothings)
        if not held_out:
            return [float(np.mean(self.tables[which][bins], dtype=np.float64)) for which in smoothings]
        at, times = np.unique(bins, return_counts=True)
        left, share, log_share = self.good[at] - times, self.share[at], self.log_share[at]
        found = []
        for which in smoothings:
            spread = len(self.share) * SMOOTHINGS[which]
            ratio = np.log((left + share * spread) / (self.total + spread)) - log_share
            found.append(float(times @ ratio / len(bins)))
        return found


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> Ratios:
    """The ratio tables, one number per bin; the driver gets at most ``buckets`` rows."""
    raw, good = np.zeros(buckets), np.zeros(buckets)
    for row in counts.collect():
        raw[row["bin"]], good[row["bin"]] = row["raw"], row["good"]
    if not good.sum():
        return Ratios(good, 0.0, raw, np.zeros(buckets), [np.zeros(buckets, np.float32)])
    # One occurrence spread over all bins by the raw shares smooths the smaller table.
    share = (raw + 1) / (raw.sum() + buckets)
    total, log_share = good.sum(), np.log(share)
    smooth = [(good + share * buckets * s) / (total + buckets * s) for s in SMOOTHINGS]
    return Ratios(good, total, share, log_share, [(np.log(x) - log_share).astype(np.float32) for x in smooth])


def best_cut(good: dict[int, int], bad: dict[int, int]) -> tuple[float, float]:
    """From documents per step of score: how far the shares kept differ, and the score where they differ most.

    Between two steps the middle.
    """
    if not bad:
        return 1.0, min(good) / STEPS
    places = sorted({*good, *bad})
    kept = np.cumsum([good.get(i, 0) for i in places][::-1])[::-1] / sum(good.values())
    let_in = np.cumsum([bad.get(i, 0) for i in places][::-1])[::-1] / sum(bad.values())
    i = int(np.argmax(kept - let_in))
    below = places[i - 1] + 1 if i else places[i]
    return float((kept - let_in)[i]), (below + places[i]) / 2 / STEPS


def labelled_scores(docs: DataFrame, labels: DataFrame, own: str, shared: Broadcast, buckets: int) -> DataFrame:
    """(doc_id, scores): a document's score per smoothing, of those that pass the base rules and may be labelled.

    ``own`` is the column that marks trusted documents. Which documents are labelled is told to the tasks by a filter of
    fixed size, so that others are not read word by word and no text is shuffled; it lets some others through.
    """
    key = F.xxhash64(F.col("doc_id").cast("string"))
    known = docs.sparkSession.sparkContext.broadcast(bloom_filter(labels.where("quality IN (0, 1)").select(key), LABELLED_BITS))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            may_be = pa.array(passes(known.value, batch.column("key").to_numpy()))
            ids, rows = [], []
            batch = batch.filter(may_be)
            for i, (data, chosen) in enumerate(zip(as_bytes(batch.column("text")), batch.column(own).to_pylist())):
                words = (data or b"").split()
                hashes = word_hashes(words)
                if not base_counts(data or b"", words, hashes)[5]:
                    bins = gram_bins(hashes, buckets)
                    ids.append(i)
                    rows.append(shared.value.scores(bins, bool(chosen)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "scores"])

    rows = docs.where("doc_id IS NOT NULL").select("doc_id", key.alias("key"), "text", own)
    return rows.mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, scores array<double>")


def found_cut(scored: DataFrame, labels: DataFrame) -> tuple[int, float] | None:
    """The smoothing's number and the cut that part good and bad documents best; None without good ones.

    ``scored`` has a document's score per smoothing (see :func:`labelled_scores`). All
    labelled documents count. Only scores and ids meet the labels, and the driver
    gets one row per step that a score fell in.
    """
    known = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    steps = scored.join(known, "doc_id").select("quality", F.posexplode("scores").alias("which", "score"))
    steps = steps.groupBy("which", "quality", F.floor(F.col("score") * STEPS).alias("step")).count().collect()
    if not any(r["quality"] == 1 for r in steps):
        return None
    found = []
    for which in range(len(SMOOTHINGS)):
        good, bad = ({r["step"]: r["count"] for r in steps if (r["which"], r["quality"]) == (which, q)} for q in (1, 0))
        found.append((which, *best_cut(good, bad)))
    which, _, cut = max(found, key=lambda x: (x[1], x[0]))
    return which, cut


def quality_verdicts(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = THRESHOLD,
    buckets: int = BUCKETS,
    trusted_limit: int = TRUSTED_LIMIT,
    into: str = "quality_verdict",
) -> DataFrame:
    """``docs`` with a struct column ``into`` (fields: ``VERDICT``)."""
    docs = with_small_batches(docs)
    trusted = trusted_ids(labels, trusted_limit)
    ratios = log_ratios(gram_counts(docs, trusted, buckets), buckets)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
    names = [f.split()[0] for f in VERDICT.split(", ")]

    def judge(hold_out: bool, which: int, moved: float):
        @F.arrow_udf(f"struct<{VERDICT.replace(' ', ':').replace(',:', ',')}>")
        def verdict(texts: pa.Array, chosen: pa.Array) -> pa.Array:
            rows = []
            for start in range(0, len(texts), 512):
                for data, own in zip(as_bytes(texts.slice(start, 512)), chosen.slice(start, 512).to_pylist()):
                    words = (data or b"").split()
                    hashes = word_hashes(words)
                    base = base_counts(data or b"", words, hashes)
                    score = shared.value.score(gram_bins(hashes, buckets), bool(own) and hold_out, which) + moved if words else 0.0
                    rows.append((*base, score, not base[5] and score >= threshold))
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        return verdict

    own = free_name(docs, "trusted")
    marked = docs.join(F.broadcast(trusted.select("doc_id", F.lit(True).alias(own))), "doc_id", "left").select(*(f"`{c}`" for c in docs.columns), own)
    cut = found_cut(labelled_scores(marked, labels, own, shared, buckets), labels) if ratios.good.any() else None
    last = judge(False, 0, 0.0) if cut is None else judge(True, cut[0], threshold - cut[1])
    return marked.withColumn(into, last("text", own)).drop(own)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_verdicts(docs.select("doc_id", "text"), labels).select("doc_id", "quality_verdict.*")
