"""Language-model scoring by masked pseudo-likelihood.

A document's score is the sum over its tokens of ``log p(token | tokens on both sides)``.

*Words.* Tokens are lower-case words, counted over the whole corpus. The network knows them by number: each word seen ``LEAST`` times or more
has one of its own, in order of frequency, as long as numbers fit in two bytes (``numbers_for``), and the others share
a quarter of the numbers by hash. A word's probability is that of its number times the word's share
of the number's occurrences, so probabilities of all words of the corpus sum to one and a word seen once costs
what it should. The shares of the ``KNOWN`` most frequent words are sent to all tasks; a document's
other words meet the table of counts in a join.

*Network.* Each of the ``SIDE`` tokens to the left and to the right has an embedding for its
distance. Their sum goes through tanh and gives two softmax layers: the number's
band of neighbouring numbers, and its place in the band, with a table of
place by band added. With ``n`` bands of ``n`` places a token costs ``2 n`` outputs instead of ``n ** 2``. Above
``TWO_LAYERS`` numbers a third layer gives the spot in the place, by a table of its own: ``3 n`` outputs for ``n ** 3`` numbers.

*Training.* Texts are cut into words and numbered once, and stored as numbers. Documents are dealt by a hash of id and
text to shards of about ``SHARD_TOKENS`` tokens, and in a shard they stand in the order of that hash, so the
model does not depend on files or tasks. Each shard trains a copy of the
network by AdaGrad in numpy; the copies are averaged by Spark, weighed by the tokens they saw, in two rounds of keys, so that no task
adds up very many. Shards are larger where there are many numbers, so that what the copies take stays a share of the texts.
The shards take turns in ``ROUNDS`` rounds, each of which starts from the average of the one before. Every
token of every document is masked once in turn and predicted from those around it, which
never hold it.

*Scoring.* Each token of every document is masked in turn; long texts go through in pieces.

Cases: a null, empty or blank text has no tokens, a sum of 0 and a null mean. A row of any id,
repeated or null, is scored by itself. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.llm.common import as_bytes, slices, stored, table, with_small_batches

SIDE = 2
HIDDEN = 16
BATCH = 2048
RATE = 0.1
ROUNDS = 3
SHARD_TOKENS = 1 << 19
#: Tokens per number in a shard, at least.
TOKENS_PER_NUMBER = 64
#: Most frequent words whose numbers and shares all tasks hold; they are at most ``WORD_BYTES`` long.
KNOWN = 1 << 17
WORD_BYTES = 64
#: Occurrences from which a word has a number of its own: fewer hardly show in what company it stands.
LEAST = 8
#: Numbers are stored in two bytes.
MAX_BANDS = 256
MAX_WIDTH = 40
#: Numbers up to which two layers are enough.
TWO_LAYERS = 1 << 12
LAYERS = ("band", "place", "spot")
#: Distinct words a task counts before it passes the counts on.
COUNTED = 200_000
#: Numbers per row in which parameters travel, and copies up to which one round of keys averages them.
CHUNK = 4096
SPREAD = 32

Parameters = dict[str, np.ndarray]


def bands_for(distinct: int) -> int:
    """Bands, and places in a band: three quarters of the fourth root of the number of words, so that numbers grow as its square root."""
    return int(min(MAX_BANDS, max(8, round(0.75 * distinct**0.25))))


def numbers_for(distinct: int, frequent: int) -> int:
    """Numbers of which three quarters are enough for ``frequent`` words; at least those of ``bands_for``, at most ``MAX_WIDTH ** 3``."""
    least = max(bands_for(distinct) ** 2, frequent + -(-frequent // 3))
    layers = 2 if least <= TWO_LAYERS else 3
    width = round(least ** (1 / layers))
    width += width**layers < least
    return min(width, MAX_WIDTH if layers == 3 else width) ** layers


def layers_of(size: int) -> tuple[int, int]:
    """Layers that give ``size`` numbers, and outputs of each."""
    layers = 2 if size <= TWO_LAYERS else 3
    return layers, round(size ** (1 / layers))


def word_key(word: bytes) -> bytes:
    """A word, or the hash of one that is very long."""
    return word if len(word) <= WORD_BYTES else b"\n" + xxhash.xxh3_128_digest(word)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all words of all texts, by their keys."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            return pa.RecordBatch.from_arrays([pa.array(map(word_key, found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        found: Counter = Counter()
        for batch in slices(batches):
            for data in as_bytes(batch.column(0)):
                found.update((data or b"").lower().split())
                if len(found) > COUNTED:
                    yield out()
                    found = Counter()
        yield out()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Numbers and log shares of the most frequent words, and occurrences per number."""

    size: int
    numbers: dict[bytes, int]
    shares: np.ndarray  # in the order of ``numbers``
    seen: np.ndarray

    @property
    def others(self) -> int:
        """First of the numbers that words share."""
        return self.size - self.size // 4

    def shared_numbers(self, keys: Collection[bytes]) -> list[int]:
        return (self.others + np.fromiter(map(signed_hash, keys), np.int64, len(keys)) % (self.size - self.others)).tolist()


def signed_hash(word: bytes) -> int:
    """Spark's ``xxhash64`` of the word's key."""
    value = xxhash.xxh64_intdigest(word_key(word), 42)
    return value - (1 << 64) if value >> 63 else value


def vocabulary(counts: DataFrame, known: int = KNOWN) -> Vocabulary:
    """From stored ``counts``. The driver gets ``known`` words and one sum per shared number."""
    size = numbers_for(*counts.agg(F.count("*"), F.count_if(F.col("n") >= LEAST)).first())
    made = Vocabulary(size, {}, np.zeros(0), np.zeros(size))
    own = made.others
    top = counts.orderBy(F.desc("n"), "word").limit(max(own, known)).toArrow()
    words, n = as_bytes(top["word"]), top["n"].to_numpy()
    made.seen[: min(own, len(n))] = n[:own]
    # The words with numbers of their own are a stated number of rows.
    apart = counts.sparkSession.createDataFrame([(bytearray(w),) for w in words[:own]], "word binary")
    number = F.pmod(F.xxhash64("word"), F.lit(size - own))
    for row in counts.join(F.broadcast(apart), "word", "left_anti").groupBy(number.alias("i")).agg(F.sum("n").alias("n")).collect():
        made.seen[own + row["i"]] = row["n"]
    at = [*range(min(own, len(words))), *made.shared_numbers(words[own:])]
    made.numbers = dict(zip(words, at))
    made.shares = np.where(np.arange(len(n)) < own, 0.0, np.log(n / np.maximum(made.seen[at], 1))) if len(n) else np.zeros(0)
    return made


@dataclass
class Numbering:
    """A vocabulary as a task uses it: a word's place among the known ones, if it is one."""

    vocabulary: Vocabulary

    def __post_init__(self):
        self.place = {w: i for i, w in enumerate(self.vocabulary.numbers)}
        self.at = np.fromiter(self.vocabulary.numbers.values(), np.int64, len(self.place))

    def _places(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))

    def read(self, data: bytes | None) -> tuple[np.ndarray, float, Counter]:
        """Numbers of a text's words, the sum of the known ones' log shares, and the other words' keys."""
        words = (data or b"").lower().split()
        places = self._places(words)
        at = np.flatnonzero(places < 0)
        rest = [words[i] for i in at.tolist()]
        if rest and max(map(len, rest)) > WORD_BYTES:
            rest = list(map(word_key, rest))
            places[at] = found = self._places(rest)
            at, rest = at[found < 0], [w for w, i in zip(rest, found.tolist()) if i < 0]
        numbers, others = self.at[places], Counter(rest)
        if rest:
            shared = dict(zip(others, self.vocabulary.shared_numbers(others)))
            numbers[at] = [shared[w] for w in rest]
        return numbers, float(self.vocabulary.shares[places[places >= 0]].sum()), others


def starting_parameters(seen: np.ndarray) -> Parameters:
    """Small embeddings; output constants that give the numbers' shares."""
    random, size = np.random.default_rng(7), len(seen)
    layers, width = layers_of(size)
    # The last row of each distance stands for a place outside the text.
    p = {"context": random.normal(0, 0.1, (2 * SIDE, size + 1, HIDDEN)).astype(np.float32), "bias": np.zeros(HIDDEN, np.float32)}
    constants, share = {}, np.log((seen + 1) / (seen.sum() + size))
    for name in reversed(LAYERS[:layers]):
        share = share.reshape(-1, width)
        whole = np.logaddexp.reduce(share, axis=1)
        constants[name], share = share - whole[:, None], whole
    constants["band"] = constants["band"][0] + whole
    for name in LAYERS[:layers]:
        p[name] = random.normal(0, 0.1, (HIDDEN, width)).astype(np.float32)
        p[f"{name}_bias"] = constants[name].astype(np.float32)
    return p


def contexts(ids: np.ndarray, at: np.ndarray, none: int) -> np.ndarray:
    """The tokens around those at ``at``, one row per distance; ``none`` stands for those outside."""
    outside = np.full(SIDE, none, np.int32)
    padded = np.concatenate([outside, ids, outside])
    return np.stack([padded[at + SIDE + j] for j in (*range(-SIDE, 0), *range(1, SIDE + 1))])


def _exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A layer's probabilities, as exponentials and each row's sum of them."""
    # Far above what the layers give; keeps sums finite without a look for each row's greatest.
    if x.size and x.max() > 80:
        np.minimum(x, 80, out=x)
    np.exp(x, out=x)
    return x, np.einsum("ij->i", x)


def forward(p: Parameters, around: np.ndarray, targets: np.ndarray):
    """Hidden values, all layers' ``_exponentials``, their tables' rows and outputs for the targets, and the targets' log-probabilities."""
    hidden = np.take(p["context"][0], around[0], axis=0)
    for j in range(1, 2 * SIDE):
        hidden += np.take(p["context"][j], around[j], axis=0)
    hidden += p["bias"]
    np.tanh(hidden, out=hidden)
    names, width = [k for k in LAYERS if k in p], len(p["band_bias"])
    path, row = [], targets
    for _ in names[1:]:
        up = row // width
        path.append((up, row - up * width))
        row = up
    path = [(None, row), *reversed(path)]
    outputs, logs, begin = [], 0.0, np.arange(0, width * len(targets), width)
    for name, (row, output) in zip(names, path):
        constants = p[f"{name}_bias"]
        layer = hidden @ p[name]
        layer += constants if name == "band" else np.take(constants, row, axis=0)
        layer, whole = _exponentials(layer)
        outputs.append((layer, whole))
        logs = logs + np.log(np.take(layer, begin + output) / whole + 1e-30)
    return hidden, outputs, path, logs


class Trainer:
    """AdaGrad over one copy of the parameters."""

    def __init__(self, p: Parameters):
        self.p = {k: v.copy() for k, v in p.items()}
        # One scale per embedding row and table row, one per number elsewhere.
        self.sums = {k: np.full(v.shape[:-1] + (1,) if v.ndim > 2 or k in ("place_bias", "spot_bias") else v.shape, 1e-2, np.float32) for k, v in p.items()}

    def _all(self, name: str, slope: np.ndarray) -> None:
        self.sums[name] += slope**2
        self.p[name] -= RATE * slope / np.sqrt(self.sums[name])

    def _rows(self, values: np.ndarray, sums: np.ndarray, at: np.ndarray, slope: np.ndarray) -> None:
        """A step of the rows ``at`` of several tables, one row of ``at`` for each; all go through ``slope``."""
        tables, n = at.shape
        # Sorting two-byte numbers takes one pass.
        order = np.argsort(at.astype(np.uint16), axis=1, kind="stable").ravel()
        rows = (at + np.arange(tables, dtype=at.dtype)[:, None] * values.shape[1]).ravel()[order + np.repeat(np.arange(tables) * n, n)]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        rows, times = rows[first], np.diff(first, append=len(order))
        total = np.take(slope, order[first], axis=0)
        # Most rows come once: only the others are added up.
        if (several := times > 1).any():
            part, some = np.take(slope, order[np.repeat(several, times)], axis=0), times[several]
            total[several] = np.add.reduceat(part, np.cumsum(some) - some, axis=0)
        values, sums = values.reshape(-1, values.shape[-1]), sums.reshape(-1)
        scale = sums[rows] + np.einsum("ij,ij->i", total, total) / total.shape[1]
        sums[rows] = scale
        total *= (RATE / np.sqrt(scale))[:, None]
        moved = np.take(values, rows, axis=0)
        moved -= total
        values[rows] = moved

    def step(self, around: np.ndarray, targets: np.ndarray) -> None:
        p, n = self.p, len(targets)
        hidden, outputs, path, _ = forward(p, around, targets)
        names, at, slopes = LAYERS[: len(path)], np.arange(n), []
        for (slope, whole), (_, output) in zip(outputs, path):
            slope *= (1 / (n * whole))[:, None]
            slope[at, output] -= 1 / n
            slopes.append(slope)
        inner = sum(slope @ p[name].T for name, slope in zip(names, slopes)) * (1 - hidden**2)
        for name, slope, (row, _) in zip(names, slopes, path):
            self._all(name, hidden.T @ slope)
            if name == "band":
                self._all("band_bias", slope.sum(axis=0))
            else:
                self._rows(p[f"{name}_bias"][None], self.sums[f"{name}_bias"][None], row[None], slope)
        self._all("bias", inner.sum(axis=0))
        self._rows(p["context"], self.sums["context"], around, inner)


def packed(p: Parameters) -> np.ndarray:
    return np.concatenate([v.ravel() for v in p.values()])


def unpacked(flat: np.ndarray, like: Parameters) -> Parameters:
    out, start = {}, 0
    for k, v in like.items():
        out[k] = flat[start : start + v.size].reshape(v.shape)
        start += v.size
    return out


def _summed(batches: Iterator[pa.RecordBatch], copies: bool = False, last: bool = False) -> Iterator[pa.RecordBatch]:
    """Weighed sums of parameter chunks per key, added up in the order in which they come; holds one sum per chunk.

    ``copies`` are not weighed yet; the ``last`` sums are divided by their weights. Both are in four bytes a number.
    """
    sums: dict[tuple[int, int], tuple[float, np.ndarray]] = {}
    for batch in batches:
        for key, chunk, n, values in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
            weight, total = sums.get((key, chunk), (0.0, 0.0))
            part = n * np.frombuffer(values, np.float32).astype(np.float64) if copies else np.frombuffer(values, np.float64)
            sums[key, chunk] = (weight + n, total + part)
    rows = sorted(sums.items())
    keys = [pa.array([k[i] for k, _ in rows], pa.int32()) for i in (0, 1)]
    yield pa.RecordBatch.from_arrays(
        [*keys, keys[0], pa.array([w for _, (w, _) in rows], pa.float64()), pa.array([((t / w).astype(np.float32) if last else t).tobytes() for _, (w, t) in rows], pa.binary())],
        names=["key", "chunk", "shard", "n", "total"],
    )


def examples(texts: Iterable[np.ndarray], none: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each token of each text once, with the tokens around it, in batches of ``BATCH``; the last may be smaller."""
    outside = np.full(SIDE, none, np.int32)
    held, size = [], 0

    def batch() -> tuple[np.ndarray, np.ndarray]:
        if len(held) == 1:
            (part, left, right), n = held[0], size
            row = np.concatenate([left, part, right])
            return np.stack([row[SIDE + j : SIDE + j + n] for j in (*range(-SIDE, 0), *range(1, SIDE + 1))]), part
        # Texts in one row, each with places outside it on both sides; pieces of one text keep their neighbours.
        row = np.concatenate([x for part, left, right in held for x in (left, part, right)])
        at = np.concatenate([np.arange(len(part)) for part, _, _ in held])
        sizes = np.array([len(part) for part, _, _ in held])
        at += np.repeat(np.cumsum(sizes + 2 * SIDE) - sizes - SIDE, sizes)
        return np.stack([row[at + j] for j in (*range(-SIDE, 0), *range(1, SIDE + 1))]), row[at]

    for ids in texts:
        padded = np.concatenate([outside, ids, outside])
        first = 0
        while first < len(ids):
            last = min(first + BATCH - size, len(ids))
            held.append((ids[first:last], padded[first : first + SIDE], padded[last + SIDE : last + 2 * SIDE]))
            size, first = size + last - first, last
            if size == BATCH:
                yield batch()
                held, size = [], 0
    if held:
        yield batch()


def as_numbers(column: pa.Array) -> Iterator[np.ndarray]:
    return (np.frombuffer(data, "<u2").astype(np.int32) for data in column.to_pylist())


def trained(numbered: DataFrame, start: Parameters, tokens: int, rounds: int = ROUNDS, shard_tokens: int = SHARD_TOKENS) -> Parameters:
    """The network after ``rounds`` rounds over disjoint shares of the rows (order, ids) with so many ``tokens``."""
    shape = "key int, chunk int, shard int, n double, total binary"
    shards = max(1, -(-tokens // shard_tokens))
    rounds = min(rounds, shards)
    copies = -(-shards // rounds)
    spread = 1 if copies <= SPREAD else math.isqrt(copies)
    context = numbered.sparkSession.sparkContext
    none = start["context"].shape[1] - 1
    in_shards = numbered.select("order", "ids", F.pmod("order", F.lit(shards)).cast("int").alias("shard"))

    def training(shared):
        def copy(shard: int, trainer: Trainer, seen: int) -> pa.RecordBatch:
            flat = packed(trainer.p)
            parts = [flat[i : i + CHUNK].tobytes() for i in range(0, len(flat), CHUNK)]
            n = len(parts)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard // rounds % spread] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([shard] * n, pa.int32()), pa.array([float(seen)] * n), pa.array(parts, pa.binary())],
                names=["key", "chunk", "shard", "n", "total"],
            )

        def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[np.ndarray]]]:
            rows = ((s, ids) for batch in batches for s, ids in zip(batch.column(0).to_pylist(), as_numbers(batch.column(1))))
            return ((s, (ids for _, ids in some)) for s, some in groupby(rows, key=lambda r: r[0]))

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard, texts in by_shard(batches):
                trainer, seen = Trainer(shared.value), 0
                for around, targets in examples(texts, none):
                    trainer.step(around, targets)
                    seen += len(targets)
                if seen:
                    yield copy(shard, trainer, seen)

        return train

    now = start
    for turn in range(rounds):
        mine = in_shards.where(F.col("shard") % rounds == turn).repartition("shard").sortWithinPartitions("shard", "order")
        shared = context.broadcast(now)
        made = mine.select("shard", "ids").mapInArrow(training(shared), shape)
        # Added up in the order of the shards, so that every run gives the same.
        sums = made.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "shard").mapInArrow(partial(_summed, copies=True, last=spread == 1), shape)
        if spread > 1:
            sums = sums.repartition("chunk").sortWithinPartitions("chunk", "key").withColumn("key", F.lit(0)).mapInArrow(partial(_summed, last=True), shape)
        rows = sorted(sums.select("chunk", "total").collect())
        shared.destroy()
        if rows:
            now = unpacked(np.concatenate([np.frombuffer(r["total"], np.float32) for r in rows]), start)
    return now


def log_probability(p: Parameters, ids: np.ndarray) -> float:
    """Sum over a text's tokens of the log-probability of their numbers given both sides; a long text goes through in pieces.

    Texts go through one by one, so that a sum is the same to the last bit in any company.
    """
    return float(sum(forward(p, around, targets)[3].sum(dtype=np.float64) for around, targets in examples([ids], p["context"].shape[1] - 1)))


def numbered_texts(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """(row, doc_id, order, n_tokens, ids, share, rare) per row, stored: a text as numbers, and what its words add to their numbers' probabilities.

    ``share`` is the sum over known words, ``rare`` are the other words with their times in the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)
    names = ["n_tokens", "ids", "share", "rare"]

    @F.arrow_udf("struct<n_tokens:bigint,ids:binary,share:double,rare:array<struct<word:binary,times:int>>>")
    def number(texts: pa.Array) -> pa.Array:
        numbering = _numbering(shared)
        rows, words_, times, ends = [], [], [], [0]
        for begin in range(0, len(texts), 512):
            for data in as_bytes(texts.slice(begin, 512)):
                ids, share, others = numbering.read(data)
                rows.append((len(ids), ids.astype("<u2").tobytes(), share))
                words_ += others
                times += others.values()
                ends.append(len(words_))
        columns = list(zip(*rows)) if rows else [()] * 3
        made = [pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.binary(), pa.float64()])]
        rest = pa.StructArray.from_arrays([pa.array(words_, pa.binary()), pa.array(times, pa.int32())], ["word", "times"])
        return pa.StructArray.from_arrays([*made, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest)], names)

    order = F.xxhash64("doc_id", "text").alias("order")
    made = docs.select("doc_id", order, number("text").alias("s")).select(F.monotonically_increasing_id().alias("row"), "doc_id", "order", "s.*")
    return stored(made, "numbered-texts")


_ready: dict[int, Numbering] = {}


def _numbering(shared) -> Numbering:
    """One per worker and vocabulary."""
    if id(shared.value) not in _ready:
        _ready.clear()
        _ready[id(shared.value)] = Numbering(shared.value)
    return _ready[id(shared.value)]


def rare_shares(numbered: DataFrame, counts: DataFrame, words: Vocabulary) -> DataFrame:
    """(row, rare_share): the sum over a text's other words of their log shares of their numbers."""
    sums = words.seen[words.others :]
    # One row per shared number.
    totals = counts.sparkSession.createDataFrame(list(enumerate(sums.tolist())), "number int, total double")
    number = F.pmod(F.xxhash64("word"), F.lit(len(sums))).cast("int").alias("number")
    share: Column = F.log(F.col("n") / F.col("total")).alias("share")
    shares = counts.select("word", "n", number).join(F.broadcast(totals), "number").select("word", share)
    texts = numbered.select("row", F.explode("rare").alias("w")).select("row", "w.word", "w.times")
    return texts.join(shares, "word").groupBy("row").agg(F.sum(F.col("times") * F.col("share")).alias("rare_share"))


def pseudo_likelihood(docs: DataFrame, rounds: int = ROUNDS, known: int = KNOWN) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) per row, by a network trained on all of ``docs``."""
    docs = with_small_batches(docs).select("doc_id", "text")
    counts = stored(word_counts(docs), "word-counts")
    words = vocabulary(counts, known)
    numbered = numbered_texts(docs, words)
    model = trained(numbered, starting_parameters(words.seen), int(words.seen.sum()), rounds, max(SHARD_TOKENS, TOKENS_PER_NUMBER * words.size))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def judge(ids: pa.Array) -> pa.Array:
        return pa.array([log_probability(shared.value, x) for x in as_numbers(ids)], pa.float64())

    rare = stored(rare_shares(numbered, counts, words), "rare-shares")
    scored = numbered.select("row", "doc_id", "n_tokens", (judge("ids") + F.col("share")).alias("known")).join(rare, "row", "left")
    total = (F.col("known") + F.coalesce("rare_share", F.lit(0.0))).alias("log_likelihood")
    mean = F.try_divide("log_likelihood", "n_tokens").alias("mean_log_likelihood")
    return scored.select("doc_id", "n_tokens", total).select("*", mean)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents"))
