"""Toxicity by a classifier chain of linear models.

Categories have an order. Each has a logistic model over the hashed four-byte pieces a
lower-cased text contains, which also tell insults inside compound words; from the second on, a model also sees the earlier categories'
probabilities. While a later model is trained, those come out of fold: every document's
earlier probabilities are from models that were fitted without its fold, as they will be for
documents nobody has seen. Equal texts share a fold. The cut of a category's probability is
the one of greatest F1 among the out-of-fold predictions.

The models are fitted on a bounded sample of labelled documents: the ``SAMPLE`` ones
lowest by a hash of their id. The driver gets the sample's sets of pieces (at most
``BUCKETS`` numbers each), fits there, and sends the weights to all tasks. Every
document of the corpus is scored by its whole text.

Cases: a null or empty text has no pieces and gets the models' constants. A row of any id, repeated or null,
is scored by itself. Several labels of one id: the greater counts. Several documents of a labelled id: one of them is in
the sample. A document without a label of some category takes no part in that category's fit. A category without
both kinds of examples, or no labels at all: its probability is the (smoothed) share of positives,
and nothing is flagged. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.llm.common import as_bytes, mixed, table, with_small_batches

BUCKETS = 1 << 18
SAMPLE = 6_000
FOLDS = 4
#: Pieces found in fewer sampled documents have no weight.
MIN_DOCUMENTS = 5
PENALTY = 5.0
PIECE = 4


def piece_buckets(data: bytes | None, buckets: int = BUCKETS) -> np.ndarray:
    """Bins of the runs of ``PIECE`` bytes in a text, each once."""
    codes = np.frombuffer((data or b"").lower(), np.uint8).astype(np.uint64)
    n = max(0, len(codes) - PIECE + 1)
    runs = np.zeros(n, np.uint64)
    for j in range(PIECE):
        runs = runs * np.uint64(256) + codes[j : j + n]
    return np.unique((mixed(runs) % np.uint64(buckets)).astype(np.int32))


@dataclass
class Link:
    """One model of the chain."""

    pieces: np.ndarray  # weight per bucket
    earlier: np.ndarray  # weight per earlier category's probability
    constant: float
    cut: float = 1.1  # flag at or above this probability


def _minimise(loss, x: np.ndarray, steps: int = 60, memory: int = 8) -> np.ndarray:
    """L-BFGS with step halving; ``loss`` gives value and gradient."""
    value, slope = loss(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, alphas = slope.copy(), []
        for s, y, r in reversed(past):
            alphas.append(r * (s @ q))
            q -= alphas[-1] * y
        if past:
            s, y, r = past[-1]
            q /= r * (y @ y)
        for (s, y, r), a in zip(past, reversed(alphas)):
            q += (a - r * (y @ q)) * s
        size = 1.0 if past else min(1.0, 1.0 / (np.abs(slope).sum() + 1e-12))
        while True:
            new = x - size * q
            new_value, new_slope = loss(new)
            if new_value <= value - 1e-4 * size * (slope @ q) or size < 1e-6:
                break
            size /= 2
        s, y = new - x, new_slope - slope
        if s @ y > 1e-10:
            past = [*past, (s, y, 1 / (s @ y))][-memory:]
        done = abs(value - new_value) <= 1e-6 * max(1.0, abs(value))
        x, value, slope = new, new_value, new_slope
        if done:
            break
    return x


class PieceSets:
    """Sampled documents as sets of columns, one column per frequent bucket."""

    def __init__(self, rows: list[np.ndarray], buckets: int, least: int):
        found = np.bincount(np.concatenate([*rows, np.empty(0, np.int32)]), minlength=buckets)
        self.kept = np.flatnonzero(found >= least)
        column = np.full(buckets, -1, np.int64)
        column[self.kept] = np.arange(len(self.kept))
        column = column.astype(np.int32)
        kept = [c[c >= 0] for c in (column[r] for r in rows)]
        self.columns = np.concatenate([*kept, np.empty(0, np.int32)])
        self.sizes = np.array([len(k) for k in kept], np.int64)
        self.ends = np.cumsum(self.sizes)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        up_to = np.concatenate([[0.0], np.cumsum(weights[self.columns])])
        return up_to[self.ends] - up_to[self.ends - self.sizes]

    def sums(self, per_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, np.repeat(per_row, self.sizes), len(self.kept))


def _fit(sets: PieceSets, earlier: np.ndarray, y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Weights of (pieces, earlier, constant) from the rows in ``use``."""
    k, e = len(sets.kept), earlier.shape[1]

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = sets.scores(x[:k]) + earlier @ x[k : k + e] + x[-1]
        off = np.where(use, 1 / (1 + np.exp(-z)) - y, 0.0)
        value = np.where(use, np.logaddexp(0, z) - y * z, 0.0).sum() + PENALTY / 2 * (x[:-1] @ x[:-1])
        slope = np.concatenate([sets.sums(off), off @ earlier, [off.sum()]])
        slope[:-1] += PENALTY * x[:-1]
        return value, slope

    return _minimise(loss, np.zeros(k + e + 1))


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The probability at which flagging gives the greatest F1, halfway to the next one below."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    best = int(np.argmax(f1))
    last, below = z[order[best]], z[order[min(best + 1, len(y) - 1)]]
    return float(1 / (1 + np.exp(-(last + below) / 2)))


def fit_chain(
    rows: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, buckets: int = BUCKETS, least: int = MIN_DOCUMENTS
) -> list[Link]:
    """Models in the order of the columns of ``labels`` (0, 1 or NaN where missing, one row per sampled document)."""
    sets = PieceSets(rows, buckets, least)
    n, categories = labels.shape
    earlier, chain = np.zeros((n, 0)), []
    for c in range(categories):
        known = ~np.isnan(labels[:, c].astype(float))
        y = np.where(known, labels[:, c], 0).astype(float)
        if not 0 < y.sum() < known.sum():
            share = (y.sum() + 0.5) / (known.sum() + 1)
            chain.append(Link(np.zeros(buckets, np.float32), np.zeros(c), float(np.log(share / (1 - share)))))
            earlier = np.column_stack([earlier, np.full(n, share)])
            continue
        k, unseen = len(sets.kept), np.zeros(n)
        for fold in np.unique(folds):
            x = _fit(sets, earlier, y, known & (folds != fold))
            z = sets.scores(x[:k]) + earlier @ x[k:-1] + x[-1]
            unseen[folds == fold] = z[folds == fold]
        x = _fit(sets, earlier, y, known)
        pieces = np.zeros(buckets, np.float32)
        pieces[sets.kept] = x[:k]
        chain.append(Link(pieces, x[k:-1], float(x[-1]), _best_cut(unseen[known], y[known])))
        earlier = np.column_stack([earlier, 1 / (1 + np.exp(-unseen))])
    return chain


def score(chain: list[Link], found: np.ndarray) -> list[float]:
    """Probabilities of one document's categories, each from its pieces and the earlier ones."""
    p: list[float] = []
    for link in chain:
        z = link.pieces[found].sum(dtype=np.float64) + link.earlier @ np.array(p) + link.constant
        p.append(float(1 / (1 + np.exp(-z))))
    return p


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: list[str], limit: int = SAMPLE, buckets: int = BUCKETS):
    """Sets of pieces, labels and folds of the sample, on the driver."""
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.max(c).alias(f"_{c}") for c in categories))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)

    @F.arrow_udf("array<int>")
    def found(texts: pa.Array) -> pa.Array:
        sets = [piece_buckets(data, buckets) for data in as_bytes(texts)]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.empty(0, np.int32)])))

    # The sample has a fixed number of rows, so it may be sent to all tasks. One document per id comes back.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id")
    one = texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = (
        one.join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "text", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).alias("fold"), *(F.col(f"_{c}").cast("double") for c in categories))
        .select("doc_id", "fold", *(f"_{c}" for c in categories), found("text").alias("pieces"))
        .toArrow()
        .sort_by([("doc_id", "ascending"), ("fold", "ascending")])
    )
    sets = rows["pieces"].combine_chunks()
    flat, ends = sets.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(sets).to_numpy(zero_copy_only=False))
    pieces = np.split(flat, ends[:-1]) if len(sets) else []
    y = np.column_stack([rows[f"_{c}"].to_numpy().astype(float) for c in categories]) if len(pieces) else np.zeros((0, len(categories)))
    return pieces, y, rows["fold"].to_numpy()


def toxicity(docs: DataFrame, labels: DataFrame, categories: list[str], limit: int = SAMPLE, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id``, and per category its probability ``p_<name>`` and the flag ``<name>``; ``labels`` holds 0/1 columns of those names."""
    docs = with_small_batches(docs)
    pieces, y, folds = labelled_sample(docs, labels, categories, limit, buckets)
    shared = docs.sparkSession.sparkContext.broadcast(fit_chain(pieces, y, folds, buckets))
    names = [x for c in categories for x in (f"p_{c}", c)]

    @F.arrow_udf("struct<" + ",".join(f"p_{c}:double,{c}:boolean" for c in categories) + ">")
    def predict(texts: pa.Array) -> pa.Array:
        chain = shared.value
        p = [score(chain, piece_buckets(data, buckets)) for start in range(0, len(texts), 512) for data in as_bytes(texts.slice(start, 512))]
        columns = []
        for i, link in enumerate(chain):
            mine = [row[i] for row in p]
            columns += [pa.array(mine, pa.float64()), pa.array([x >= link.cut for x in mine], pa.bool_())]
        return pa.StructArray.from_arrays(columns, names)

    return docs.select("doc_id", predict("text").alias("p")).select("doc_id", "p.*")


#: The chain of the query: junk first, which toxic text is more often part of.
CATEGORIES = ["low_quality", "toxic"]


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", (F.col("quality") == 0).cast("int").alias("low_quality"), F.col("toxic").cast("int").alias("toxic")
    )
    scored = toxicity(table(spark, sf_dir, "documents"), labels, CATEGORIES)
    return scored.select("doc_id", "toxic", "p_toxic", "p_low_quality")
