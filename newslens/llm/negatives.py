"""Hard negatives by length buckets and sorted coordinate lists.

Rows are integer vectors with a label; a row's score for an anchor is their inner
product. An anchor's positives are its best rows of the same label, and a positive's hard
negatives the best rows of another label whose scores lie in a range below the positive's.

*Distinct vectors.* Rows of equal label and vector tie, and ties go by id, so only their
first few ids can ever be chosen: they become one row with those ids, counted up before
anything is shuffled.

*Buckets.* Distinct vectors are dealt by length, longest first, into buckets of about ``BUCKET_ROWS``; equal lengths by a
hash. There are at most ``MAX_BUCKETS``; more rows make more blocks of each. An anchor travels only to
buckets whose greatest length can reach its threshold.

*Coordinates.* In a task, a block holds one sorted list per coordinate of its vectors, brought
to length one. Of an anchor at angle ``a`` from a coordinate's axis, a vector within angle ``t`` has its
own angle within ``t`` of ``a``. ``t`` follows from the threshold and the block's greatest length. The
anchor's ``FOCUS`` greatest coordinates give one range of each list; vectors in all ranges
are candidates, and their scores are computed exactly.

*Thresholds.* An anchor is first scored against ``SAMPLE`` rows, the same for all. The score of
the last one it would take there bounds what it has to look for; rows below cannot be chosen.

The same search runs for positives, in each block over the rows of the anchor's label, and for
negatives. A block's best rows are merged by native windows. Anchors are the stated query set; they
meet every row in blocks of bounded size, in slices of ``ANCHOR_ROWS``.

Cases: a row takes no part without a label or a vector, or with a null or non-finite component, or
where its squared length reaches 2**62, so that scores fit a long. A vector counts as followed by zeros, an
empty one is zero. Rows equal in id, label and vector are one row; other rows of one id are rows of
their own, and so are anchors. A row without an id comes last among ties and is no anchor. Empty tables give no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newslens.llm.common import stored, table, with_small_batches

POSITIVES = 5
NEGATIVES = 3
#: A hard negative's score in percent of the positive's.
LOW_PERCENT, HIGH_PERCENT = 50, 95
BUCKET_ROWS = 4096
MAX_BUCKETS = 1024
ANCHOR_ROWS = 1 << 16
FOCUS = 4
SAMPLE = 4096
#: Room for rounding in angles and ratios of lengths.
SLACK = 1e-9
#: Stands for no threshold at all.
NONE = -(1 << 62)
_ANCHOR = ["anchor_id", "anchor_key"]


class Block:
    """Vectors with labels and ids, and a sorted list per coordinate."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, ids: list[list[int | None]]):
        self.vectors, self.labels, self.ids = vectors, labels, ids
        self.real = vectors.astype(np.float64)
        length = np.sqrt((self.real**2).sum(axis=1))
        self.longest = float(length.max(initial=0))
        self.length = length

    @cached_property
    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        """Per coordinate, the rows in order of their value there, and those values, of vectors of length one."""
        unit = (self.real / np.where(self.length > 0, self.length, 1)[:, None]).T
        order = np.argsort(unit, axis=1, kind="stable")
        return order, np.take_along_axis(unit, order, axis=1)

    def part(self, at: np.ndarray) -> Block:
        return Block(self.vectors[at], self.labels[at], [self.ids[i] for i in at.tolist()])

    def candidates(self, anchor: np.ndarray, threshold: int) -> np.ndarray:
        """Rows that may score ``threshold`` or more; no others do."""
        n, length = len(self.vectors), float(np.sqrt((anchor.astype(np.float64) ** 2).sum()))
        if threshold <= 0:
            return np.arange(n)
        if not length * self.longest or (least := threshold / (length * self.longest) - SLACK) > 1:
            return np.empty(0, np.int64)
        unit = anchor / length
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        angle, reach = np.arccos(np.clip(unit[focus], -1, 1)), np.arccos(least)
        lows, highs = np.cos(np.minimum(np.pi, angle + reach)) - SLACK, np.cos(np.maximum(0, angle - reach)) + SLACK
        order, values = self.lists
        times = np.zeros(n, np.uint8)
        for f, low, high in zip(focus.tolist(), lows, highs):
            begin, end = np.searchsorted(values[f], low, "left"), np.searchsorted(values[f], high, "right")
            times[order[f, begin:end]] += 1
        return np.flatnonzero(times == len(focus))

    def scores(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        # Below 2**53 sums of products are exact in floating point, which is faster.
        if self.longest * float(np.sqrt((anchor.astype(np.float64) ** 2).sum())) < 2.0**52:
            return (self.real[at] @ anchor.astype(np.float64)).astype(np.int64)
        return self.vectors[at] @ anchor

    def first(self, at: np.ndarray, scores: np.ndarray, n: int, own: tuple[int, np.ndarray] | None = None) -> list[tuple[int, int | None]]:
        """The ``n`` best (score, id) of some rows; ``own`` is the anchor itself, which is left out."""
        spare = n + (own is not None)
        if len(at) > spare:
            least = np.partition(scores, len(scores) - spare)[len(scores) - spare]
            at, scores = at[scores >= least], scores[scores >= least]
        found = []
        for i, s in zip(at.tolist(), scores.tolist()):
            mine = own is not None and np.array_equal(self.vectors[i], own[1])
            found += [(s, x) for x in self.ids[i] if not (mine and x == own[0])]
        return sorted(found, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:n]


def matrix(lists: pa.Array, width: int = 0) -> np.ndarray:
    """Integer lists as rows, the shorter ones filled with zeros."""
    sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(width, int(sizes.max(initial=0)))
    out = np.zeros((len(lists), width), np.int64)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _widened(vectors: np.ndarray, width: int) -> np.ndarray:
    return np.pad(vectors, ((0, 0), (0, max(0, width - vectors.shape[1]))))


def _block(parts: list[pa.RecordBatch]) -> Block:
    rows = pa.Table.from_batches(parts).combine_chunks()
    column = {name: rows[name].combine_chunks() if rows[name].num_chunks != 1 else rows[name].chunk(0) for name in ("v", "label", "ids")}
    return Block(matrix(column["v"]), column["label"].to_numpy(zero_copy_only=False), [[x["id"] for x in ids] for ids in column["ids"].to_pylist()])


def window_of(positive: int, low_percent: int, high_percent: int) -> tuple[int, int]:
    """Least and greatest score of a positive's hard negatives."""
    return -(-low_percent * positive // 100), high_percent * positive // 100


# -- the searches of one block ------------------------------------------------


def best_positives(block: Block, anchor: dict, n: int) -> list[tuple[int, int | None]]:
    at = block.candidates(anchor["v"], anchor["threshold"])
    scores = block.scores(at, anchor["v"])
    enough = scores >= anchor["threshold"]
    return block.first(at[enough], scores[enough], n, (anchor["anchor_id"], anchor["v"]))


def best_negatives(block: Block, anchor: dict, n: int, low_percent: int, high_percent: int) -> Iterator[tuple[int, int, int | None]]:
    """(positive_score, score, id): the best rows for each of the anchor's positive scores."""
    at = block.candidates(anchor["v"], anchor["threshold"])
    at = at[block.labels[at] != anchor["label"]]
    scores = block.scores(at, anchor["v"])
    for positive, least in zip(anchor["positives"], anchor["leasts"]):
        fits = (scores >= least) & (scores <= window_of(positive, low_percent, high_percent)[1])
        for score, other in block.first(at[fits], scores[fits], n):
            yield positive, score, other


def _searched(search, by_label: bool, shape: list[str]):
    """A function over rows sorted by block: a block's vectors, then the anchors that came to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, block, labels = None, [], None, {}
        for batch in batches:
            keys = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in ("bucket", "block", "slice", "kind")])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                *here, kind = keys[a].tolist()
                if here != key:
                    key, parts, block, labels = here, [], None, {}
                rows = batch.slice(a, z - a)
                if kind == 0:
                    parts.append(rows.select(["v", "label", "ids"]))
                    continue
                if not parts:
                    continue  # anchors came to a block without rows
                if block is None:
                    block = _block(parts)
                found: list[tuple] = []
                vectors = matrix(rows.column("v"), block.vectors.shape[1])
                if vectors.shape[1] > block.vectors.shape[1]:
                    block, labels = Block(_widened(block.vectors, vectors.shape[1]), block.labels, block.ids), {}
                for anchor, v in zip(rows.select([n for n in rows.schema.names if n not in ("v", "ids")]).to_pylist(), vectors):
                    anchor["v"], where = v, block
                    if by_label:
                        where = labels.get(anchor["label"])
                        if where is None:
                            where = labels[anchor["label"]] = block.part(np.flatnonzero(block.labels == anchor["label"]))
                    found += [(anchor["anchor_id"], anchor["anchor_key"], *r) for r in search(where, anchor)]
                columns = list(zip(*found)) if found else [()] * len(shape)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=shape)

    return run


# -- rows, buckets, thresholds ------------------------------------------------


def distinct_vectors(rows: DataFrame, ids: int) -> DataFrame:
    """(label, v, ids, length2): rows of equal label and vector as one, with their first ``ids`` ids."""
    in_order = Window.partitionBy("label", "v").orderBy(F.col("vec_id").asc_nulls_last())
    some = rows.select("vec_id", "label", "v").withColumn("nth", F.dense_rank().over(in_order)).where(F.col("nth") <= ids)
    one = F.struct(F.col("vec_id").isNull().alias("without"), F.col("vec_id").alias("id"))
    length2 = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    return some.groupBy("label", "v").agg(F.sort_array(F.collect_set(one)).alias("ids")).withColumn("length2", length2)


def _dealt(index: DataFrame, anchors: DataFrame, blocks: int, slices: int) -> DataFrame:
    """Index rows and, behind them, the anchors that reach their bucket, by block."""
    number = F.pmod(F.xxhash64("label", "v", F.lit("block")), F.lit(blocks)).cast("int")
    mine = F.pmod(F.xxhash64(*_ANCHOR), F.lit(slices)).cast("int")
    vectors = index.select("bucket", number.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), "label", "v", "ids")
    reached = anchors.where("reach > 0").withColumn("n", F.explode(F.sequence(F.lit(0), F.col("reach") * blocks - 1))).drop("reach")
    sent = reached.withColumns({"bucket": F.floor(F.col("n") / blocks).cast("int"), "block": (F.col("n") % blocks).cast("int"), "slice": mine, "kind": F.lit(1)}).drop("n")
    keys = ["bucket", "block", "slice"]
    return vectors.unionByName(sent, allowMissingColumns=True).repartition(*keys).sortWithinPartitions(*keys, "kind")


def _nth_best(scores: np.ndarray, n: int) -> int:
    return int(np.partition(scores, len(scores) - n)[len(scores) - n]) if len(scores) >= n else NONE


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low_percent: int = LOW_PERCENT,
    high_percent: int = HIGH_PERCENT,
    bucket_rows: int = BUCKET_ROWS,
    anchor_rows: int = ANCHOR_ROWS,
    sample: int = SAMPLE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows (vec_id, label, v).

    ``v`` is an array of integers; ``is_anchor`` chooses the anchors among the rows.
    """
    rows = with_small_batches(rows)
    context = rows.sparkSession.sparkContext
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<int>").alias("v"), is_anchor.alias("is_anchor"))
    size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    rows = stored(rows.where("label IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)").where(size < 2.0**62), "vectors")
    distinct = stored(distinct_vectors(rows, max(positives + 1, negatives)), "distinct-vectors")
    anchors = rows.where("is_anchor AND vec_id IS NOT NULL").select(F.col("vec_id").alias("anchor_id"), F.xxhash64("label", "v").alias("anchor_key"), "label", "v").distinct()
    anchors = stored(anchors, "anchors")
    n, n_anchors = distinct.count(), anchors.count()
    buckets = max(1, min(MAX_BUCKETS, -(-n // bucket_rows)))
    blocks, slices = max(1, -(-n // (buckets * bucket_rows))), max(1, -(-n_anchors // anchor_rows))
    by_length = distinct.repartitionByRange(buckets, F.desc("length2"), F.xxhash64("label", "v"))
    index = stored(by_length.withColumn("bucket", F.spark_partition_id()), "length-buckets")
    # One row per bucket, of which there are at most ``MAX_BUCKETS``.
    longest = {r["bucket"]: r["top"] for r in index.groupBy("bucket").agg(F.max("length2").alias("top")).collect()}
    lengths = np.sqrt(np.array([longest.get(i, 0) for i in range(max(longest, default=-1) + 1)], np.float64))
    lengths = np.maximum.accumulate(lengths[::-1])[::-1]
    drawn = distinct.orderBy(F.xxhash64("label", "v", F.lit("sample")), "label").limit(sample).select("label", "v", "ids").toArrow()
    seen = _block(drawn.to_batches()) if drawn.num_rows else Block(np.zeros((0, 0), np.int64), np.zeros(0, np.int64), [])
    known = context.broadcast((seen, lengths))

    def prepared(bounds, extra: dict[str, pa.DataType]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, lengths_ = known.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                vectors = matrix(batch.column("v"), seen.vectors.shape[1])
                if vectors.shape[1] > seen.vectors.shape[1]:
                    seen = Block(_widened(seen.vectors, vectors.shape[1]), seen.labels, seen.ids)
                made = []
                for row, v in zip(batch.drop_columns(["v"]).to_pylist(), vectors):
                    scores = seen.scores(np.arange(len(seen.vectors)), v)
                    threshold, *more = bounds(seen, row, v, scores)
                    length = float(np.sqrt((v.astype(np.float64) ** 2).sum()))
                    far = threshold <= 0 or not length
                    made.append((threshold, len(lengths_) if far else int((lengths_ * (1 + SLACK) >= threshold / length).sum()), *more))
                columns = list(zip(*made)) if made else [()] * (2 + len(extra))
                kinds = {"threshold": pa.int64(), "reach": pa.int32(), **extra}
                names = [x for x in batch.schema.names if x != "positives"]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(x) for x in names), *(pa.array(c, k) for c, k in zip(columns, kinds.values()))], names=[*names, *kinds]
                )

        return run

    def from_sample(seen: Block, row: dict, v: np.ndarray, scores: np.ndarray):
        mine = seen.labels == row["label"]
        return (_nth_best(scores[mine & ~(seen.vectors == v).all(axis=1)], positives),)

    def below_positives(seen: Block, row: dict, v: np.ndarray, scores: np.ndarray):
        other = scores[seen.labels != row["label"]]
        values = sorted(set(row["positives"]), reverse=True)
        leasts = []
        for p in values:
            low, high = window_of(p, low_percent, high_percent)
            leasts.append(max(low, _nth_best(other[(other >= low) & (other <= high)], negatives)))
        return min(leasts), values, leasts

    anchor = "anchor_id long, anchor_key long, label long, v array<int>"
    first = anchors.mapInArrow(prepared(from_sample, {}), f"{anchor}, threshold long, reach int")
    names = [*_ANCHOR, "positive_score", "positive_id"]
    found = _dealt(index, first, blocks, slices).mapInArrow(
        _searched(lambda block, a: best_positives(block, a, positives), True, names), ", ".join(f"{x} long" for x in names)
    )
    best = Window.partitionBy(*_ANCHOR).orderBy(F.desc("positive_score"), F.col("positive_id").asc_nulls_last())
    chosen = stored(found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= positives).drop("nth"), "positives")
    # Below a negative score there is no range.
    own = chosen.where("positive_score >= 0").groupBy(*_ANCHOR).agg(F.collect_list("positive_score").alias("positives"))
    lists = {"positives": pa.list_(pa.int64()), "leasts": pa.list_(pa.int64())}
    second = anchors.join(own, _ANCHOR).select(*_ANCHOR, "label", "v", "positives").mapInArrow(
        prepared(below_positives, lists), f"{anchor}, threshold long, reach int, positives array<long>, leasts array<long>"
    )
    names = [*_ANCHOR, "positive_score", "negative_score", "negative_id"]
    found = _dealt(index, second, blocks, slices).mapInArrow(
        _searched(lambda block, a: best_negatives(block, a, negatives, low_percent, high_percent), False, names), ", ".join(f"{x} long" for x in names)
    )
    best = Window.partitionBy(*_ANCHOR, "positive_score").orderBy(F.desc("negative_score"), F.col("negative_id").asc_nulls_last())
    hard = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return chosen.join(hard, [*_ANCHOR, "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def quantised(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v) of ``embeddings``: 256ths, rounded down; every seventh row's label moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    usable = "label IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    # Components beyond an integer's range make a vector too long to take part.
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).try_cast("int"))
    return rows.where(usable).select("vec_id", moved.alias("label"), v.alias("v"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, o.vec_id AS id, a.label = o.label AS same,
         CAST(list_dot_product(a.v, o.v) AS BIGINT) AS score
  FROM vectors a JOIN vectors o ON a.vec_id <> o.vec_id
  WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, n.id AS negative_id, p.positive_score, n.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank
  FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
   AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""
