"""Repeated passages by sparse suffix arrays.

Texts are lower-case words. Of all suffixes only those are kept that begin at a
content-selected place: the rightmost least word-pair hash of some ``WIDTH``
consecutive ones. Equal passages choose equal places, so a passage of at least
``MIN_WORDS`` words has a kept suffix within its first ``WIDTH`` words, and at least
``HEAD`` words of the passage follow there.

1. A kept suffix is known by the hash of its first ``HEAD`` words. Heads that
   occur once are left out; the others match somewhere.
2. Kept places of a passage lie at most ``WIDTH`` words apart, less than ``HEAD``, so their
   matches touch and merge into runs. Only a run's first and last suffix have
   anything to gain from extension.
3. Suffixes with the head of some run's last suffix are sorted by what follows the head, those
   with the head of a first one by what precedes it, backwards. The sorts are range partitionings with ties by
   document and place, so a passage that very many documents hold is spread over
   tasks; a range's first row is also set beside the last one of the range before.
4. Each suffix is compared with its two neighbours, which share the longest
   stretch with it, and the match is extended to the right, or the left, as far as the words agree.
5. Runs and extended matches merge into spans of ``MIN_WORDS`` words or more.
6. Matches that touch may be with different partners. So spans whose whole content is not found elsewhere are cut down to those of
   their runs of ``MIN_WORDS`` words that are, by the hashes of such runs inside spans.

Texts are read twice, the second time for the words of runs and around their ends.

Cases: null, empty and blank texts, and those shorter than ``HEAD`` words, have no
suffix. Rows equal in ``doc_id`` and text are one document. A passage repeated within one
document counts. Rows without an id are compared, and reported with a null id.
Empty tables give no rows. Other columns are not read. Words are compared by
hashes, the head by 64 bits, each word around it by 32.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newslens.llm.common import as_bytes, bloom_filter, gram_hashes, hashed_texts, minima_within, passes, slices, stored, table, with_small_batches

MIN_WORDS = 50
WIDTH = 24
_OWN = ["doc_id", "digest"]


def _digest() -> Column:
    return F.xxhash64("text").alias("digest")


def kept_suffixes(docs: DataFrame, width: int, head: int) -> DataFrame:
    """(doc_id, digest, suffixes): per document the kept places and the hashes of their heads."""

    kind = pa.list_(pa.struct([("at", pa.int32()), ("head", pa.int64())]))

    @F.arrow_udf("array<struct<at:int,head:bigint>>")
    def cut(texts: pa.Array) -> pa.Array:
        parts = []
        for start in range(0, len(texts), 256):
            words, begin, end = hashed_texts(as_bytes(texts.slice(start, 256)))
            # a text's last word begins no pair of its own
            at = minima_within(gram_hashes(words, 2), width, begin, np.maximum(end - 1, begin))
            document = np.searchsorted(end, at, side="right")
            whole = at + head <= end[document]
            at, document = at[whole], document[whole]
            rows = pa.StructArray.from_arrays(
                [pa.array(at - begin[document], pa.int32()), pa.array(gram_hashes(words, head)[at].view(np.int64))], ["at", "head"]
            )
            ends = np.cumsum(np.bincount(document, minlength=len(end)))
            parts.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), rows))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return docs.select("doc_id", _digest(), cut("text").alias("suffixes")).where(F.size("suffixes") > 0)


def repeated_suffixes(kept: DataFrame) -> DataFrame:
    """(doc_id, digest, at, head) of the suffixes whose head occurs at another place."""
    rows = kept.select(*_OWN, F.explode("suffixes").alias("s")).select(*_OWN, "s.*")
    # Two places, not two rows: a repeated row of the input is the same place.
    place = F.xxhash64(*_OWN, "at")
    heads = rows.groupBy("head").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("head")
    # Written first: then Spark can split a head that very many suffixes have.
    return rows.join(stored(heads, "repeated-heads"), "head", "left_semi").select(*_OWN, "at", "head")


def runs(repeated: DataFrame, head: int) -> DataFrame:
    """``repeated`` with ``run``, numbered within the document: places whose matches touch."""
    in_order = Window.partitionBy(*_OWN).orderBy("at")
    opens = F.coalesce((F.col("at") - F.lag("at").over(in_order) > head).cast("int"), F.lit(1))
    return repeated.withColumn("opens", opens).withColumn(
        "run", F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )


def with_surroundings(docs: DataFrame, places: DataFrame, runs_: DataFrame, width: int, head: int) -> DataFrame:
    """(doc_id, digest, at, head, room, before, after, words) of ``places`` (doc_id, digest, at, first, last) and ``runs_`` (doc_id, digest, first, last).

    ``room`` words follow the head. ``before`` (nearest word first) is there for ``first`` places, ``after`` for ``last`` ones. A run has
    only ``at``, ``width`` words before it or where the text begins, and ``words``, the hashes of its words and of ``width`` on either side.
    """
    names = ["at", "head", "room", "before", "after", "words"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def of_some(texts: list[bytes | None], wanted: pa.Array) -> pa.Array:
        words, begin, end = hashed_texts(texts)
        document = np.repeat(np.arange(len(end)), pc.list_value_length(wanted).to_numpy(zero_copy_only=False))
        rows = wanted.flatten()
        at, first, last, up_to = (rows.field(i).to_numpy(zero_copy_only=False) for i in range(4))
        place, run = at + begin[document], up_to > 0
        # Around a text's ends these are words of other texts; ``at`` and ``room`` cut them off.
        none = np.zeros(width, ">u4")
        small = np.concatenate([none, (words >> np.uint64(32)).astype(">u4"), none])
        around = np.lib.stride_tricks.sliding_window_view(small, width)

        def side(places: np.ndarray, chosen: np.ndarray, backwards: bool) -> pa.Array:
            shown = iter([r.tobytes() for r in (around[places[chosen]][:, ::-1] if backwards else around[places[chosen]])])
            return pa.array([next(shown) if c else None for c in chosen.tolist()], pa.binary())

        heads = np.zeros(len(at), np.int64)
        heads[~run] = gram_hashes(words, head)[place[~run]].view(np.int64)
        stops = np.minimum(begin[document] + up_to, end[document])
        shown = [words[a:z].tobytes() if r else None for a, z, r in zip(place.tolist(), stops.tolist(), run.tolist())]
        columns = [
            pa.array(at, pa.int32()),
            pa.array(heads, pa.int64()),
            pa.array(end[document] - place - head, pa.int32()),
            side(place, first, True),
            side(place + width + head, last, False),
            pa.array(shown, pa.binary()),
        ]
        ends = np.cumsum(np.bincount(document, minlength=len(end)))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.StructArray.from_arrays(columns, names))

    @F.arrow_udf("array<struct<at:int,head:bigint,room:int,before:binary,after:binary,words:binary>>")
    def look(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        parts = [of_some(as_bytes(texts.slice(i, 256)), wanted.slice(i, 256)) for i in range(0, len(texts), 256)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.struct(list(zip(names, kinds)))))

    no = F.lit(False)
    whole = runs_.select(*_OWN, F.greatest(F.col("first") - width, F.lit(0)).alias("at"), no.alias("f"), no.alias("l"), (F.col("last") + head + width).alias("up_to"))
    both = places.select(*_OWN, "at", "first", "last", F.lit(0).alias("up_to")).union(whole)
    by_document = both.groupBy(*_OWN).agg(F.sort_array(F.collect_set(F.struct("at", "first", "last", "up_to"))).alias("wanted"))
    by_document = by_document.withColumnsRenamed({"doc_id": "w_id", "digest": "w_digest"})
    texts = docs.select("doc_id", _digest(), "text")
    met = texts.join(by_document, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("digest") == F.col("w_digest")))
    return met.select(*_OWN, F.explode(look("text", "wanted")).alias("s")).select(*_OWN, "s.*")


def _agreeing(width: int):
    @F.arrow_udf("int")
    def agreeing(mine: pa.Array, other: pa.Array) -> pa.Array:
        """How many words agree from the first on."""
        a, b = (np.frombuffer(b"".join(x.to_pylist()), ">u4").reshape(-1, width) for x in (mine, other))
        return pa.array(np.cumprod(a == b, axis=1).sum(axis=1), pa.int32())

    return agreeing


def _beside(by: str, side: list[str], width: int):
    """Rows of a range in order: each pair that stands together with one head and two places, and the range's ``first`` and last row with ``by``."""

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        late, early = rows.slice(1), rows.slice(0, rows.num_rows - 1)
        # Rows of one place stand together in one range; they are no pair.
        one, two = late["doc_id"], early["doc_id"]
        same = pc.or_(pc.fill_null(pc.equal(one, two), False), pc.and_(pc.is_null(one), pc.is_null(two)))
        for c in ("digest", "at"):
            same = pc.and_(same, pc.equal(late[c], early[c]))
        near = pc.and_not(pc.equal(late["head"], early["head"]), same)
        late, early = late.filter(near), early.filter(near)
        words = [np.frombuffer(b"".join(x[by].to_pylist()), ">u4").reshape(-1, width) for x in (late, early)]
        shared = np.cumprod(words[0] == words[1], axis=1).sum(axis=1)
        return shaped(late, early, pa.array(shared, pa.int32()))

    def shaped(one: pa.Table, other: pa.Table | None, shared: pa.Array | None, first: bool | None = None) -> pa.RecordBatch:
        n = one.num_rows
        structs = [pa.StructArray.from_arrays([x[c].combine_chunks() for c in side], side) for x in (one, other or one)]
        columns = {
            "part": one["part"].combine_chunks(),
            "first": pa.array([first] * n, pa.bool_()),
            "head": one["head"].combine_chunks(),
            by: pa.nulls(n, pa.binary()) if first is None else one[by].combine_chunks(),
            "shared": pa.nulls(n, pa.int32()) if shared is None else shared,
            "s": structs[0],
            "o": structs[1],
        }
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if last is None:
                yield shaped(rows.slice(0, 1), None, None, True)
            else:
                rows = pa.concat_tables([last, rows]).combine_chunks()
            yield pairs(rows)
            last = rows.slice(rows.num_rows - 1)
        if last is not None:
            yield shaped(last, None, None, False)

    return run


def neighbour_matches(suffixes: DataFrame, by: str, width: int, head: int) -> DataFrame:
    """(doc_id, digest, at, head, begin, end, other_id): each suffix against its neighbours in the order of (head, ``by``).

    ``by`` is the side on which the match is extended, ``before`` or ``after``.
    """
    order, side = ["head", by, "doc_id", "digest", "at"], ["doc_id", "digest", "at", "room"]
    rows = suffixes.where(F.col(by).isNotNull()).select(*order, "room")
    # So many ranges and tasks as the session has shuffle partitions: like heads pack so well that by their bytes too many rows would make a task.
    n = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    one = ",".join(f"{c}:{rows.schema[c].dataType.simpleString()}" for c in side)
    shape = f"part int, first boolean, head bigint, {by} binary, shared int, s struct<{one}>, o struct<{one}>"
    met = stored(ranged.mapInArrow(_beside(by, side, width), shape), f"neighbours-by-{by}")
    # Two rows per range, however many suffixes there are: a range's first row against the last one of the range before.
    by_range = Window.partitionBy().orderBy("part", F.desc("first"))
    ends = met.where("first IS NOT NULL").select("part", "first", "head", by, "s")
    across = ends.withColumn("e", F.lag(F.struct("head", by, "s")).over(by_range)).where("first AND head = e.head")
    across = across.select("head", _agreeing(width)(by, F.col(f"e.{by}")).alias("shared"), "s", F.col("e.s").alias("o"))
    shared = met.where("first IS NULL").select("head", "shared", "s", "o").unionByName(across)
    # Each pair is compared once, and gives a row to either side.
    sides = F.explode(F.array(F.struct("s", "o"), F.struct(F.col("o").alias("s"), F.col("s").alias("o"))))
    pairs = shared.select("head", "shared", sides.alias("p")).select("head", "shared", "p.s.*", "p.o")
    # Beyond its text's ends a suffix's surroundings are another text's words.
    left = F.least("shared", "at", "o.at") if by == "before" else F.lit(0)
    right = F.least("shared", "room", "o.room") if by == "after" else F.lit(0)
    return pairs.select(
        *_OWN, "at", "head", (F.col("at") - left).alias("begin"), (F.col("at") + head + right).alias("end"), F.col("o.doc_id").alias("other_id")
    )


def span_words(spans: DataFrame, runs_: DataFrame) -> DataFrame:
    """``spans`` with ``content``, a hash of their words, and ``words``, their hashes, from ``runs_`` (doc_id, digest, at, words), which cover them."""
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("content", pa.int64()), ("words", pa.binary())]))

    @F.arrow_udf("array<struct<begin:int,end:int,content:bigint,words:binary>>")
    def cut(wanted: pa.Array, given: pa.Array) -> pa.Array:
        out = []
        for spans_, stretches in zip(wanted.to_pylist(), given.to_pylist()):
            length = max(s["at"] + len(s["words"]) // 8 for s in stretches)
            text = np.zeros(max(length, max(s["end"] for s in spans_)), np.uint64)
            for s in stretches:
                part = np.frombuffer(s["words"], np.uint64)
                text[s["at"] : s["at"] + len(part)] = part
            found = []
            for s in spans_:
                data = text[s["begin"] : s["end"]].tobytes()
                content = xxhash.xxh3_64_intdigest(data)
                found.append({"begin": s["begin"], "end": s["end"], "content": content - (1 << 64) if content >> 63 else content, "words": data})
            out.append(found)
        return pa.array(out, kind)

    own = {"doc_id": "r_id", "digest": "r_digest"}
    given = runs_.groupBy(*_OWN).agg(F.collect_set(F.struct("at", "words")).alias("given")).withColumnsRenamed(own)
    wanted = spans.groupBy(*_OWN).agg(F.collect_list(F.struct("begin", "end")).alias("wanted"))
    met = wanted.join(given, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")))
    return met.select(*_OWN, F.explode(cut("wanted", "given")).alias("s")).select(*_OWN, "s.*", F.xxhash64(*_OWN).alias("document"))


def _windows(words: int, field=None):
    """(document, begin, at, hash): the runs of so many ``words`` of each row (document, begin, words), or those that may be in a filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            for document, begin, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                hashes = gram_hashes(np.frombuffer(data, np.uint64), words)
                at = np.arange(len(hashes)) if field is None else np.flatnonzero(passes(field.value, hashes))
                columns = [pa.array(np.full(len(at), document)), pa.array(np.full(len(at), begin), pa.int32()), pa.array(begin + at, pa.int32()), pa.array(hashes[at].view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["document", "begin", "at", "hash"])

    return run


def only_repeated(spans: DataFrame, runs_: DataFrame, min_words: int) -> DataFrame:
    """``spans`` (doc_id, digest, begin, end, other_ids), those that are not found elsewhere as a whole cut down to runs of ``min_words`` words that are."""
    shape = "document long, begin int, at int, hash long"
    content = stored(span_words(spans, runs_), "span-words")
    place = F.xxhash64("document", "begin")
    whole = content.groupBy("content").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("content")
    lone = stored(content.join(stored(whole, "repeated-spans"), "content", "left_anti"), "lone-spans")
    mine = stored(lone.select("document", "begin", "words").mapInArrow(_windows(min_words), shape), "lone-windows")
    # The filter stands before the exact join by hash.
    shared = spans.sparkSession.sparkContext.broadcast(bloom_filter(mine.select("hash")))
    like = content.select("document", "begin", "words").mapInArrow(_windows(min_words, shared), shape)
    place = F.xxhash64("document", "at")
    again = like.groupBy("hash").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("hash")
    kept = mine.join(stored(again, "repeated-windows"), "hash", "left_semi")
    in_order = Window.partitionBy("document", "begin").orderBy("at")
    opens = F.coalesce((F.col("at") - F.lag("at").over(in_order) > min_words).cast("int"), F.lit(1))
    parts = kept.withColumn("opens", opens).withColumn("part", F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = parts.groupBy("document", "begin", "part").agg(F.min("at").alias("from"), (F.max("at") + min_words).alias("to"))
    rest = lone.select(*_OWN, "document", "begin").distinct().join(parts, ["document", "begin"]).select(*_OWN, "begin", "from", "to")
    untouched = content.join(lone.select("document", "begin").distinct(), ["document", "begin"], "left_anti").distinct()
    pieces = rest.unionByName(untouched.select(*_OWN, "begin", F.col("begin").alias("from"), F.col("end").alias("to"))).withColumnsRenamed(
        {"doc_id": "p_id", "digest": "p_digest", "begin": "p_begin"}
    )
    same = F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("digest") == F.col("p_digest")) & (F.col("begin") == F.col("p_begin"))
    return spans.join(pieces, same).select(*_OWN, F.col("from").alias("begin"), F.col("to").alias("end"), "other_ids")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, width: int = WIDTH) -> DataFrame:
    """(doc_id, digest, begin, end, n_words, other_ids): spans of ``min_words`` or more that occur elsewhere too.

    ``other_ids`` holds the documents next to the span's ends in the order of
    suffixes, not all that share it. Each word of a span lies in a run of ``min_words`` words that
    occurs elsewhere; runs that touch or overlap may be shared with different documents.
    """
    head = min_words - width
    if width < 1 or head <= width:
        raise ValueError("the head must be longer than the distance of kept suffixes")
    docs = with_small_batches(docs)
    docs = docs.select("doc_id", "text")
    kept = stored(kept_suffixes(docs, width, head), "suffixes")
    placed = stored(runs(repeated_suffixes(kept), head), "runs")
    run = placed.groupBy(*_OWN, "run").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    # A run's first suffix may reach further left, its last one further right; each needs all suffixes of its head.
    own = {"doc_id": "r_id", "digest": "r_digest", "run": "r_run"}
    same = F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")) & (F.col("run") == F.col("r_run"))
    in_run = placed.join(run.withColumnsRenamed(own), same).select(
        "head", (F.col("at") == F.col("first")).alias("first"), (F.col("at") == F.col("last")).alias("last")
    )
    heads = in_run.where("first OR last").groupBy("head").agg(F.max("first").alias("first"), F.max("last").alias("last"))
    heads = stored(heads, "end-heads")
    edge = placed.join(heads, "head").select(*_OWN, "at", "first", "last")
    read = stored(with_surroundings(docs, edge, run, width, head), "run-ends")
    around = read.where("words IS NULL")
    none = F.lit(None).cast(docs.schema["doc_id"].dataType)
    found = run.select(*_OWN, F.col("first").alias("begin"), (F.col("last") + head).alias("end"), none.alias("other_id"))
    for by in ("after", "before"):
        found = found.unionByName(neighbour_matches(around, by, width, head).drop("at", "head"))
    up_to = Window.partitionBy(*_OWN).orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*_OWN).orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    opens = (F.col("begin") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int")
    spans = found.withColumn("opens", opens).withColumn("span", F.sum("opens").over(up_to))
    merged = spans.groupBy(*_OWN, "span").agg(
        F.min("begin").alias("begin"), F.max("end").alias("end"), F.sort_array(F.collect_set("other_id")).alias("other_ids")
    )
    merged = merged.where(F.col("end") - F.col("begin") >= min_words).drop("span")
    exact = only_repeated(merged, read.where("words IS NOT NULL").select(*_OWN, "at", "words"), min_words)
    return exact.withColumn("n_words", F.col("end") - F.col("begin")).select(*_OWN, "begin", "end", "other_ids", "n_words")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "begin", "end", "n_words", "other_ids")
