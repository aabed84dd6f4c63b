"""Repeated paragraphs by MinHash banding, exact verification and components.

Two kinds of item are compared. A *paragraph* is a line with a word; from ``SHINGLE`` words on it is
known by the hashes of its word shingles too. A *stretch* is ``STRETCH`` words that begin at a
content-selected place: the rightmost least word-pair hash of some ``WIDTH`` consecutive ones. So equal passages inside
different paragraphs hold the same stretches, and every one of ``MIN_PASSAGE`` words or more holds one.

1. Items equal word for word share a content hash and are one row from then on.
2. Distinct paragraphs get ``BANDS`` band keys of ``ROWS`` MinHash values each. Two with
   Jaccard similarity 0.8 share one with probability 1 - (1 - 0.8**ROWS)**BANDS = 0.998.
3. Paragraphs of one band key meet in one task with their shingle sets, and exact
   Jaccard similarity decides. Of a group's links only a spanning forest is
   returned. A key with over ``BLOCK`` paragraphs is dealt out by pairs of
   blocks, so that each pair still meets in some bounded task.
4. Components of links are classes; a stretch is a class of its own. Of a class
   found more than once, the first occurrence by (doc_id, text digest, place) stays.
5. The stretches at either end of a run of repeated ones are compared with their neighbours in the order of what
   surrounds them, and lengthened as far as the words agree.
6. Occurrences that touch form spans. Those that hold a whole repeated paragraph are reported, and others from ``MIN_PASSAGE`` words on: shorter
   passages hold a stretch by chance only.

Texts are read twice: the second time to get the shingles of paragraphs that share a band key and the surroundings of stretches
at ends, which Bloom filters of fixed size tell from the others before an exact join does.

Cases: null, empty and blank texts have no items. Rows equal in ``doc_id`` and text are
one document. A paragraph repeated within one document counts. A null id is the
earliest. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newslens.llm.common import as_bytes, bloom_filter, gram_hashes, minima_within, mixed, passes, slices, stored, table, word_hashes, with_small_batches
from newslens.llm.components import connected_components
from newslens.llm.suffixes import neighbour_matches

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 6
ROWS = 2
WIDTH = 24
STRETCH = 24
#: A run of so many words has a selected place in its first ``WIDTH``, and a whole stretch from there.
MIN_PASSAGE = WIDTH + STRETCH
BLOCK = 2000
#: The query leaves documents alone that share nothing but shorter lines; well over half share such with another.
QUERY_WORDS = 20
#: of the tables on the way, which are far larger together than what is returned
CODEC = "zstd"
_OWN = ["doc_id", "digest"]


_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Cut:
    """Items of some documents as flat arrays; ``ends`` say where each document's items end."""

    ends: np.ndarray
    document: np.ndarray  # per item
    at: np.ndarray  # place of the first word in the document
    n: np.ndarray
    content: np.ndarray


def _contents(words: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of the words of each stretch; a word counts with its place in it."""
    with np.errstate(over="ignore"):
        place = np.arange(len(words), dtype=np.uint64) - np.repeat(begins, np.diff(begins, append=len(words))).astype(np.uint64)
        sums = np.add.reduceat(mixed(words + (place + np.uint64(1)) * _STEP), begins) if len(begins) else np.empty(0, np.uint64)
        return mixed(sums + lengths.astype(np.uint64)).view(np.int64)


class Texts:
    """Words of some documents, hashed in one go, and what is cut from them."""

    def __init__(self, texts: list[bytes | None]):
        words: list[bytes] = []
        lengths, lines = [], []
        for data in texts:
            before = len(lengths)
            for line in (data or b"").lower().split(b"\n"):
                if found := line.split():
                    words += found
                    lengths.append(len(found))
            lines.append(len(lengths) - before)
        self.words = word_hashes(words)
        self.line_length = np.array(lengths, np.int64)
        self.line_begin = np.cumsum(self.line_length) - self.line_length
        self.line_document = np.repeat(np.arange(len(texts)), lines)
        # where each document's words begin, and end
        size = np.bincount(self.line_document, self.line_length, len(texts)).astype(np.int64)
        self.end = np.cumsum(size)
        self.begin = self.end - size

    def _cut(self, document, begin, length, content) -> Cut:
        ends = np.cumsum(np.bincount(document, minlength=len(self.end)))
        return Cut(ends, document, begin - self.begin[document], length, content)

    def paragraphs(self) -> tuple[Cut, np.ndarray, np.ndarray, np.ndarray]:
        """Lines; which have ``SHINGLE`` words or more, the shingles of those, and where each one's begin."""
        content = _contents(self.words, self.line_begin, self.line_length)
        long = self.line_length >= SHINGLE
        begin, count = self.line_begin[long], self.line_length[long] - SHINGLE + 1
        first = np.cumsum(count) - count
        places = np.arange(count.sum()) + np.repeat(begin - first, count)
        shingles = gram_hashes(self.words, SHINGLE)[places] if len(places) else np.empty(0, np.uint64)
        return self._cut(self.line_document, self.line_begin, self.line_length, content), long, shingles, first

    def stretches(self) -> tuple[Cut, np.ndarray]:
        """Stretches at selected places, and those places among all words."""
        # A text's last word begins no pair of its own.
        at = minima_within(gram_hashes(self.words, 2), WIDTH, self.begin, np.maximum(self.end - 1, self.begin))
        document = np.searchsorted(self.end, at, side="right")
        whole = at + STRETCH <= self.end[document]
        at, document = at[whole], document[whole]
        content = gram_hashes(self.words, STRETCH)[at].view(np.int64)
        return self._cut(document, at, np.full(len(at), STRETCH), content), at

    def around(self, at: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """Short hashes of the ``WIDTH`` words before each place, nearest first, and behind its stretch; beyond a text's ends those of other texts."""
        none = np.zeros(WIDTH, ">u4")
        small = np.concatenate([none, (self.words >> np.uint64(32)).astype(">u4"), none])
        windows = np.lib.stride_tricks.sliding_window_view(small, WIDTH)
        return [w.tobytes() for w in windows[at][:, ::-1]], [w.tobytes() for w in windows[at + WIDTH + STRETCH]]


def band_keys(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of ``BANDS`` keys per paragraph, each from ``ROWS`` least permuted hashes."""
    keys = np.zeros((len(first), BANDS), np.uint64)
    if not len(first):
        return keys
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            key = np.full(len(first), band, np.uint64)
            for row in range(ROWS):
                seed = mixed(np.array([band * ROWS + row + 1], np.uint64))
                key = mixed(key * np.uint64(31) + np.minimum.reduceat(mixed(shingles ^ seed), first))
            keys[:, band] = key
    return keys


def items(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, paragraphs, stretches): places, lengths, contents, and paragraphs' band keys, per document."""
    shape = "array<struct<at:int,n:int,content:bigint,keys:array<bigint>>>"
    item = [("at", pa.int32()), ("n", pa.int32()), ("content", pa.int64())]
    kind = pa.struct([("paragraphs", pa.list_(pa.struct([*item, ("keys", pa.list_(pa.int64()))]))), ("stretches", pa.list_(pa.struct(item)))])

    @F.arrow_udf(f"struct<paragraphs:{shape},stretches:array<struct<at:int,n:int,content:bigint>>>")
    def cut(texts: pa.Array) -> pa.Array:
        parts = []
        for start in range(0, len(texts), 256):
            some = Texts(as_bytes(texts.slice(start, 256)))
            paragraphs, long, shingles, first = some.paragraphs()
            keys = band_keys(shingles, first).view(np.int64).ravel()
            ends = np.concatenate([[0], np.cumsum(long) * BANDS]).astype(np.int32)
            parts.append(pa.StructArray.from_arrays(
                [_listed(paragraphs, [pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))]), _listed(some.stretches()[0])],
                ["paragraphs", "stretches"],
            ))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return docs.select("doc_id", F.xxhash64("text").alias("digest"), cut("text").alias("i")).select(*_OWN, "i.*")


def _listed(cut: Cut, more: list[pa.Array] = ()) -> pa.Array:
    """One list of item structs per document."""
    columns = [pa.array(cut.at, pa.int32()), pa.array(cut.n, pa.int32()), pa.array(cut.content, pa.int64()), *more]
    rows = pa.StructArray.from_arrays(columns, ["at", "n", "content", "keys"][: len(columns)])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], cut.ends]), pa.int32()), rows)


def second_reading(docs: DataFrame, paragraphs: DataFrame, ends: DataFrame) -> DataFrame:
    """(doc_id, digest, shingles, stretches) per document, stored: what may be in ``paragraphs`` and ``ends``, both of a column ``content``.

    ``shingles`` holds (content, shingles) of paragraphs, ``stretches`` (at, head, room, before, after); ``room`` words follow the head.
    """
    shared = docs.sparkSession.sparkContext.broadcast([bloom_filter(x.select("content")) for x in (paragraphs, ends)])
    sets = pa.struct([("content", pa.int64()), ("shingles", pa.binary())])
    around = pa.struct([("at", pa.int32()), ("head", pa.int64()), ("room", pa.int32()), ("before", pa.binary()), ("after", pa.binary())])

    def of_some(texts: list[bytes | None]) -> pa.Array:
        some = Texts(texts)
        found, long, shingles, first = some.paragraphs()
        content, document = found.content[long], found.document[long]
        # Once per document is enough.
        order = np.lexsort((content, document))
        again = np.zeros(len(order), bool)
        again[1:] = (content[order][1:] == content[order][:-1]) & (document[order][1:] == document[order][:-1])
        wanted = np.sort(order[~again][passes(shared.value[0], content[order[~again]])])
        last = np.append(first, len(shingles))
        rows = pa.StructArray.from_arrays(
            [pa.array(content[wanted], pa.int64()), pa.array([np.unique(shingles[last[i] : last[i + 1]]).tobytes() for i in wanted.tolist()], pa.binary())],
            ["content", "shingles"],
        )
        stretches, place = some.stretches()
        near = np.flatnonzero(passes(shared.value[1], stretches.content))
        before, after = some.around(place[near])
        places = pa.StructArray.from_arrays(
            [pa.array(stretches.at[near], pa.int32()), pa.array(stretches.content[near], pa.int64()),
             pa.array(some.end[stretches.document[near]] - place[near] - STRETCH, pa.int32()), pa.array(before, pa.binary()), pa.array(after, pa.binary())],
            ["at", "head", "room", "before", "after"],
        )

        def lists(values: pa.Array, owner: np.ndarray) -> pa.Array:
            ends_ = np.cumsum(np.bincount(owner, minlength=len(texts)))
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends_]), pa.int32()), values)

        return pa.StructArray.from_arrays([lists(rows, document[wanted]), lists(places, stretches.document[near])], ["shingles", "stretches"])

    @F.arrow_udf("struct<shingles:array<struct<content:bigint,shingles:binary>>,stretches:array<struct<at:int,head:bigint,room:int,before:binary,after:binary>>>")
    def look(texts: pa.Array) -> pa.Array:
        parts = [of_some(as_bytes(texts.slice(i, 256))) for i in range(0, len(texts), 256)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("shingles", pa.list_(sets)), ("stretches", pa.list_(around))]))

    read = docs.select("doc_id", F.xxhash64("text").alias("digest"), look("text").alias("r")).select(*_OWN, "r.*")
    return stored(read.where("size(shingles) > 0 OR size(stretches) > 0"), "second-reading", CODEC)


def forest(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """For shingle sets of one group: the index of the first member of each one's component of similar sets."""
    m = len(sets)
    flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    root = np.arange(m)
    for i in range(m):
        if (root == root[0]).all():
            break
        mine = sets[i]
        place = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
        common = np.add.reduceat((mine[place] == flat).astype(np.int64), begins)
        near = common >= similarity * (sizes + len(mine) - common) - 1e-9
        roots = np.unique(root[near])
        if len(roots) > 1:
            root[np.isin(root, roots)] = roots[0]
    return root


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups arrive whole and sorted by (key, cell); the last of a batch may go on in the next."""
    group, names, sets = None, [], []

    def links():
        root = forest(sets)
        own = np.flatnonzero(root != np.arange(len(root)))
        ids = np.array(names, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], names=["u", "v"])

    for batch in batches:
        for key, cell, name, data in zip(*(c.to_pylist() for c in batch.columns)):
            if (key, cell) != group:
                if len(names) > 1:
                    yield links()
                group, names, sets = (key, cell), [], []
            names.append(name)
            sets.append(np.frombuffer(data, np.uint64))
    if len(names) > 1:
        yield links()


def candidates(found: DataFrame) -> DataFrame:
    """(content, key, members), stored: distinct paragraphs by band key, for keys that several share; one key of those with the same paragraphs."""
    rows = found.select(F.explode("paragraphs").alias("p")).select("p.content", "p.keys").where("size(keys) > 0")
    # Two contents, not two rows: equal paragraphs are one.
    by_key = rows.select("content", F.explode("keys").alias("key")).groupBy("key").agg(F.min("content").alias("a"), F.max("content").alias("b"))
    several = stored(by_key.where("a <> b").select("key"), "band-keys", CODEC)
    shared = found.sparkSession.sparkContext.broadcast(bloom_filter(several))

    @F.arrow_udf("array<bigint>")
    def in_filter(keys: pa.Array) -> pa.Array:
        flat, size = keys.flatten(), pa.compute.list_value_length(keys).to_numpy(zero_copy_only=False)
        near = passes(shared.value, flat.to_numpy(zero_copy_only=False))
        ends = np.concatenate([[0], np.cumsum(near)])[np.concatenate([[0], np.cumsum(size)])]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.filter(pa.array(near)))

    # The filter stands before the exact join.
    near = rows.select("content", F.explode(in_filter("keys")).alias("key")).distinct()
    banded = stored(near.join(several, "key", "left_semi"), "bands", CODEC)
    # Keys with the same paragraphs, known by their number and 128 bits, give the same links: the least of them stays.
    crowds = banded.groupBy("key").agg(
        F.count("*").alias("members"), F.bit_xor(F.xxhash64("content", F.lit(0))).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "content")).alias("b")
    )
    crowds = stored(crowds.groupBy("members", "a", "b").agg(F.min("key").alias("key")).select("key", "members"), "crowds", CODEC)
    return stored(banded.join(crowds, "key"), "candidates", CODEC)


def paragraph_links(met: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) between contents that connect all paragraphs at ``SIMILARITY`` or more that share a band key."""
    # A key's members are dealt into blocks, and each pair of blocks is a cell; one block is one cell.
    blocks = F.ceil(F.col("members") / block).cast("int")
    mine = F.pmod(F.xxhash64("content", F.lit("block")), blocks).cast("int")
    cells = F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(F.least(x, mine).alias("a"), F.greatest(x, mine).alias("b")))
    dealt = met.withColumn("cell", F.explode(cells)).select("key", (F.col("cell.a") * 1000003 + F.col("cell.b")).alias("cell"), "content")
    return (
        dealt.join(sets.dropDuplicates(["content"]), "content")
        .select("key", "cell", "content", "shingles")
        .repartition("key", "cell")
        .sortWithinPartitions("key", "cell")
        .mapInArrow(_verified, "u long, v long")
    )


def _found_again(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """``rows`` whose ``by`` occurs at two places or more. Two places, not two rows: a repeated row of the input is the same place."""
    where = F.xxhash64(*_OWN, "at")
    counted = rows.groupBy(*by).agg(F.min(where).alias("a"), F.max(where).alias("b")).where("a <> b").drop("a", "b")
    # What rows meet is written first: then Spark can split a class that very many documents have.
    return rows.join(stored(counted, f"{name}-classes"), by, "left_semi").distinct()


def run_ends(again: DataFrame) -> DataFrame:
    """(content): that of every first and last stretch of a run of repeated ones that touch."""
    in_order = Window.partitionBy(*_OWN).orderBy("at")
    apart = F.coalesce(F.col("at") - F.lag("at").over(in_order) > STRETCH, F.lit(True))
    leaves = F.coalesce(F.lead("at").over(in_order) - F.col("at") > STRETCH, F.lit(True))
    return again.withColumns({"opens": apart, "closes": leaves}).where("opens OR closes").select("content").distinct()


def lengthened(around: DataFrame) -> DataFrame:
    """(doc_id, digest, place, at, n, class): stretches with what they share with their neighbours on either side, one row per place."""
    grown = neighbour_matches(around, "after", WIDTH, STRETCH).unionByName(neighbour_matches(around, "before", WIDTH, STRETCH))
    # What reaches less far on a side lies within what reaches further, and is of the same place and class.
    whole = grown.where(F.col("end") - F.col("begin") > STRETCH).groupBy(*_OWN, "at", "head").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return whole.select(*_OWN, F.col("at").alias("place"), F.col("begin").alias("at"), (F.col("end") - F.col("begin")).alias("n"), F.col("head").alias("class"))


def repeated_paragraphs(docs: DataFrame, min_words: int = 1, min_passage: int = MIN_PASSAGE, block: int = BLOCK) -> DataFrame:
    """(doc_id, digest, begin, end, n_words, n_removed, first_doc_ids) per span of repeated items.

    ``n_removed`` counts the words of later occurrences, those a dedup takes out;
    ``first_doc_ids`` are the documents that hold the first occurrences. Spans have ``min_words`` words or more,
    those without a whole repeated paragraph ``min_passage`` or more.
    """
    docs = with_small_batches(docs)
    docs = docs.select("doc_id", "text")
    found = stored(items(docs), "paragraphs", CODEC)
    s = found.select(*_OWN, F.explode("stretches").alias("i")).select(*_OWN, "i.at", "i.content")
    s = stored(_found_again(s, ["content"], "stretch"), "repeated-stretches", CODEC)
    met, ends = candidates(found), stored(run_ends(s), "run-ends")
    read = second_reading(docs, met.select("content").distinct(), ends)
    sets = read.select(F.explode("shingles").alias("r")).select("r.*").join(met.select("content").distinct(), "content", "left_semi")
    classes = stored(connected_components(paragraph_links(met, sets, block)), "paragraph-classes")
    p = found.select(*_OWN, F.explode("paragraphs").alias("i")).select(*_OWN, "i.at", "i.n", "i.content")
    p = p.join(classes, p.content == classes.node, "left").select(*_OWN, "at", "n", F.coalesce("root", "content").alias("content"))
    p = _found_again(p, ["content"], "paragraph").select(*_OWN, "at", "at", "n", F.lit(0).alias("kind"), "content").toDF(*_OWN, "place", "at", "n", "kind", "class")
    around = read.select(*_OWN, F.explode("stretches").alias("r")).select(*_OWN, "r.*").join(ends.withColumnRenamed("content", "head"), "head", "left_semi")
    # A lengthened stretch is an item beside the plain one, of the same place and class: no join of the many with the few.
    more = lengthened(stored(around, "surroundings", CODEC)).withColumn("kind", F.lit(1))
    s = s.select(*_OWN, F.col("at").alias("place"), "at", F.lit(STRETCH).alias("n"), F.lit(1).alias("kind"), F.col("content").alias("class"))
    # The plain stretches are stored already.
    again = stored(p.unionByName(more), "repeated-items", CODEC).unionByName(s)
    place = F.struct(*_OWN, "place")
    firsts = stored(again.groupBy("kind", "class").agg(F.min(place).alias("first")), "first-items", CODEC)
    marked = again.join(firsts, ["kind", "class"]).withColumn("later", ~place.eqNullSafe(F.col("first")))
    order = Window.partitionBy(*_OWN).orderBy("at", "n", "kind", "place")
    before, up_to = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("at") + F.col("n")
    opens = (F.col("at") > F.coalesce(F.max(end).over(before), F.lit(-1))).cast("int")
    gone_before = F.coalesce(F.max(F.when(F.col("later"), end)).over(before), F.lit(0))
    gone = F.when(F.col("later"), F.greatest(F.lit(0), end - F.greatest("at", gone_before))).otherwise(0)
    spans = marked.withColumns({"opens": opens, "gone": gone, "end": end}).withColumn("span", F.sum("opens").over(up_to))
    merged = spans.groupBy(*_OWN, "span").agg(
        F.min("at").alias("begin"),
        F.max("end").alias("end"),
        F.sum("gone").alias("n_removed"),
        F.min("kind").alias("kind"),
        F.sort_array(F.collect_set("first.doc_id")).alias("first_doc_ids"),
    )
    return (
        merged.withColumn("n_words", F.col("end") - F.col("begin"))
        .where((F.col("n_words") >= min_words) & ((F.col("kind") == 0) | (F.col("n_words") >= min_passage)))
        .select(*_OWN, "begin", "end", "n_words", "n_removed", "first_doc_ids")
    )


def op9_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(table(spark, sf_dir, "documents"), QUERY_WORDS).drop("digest")
