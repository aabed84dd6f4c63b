"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order.

A text's fingerprint has bit ``b`` set where over half of its word shingles'
hashes have it. Fingerprints link at ``max_bits`` (here 2) or fewer differing bits,
and a document's class is its component of links.

Equal fingerprints are one row from the start. The index then has two parts:

*Upper nodes, as rows.* The bits are cut in three segments. Two fingerprints
that differ in at most two bits agree in one segment whole, so each
fingerprint is dealt to three nodes, one per segment, whose mask and pattern
all its members share. A node with more than ``leaf_rows`` members is not handled in
one task: its members are dealt on to three nodes that share a third of the
remaining bits too, by the same argument, until nodes are small. After five
levels ten bits are left, so that no data make a node of more than 1,024 then.

*Lower nodes, inside a task.* A node's members arrive sorted by Gray rank, in
which neighbours share most bits. Every ``FANOUT`` neighbours get a parent that
holds the bits they all share, and so on upwards; a child keeps only the
bits its parent does not hold. A search carries the differences counted so far
down the tree and drops a whole group once they exceed ``max_bits``. A node's
links are reduced to one star per component before they leave the task.

The stars' edges meet in ``connected_components``.

Cases: a null, empty or blank text has the fingerprint zero and links like any
other. Fewer words than a shingle: all of them form one. Rows with one id are
separate documents; a null id is never a component's id unless all are null.
Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from newslens.llm.common import as_bytes, stored, table, text_digest, with_small_batches
from newslens.llm.components import connected_components

SHINGLE = 3
MAX_BITS = 2
LEAF_ROWS = 4096
FANOUT = 8
#: Rows of queries that search a node's tree at once; bounds the search's memory.
SEARCH_ROWS = 256


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` space-joined words."""
    if not words:
        return np.empty(0, np.uint64)
    text, one = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([one(text, 42)], np.uint64)
    begins = [0]
    for w in words:
        begins.append(begins[-1] + len(w) + 1)
    hashes = (one(text[a : b - 1], 42) for a, b in zip(begins, begins[size:]))
    return np.fromiter(hashes, np.uint64, len(words) - size + 1)


def majority_bits(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes: bits set in over half of them."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 15):
        part = hashes[start : start + (1 << 15)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * counts > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


@F.arrow_udf(LongType())
def fingerprint(texts: pa.Array) -> pa.Array:
    out = np.zeros(len(texts), np.uint64)
    for start in range(0, len(texts), 512):
        for i, data in enumerate(as_bytes(texts.slice(start, 512)), start):
            out[i] = majority_bits(shingle_hashes((data or b"").lower().split()))
    return pa.array(out.view(np.int64))


def gray_rank(code: Column) -> Column:
    """Place of a 64-bit code in Gray order, shifted so that signed order is rank order."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def thirds(mask: int) -> list[int]:
    """The masks that add to ``mask`` one third each of the bits it lacks, highest bits first."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    cuts = [round(len(free) * i / 3) for i in range(4)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:])]


def _dealt(rows: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """``rows`` (fp, mask) once per mask that follows theirs, with the shared pattern."""
    # At most 3 ** 4 masks, whatever the data. A table of them would be made by Python workers of their own, beside those of the texts.
    after = {mask: F.array(*(F.lit(_signed(m)) for m in following)) for mask, following in masks.items()}
    steps = F.create_map(*(x for mask, following in after.items() for x in (F.lit(_signed(mask)).cast("long"), following.cast("array<bigint>"))))
    dealt = rows.select("fp", F.explode(steps[F.col("mask")]).alias("mask"))
    return dealt.withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))


def _levels(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The tree over codes in Gray order, leaves first: per node the bits it holds and their values."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    masks, values = np.full(len(codes), full), codes
    tree = []
    while len(masks) > 1:
        first = np.arange(0, len(masks), FANOUT)
        same = ~(np.bitwise_or.reduceat(values, first) ^ np.bitwise_and.reduceat(values, first))
        shared = np.bitwise_and.reduceat(masks, first) & same
        upper = values[first] & shared
        parent = np.arange(len(masks)) // FANOUT
        rest = masks & ~shared[parent]  # what the parent does not hold
        tree.append((rest, values & rest))
        masks, values = shared, upper
    tree.append((masks, values & masks))
    return tree


def close_pairs(codes: np.ndarray, max_bits: int = MAX_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (query, other) of distinct codes in Gray order at ``max_bits`` or fewer, by blocks of queries."""
    tree = _levels(codes)
    for start in range(0, len(codes), SEARCH_ROWS):
        queries = np.arange(start, min(start + SEARCH_ROWS, len(codes)))
        who, node, off = queries, np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        for depth in range(len(tree) - 1, -1, -1):
            if depth < len(tree) - 1:
                size = len(tree[depth][0])
                who, off = np.repeat(who, FANOUT), np.repeat(off, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                real = node < size
                who, node, off = who[real], node[real], off[real]
            bits, values = tree[depth]
            off = off + np.bitwise_count((codes[who] & bits[node]) ^ values[node])
            # A pair is met from its later member, so groups wholly behind the query go too.
            keep = (off <= max_bits) & (node * FANOUT**depth < who)
            who, node, off = who[keep], node[keep], off[keep]
        yield who, node


def stars(codes: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """For codes in Gray order: the index of the first member of each one's component of links."""
    root = np.arange(len(codes))
    for a, b in close_pairs(codes, max_bits):
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if not len(a):
                break
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (deeper := root[root] != root).any():
                root[deeper] = root[root[deeper]]
    return root


def _leaf_links(max_bits: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Nodes arrive whole and sorted; the last of a batch may go on in the next."""
        kept = [np.empty(0, np.int64)] * 3

        def links(mask, pattern, fp):
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])) + 1
            begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(mask)]])
            many = np.flatnonzero(ends - begins > 1)
            u, v = [], []
            for i in many.tolist():
                codes = fp[begins[i] : ends[i]]
                root = stars(codes.view(np.uint64), max_bits)
                own = np.flatnonzero(root != np.arange(len(root)))
                u.append(codes[own])
                v.append(codes[root[own]])
            if u:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

        for batch in batches:
            part = [np.concatenate([k, batch.column(i).to_numpy()]) for i, k in enumerate(kept)]
            mask, pattern, _ = part
            if not len(mask):
                continue
            open_ = np.flatnonzero((mask != mask[-1]) | (pattern != pattern[-1]))
            cut = open_[-1] + 1 if len(open_) else 0
            kept = [p[cut:] for p in part]
            if cut and (out := links(*(p[:cut] for p in part))) is not None:
                yield out
        if len(kept[0]) and (out := links(*kept)) is not None:
            yield out

    return link


def fingerprint_links(codes: DataFrame, max_bits: int = MAX_BITS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Edges (u, v) that connect every two distinct codes of column ``fp`` at ``max_bits`` or fewer."""
    if not 0 <= max_bits <= 2:
        raise ValueError("three segments prove at most two differing bits")
    spark = codes.sparkSession
    level = {0: thirds(0)}
    rows = codes.select("fp").withColumn("mask", F.lit(0).cast("long"))
    links = []
    while True:
        dealt = stored(_dealt(rows, level), "nodes")
        nodes = [m for following in level.values() for m in following]
        crowded = stored(dealt.groupBy("mask", "pattern").count().where(F.col("count") > leaf_rows), "crowded")
        any_crowded = not crowded.isEmpty()
        small = dealt.join(crowded, ["mask", "pattern"], "left_anti") if any_crowded else dealt
        links.append(
            small.select("mask", "pattern", "fp")
            .repartition("mask", "pattern")
            .sortWithinPartitions("mask", "pattern", gray_rank(F.col("fp")))
            .mapInArrow(_leaf_links(max_bits), "u long, v long")
        )
        if not any_crowded:
            break
        rows = dealt.join(crowded, ["mask", "pattern"], "left_semi").select("fp", "mask")
        level = {m: thirds(m) for m in nodes}
    found = links[0]
    for more in links[1:]:
        found = found.union(more)
    return found


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(doc_id, digest, fp, component_id, representative) per row of ``docs``.

    A class's representative has its least id and, of the rows with that id, the least text digest.
    """
    docs = with_small_batches(docs)
    printed = stored(
        docs.select("doc_id", text_digest(F.col("text")).alias("digest"), fingerprint("text").alias("fp")), "fingerprints"
    )
    member = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")
    least = stored(printed.groupBy("fp").agg(F.min(member).alias("least")), "distinct-fingerprints")
    classes = connected_components(fingerprint_links(least, max_bits, leaf_rows))
    members = stored(least.join(classes, least.fp == classes.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "members")
    # Written before rows meet it, as in ``connected_components``: a class may be large.
    named = stored(members.groupBy("root").agg(F.min("least").alias("first")), "classes")
    by_code = stored(members.select("fp", "root").join(named, "root").select("fp", "first"), "codes")
    return printed.join(by_code, "fp").select(
        "doc_id", "digest", "fp", F.col("first.doc_id").alias("component_id"), (member == F.col("first")).alias("representative")
    )


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
