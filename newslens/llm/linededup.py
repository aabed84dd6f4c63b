"""Line dedup over overlapping windows of three lines.

Lines without a word take no part. Every three consecutive lines of the others
form a window, known by a 128-bit digest of the lines as they stand. Windows found
more than once in the corpus, in one document or several, keep their first occurrence, by
(doc_id, text digest, place). Every later occurrence covers its three lines, and
covered lines are removed. A removed line always has an equal line at an
earlier place, so the corpus loses no distinct line.

Digests, not lines, are shuffled: partial counts find repeated windows, and only
those meet the occurrences again. A window that a third of all documents hold is
one row on its side of that join, which Spark splits or broadcasts.

Cases: a null text stays null and has no lines; lines without a word stay where
they are. Fewer than three lines have no window. Rows equal in ``doc_id`` and text
are one document: they are not each other's copies and get one result each. A null
id is the earliest. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.llm.common import SPACE, as_bytes, stored, table, text_digest, with_small_batches

LINES = 3


def _worded(data: bytes) -> tuple[list[bytes], list[int]]:
    """All lines, and the indexes of those with a word."""
    lines = data.split(b"\n")
    return lines, [i for i, line in enumerate(lines) if line.strip(SPACE)]


def line_windows(docs: DataFrame, size: int = LINES) -> DataFrame:
    """Rows of (doc_id, digest, at, window): place among the worded lines, and digest of the window."""

    @F.arrow_udf("array<binary>")
    def windows(texts: pa.Array) -> pa.Array:
        offsets, found = [0], []
        for start in range(0, len(texts), 512):
            for data in as_bytes(texts.slice(start, 512)):
                lines, at = _worded(data or b"")
                for i in range(len(at) - size + 1):
                    found.append(xxhash.xxh3_128_digest(b"\n".join(lines[j] for j in at[i : i + size])))
                offsets.append(len(found))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found, pa.binary()))

    return docs.select("doc_id", text_digest(F.col("text")).alias("digest"), F.posexplode(windows("text")).alias("at", "window"))


def covered_places(windows: DataFrame) -> DataFrame:
    """(doc_id, digest, starts): where later occurrences of repeated windows begin, per document that has any."""
    where = F.struct("doc_id", "digest", "at")
    repeated = windows.groupBy("window").agg(F.count("*").alias("times"), F.min(where).alias("first")).where("times > 1")
    # Written first: then Spark can split a window that very many documents hold.
    repeated = stored(repeated.select("window", "first"), "repeated-windows")
    later = windows.join(repeated, "window").where(~where.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set("at")).alias("starts"))


def dedup_lines(docs: DataFrame, size: int = LINES, into: str = "line_dedup") -> DataFrame:
    """``docs`` with the text that is left in ``text``, and a struct column ``into`` (n_lines, n_removed)."""

    docs = with_small_batches(docs)
    @F.arrow_udf("struct<text:string,n_lines:bigint,n_removed:bigint>")
    def remove(texts: pa.Array, starts: pa.Array) -> pa.Array:
        left, n_lines, n_removed = [], [], []
        for data, begins in zip(as_bytes(texts), starts.to_pylist()):
            if data is None:
                left.append(None)
                n_lines.append(0)
                n_removed.append(0)
                continue
            lines, at = _worded(data)
            gone = {at[j] for i in begins or () for j in range(i, i + size)}
            left.append(data if not gone else b"\n".join(x for i, x in enumerate(lines) if i not in gone))
            n_lines.append(len(at))
            n_removed.append(len(gone))
        return pa.StructArray.from_arrays(
            [pa.array(left, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())],
            ["text", "n_lines", "n_removed"],
        )

    places = covered_places(stored(line_windows(docs, size), "line-windows"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (text_digest(F.col("row.text")) == F.col("digest"))
    done = rows.join(places, same, "left").withColumn("left", remove(F.col("row.text"), F.col("starts")))
    kept = [F.col("left.text").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    return done.select(*kept, F.struct("left.n_lines", "left.n_removed").alias(into))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id", "line_dedup.n_lines", "line_dedup.n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )


OP7_SQL = r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
), worded AS (
  SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM line WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')
), windows AS (
  SELECT doc_id, k, line AS a, lead(line, 1) OVER d AS b, lead(line, 2) OVER d AS c
  FROM worded WINDOW d AS (PARTITION BY doc_id ORDER BY k)
), later AS (
  SELECT doc_id, k FROM windows WHERE c IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, k) > 1
), removed AS (
  SELECT DISTINCT doc_id, k + j AS k FROM later, (VALUES (0), (1), (2)) AS t(j)
), marked AS (
  SELECT l.doc_id, l.i, l.line, w.k, r.k AS gone
  FROM line l LEFT JOIN worded w ON l.doc_id = w.doc_id AND l.i = w.i
  LEFT JOIN removed r ON w.doc_id = r.doc_id AND w.k = r.k
), done AS (
  SELECT doc_id, count(k) AS n_lines, count(gone) AS n_removed,
         string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone IS NULL) AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(done.text, '')) AS text_sha256
FROM documents d LEFT JOIN done ON d.doc_id = done.doc_id
"""
