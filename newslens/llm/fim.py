"""Fill-in-the-middle: texts cut in three by a learned rank index.

A text is a row of code points, and boundary ``r`` lies before its ``r``-th one. Its
byte offset is found without walking there: ``RankIndex`` fits straight segments
to all boundaries' offsets, none off by more than ``bound`` bytes, predicts a
boundary's offset from its segment, and adds the residual stored for it, so that the
offset is exact. Where all code points are one byte long one segment is exact.

A segment is the longest run of boundaries that some line through its first one passes
within ``bound``: the slopes that do form a cone, which each further boundary narrows,
and the segment ends before the boundary that would close it.

Where to cut and in which form to write follow from a digest of the id, so a
document comes out alike in every run. Python cuts; digests, forms, output and
its reading back are native. Nothing is shuffled.

Cases: a null or empty text is plain and gives an empty output. A text that holds a
mark is plain, so that marks in an output are always the operator's. A null id
counts as an empty string in the digest. Every row is handled by itself, whatever its
id, and repeated rows come out alike. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from newslens.llm.common import as_bytes, table, with_small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: Of 100 documents so many are cut, and of 100 cut ones so many have their suffix first.
CUT_PERCENT = 90
SPM_PERCENT = 20
#: Greatest distance in bytes of a boundary from its segment.
BOUND = 31


def boundaries(data: bytes) -> np.ndarray:
    """Byte offsets of all code point boundaries, the text's end included."""
    codes = np.frombuffer(data, np.uint8)
    return np.append(np.flatnonzero((codes & 0xC0) != 0x80), len(codes))


@dataclass
class RankIndex:
    """Segments (first rank, its offset, slope), and per rank what its prediction lacks."""

    first: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    @classmethod
    def fit(cls, offsets: np.ndarray, bound: int = BOUND) -> RankIndex:
        if not 0 <= bound <= 120:
            raise ValueError("residuals are stored in a byte")
        n = len(offsets)
        if offsets[-1] - offsets[0] == n - 1:  # one byte each
            return cls(np.array([0]), offsets[:1], np.array([1.0]), np.zeros(n, np.int8))
        first, slopes, at = [], [], 0
        while at < n:
            end, slope = _segment(offsets, at, bound)
            first.append(at)
            slopes.append(slope)
            at = end
        made = cls(np.array(first), offsets[first], np.array(slopes), np.zeros(n, np.int8))
        made.residual = (offsets - made.predicted(np.arange(n))).astype(np.int8)
        return made

    def predicted(self, rank: np.ndarray) -> np.ndarray:
        s = np.searchsorted(self.first, rank, side="right") - 1
        return self.base[s] + np.rint(self.slope[s] * (rank - self.first[s])).astype(np.int64)

    def offset(self, rank: np.ndarray) -> np.ndarray:
        """Exact byte offsets of boundaries."""
        return self.predicted(rank) + self.residual[rank]


def _segment(offsets: np.ndarray, at: int, bound: int) -> tuple[int, float]:
    """End and slope of the longest segment that begins at boundary ``at``."""
    low, high = -np.inf, np.inf
    end, step = at + 1, 64
    while end < len(offsets):
        stop = min(len(offsets), end + step)
        run, rise = np.arange(end - at, stop - at), offsets[end:stop] - offsets[at]
        lows = np.maximum.accumulate(np.maximum((rise - bound) / run, low))
        highs = np.minimum.accumulate(np.minimum((rise + bound) / run, high))
        fits = int(np.argmax(lows > highs)) if lows[-1] > highs[-1] else len(run)
        if fits:
            low, high = lows[fits - 1], highs[fits - 1]
        end += fits
        if fits < len(run):
            break
        step *= 2
    return end, float((low + high) / 2) if end > at + 1 else 0.0


@F.arrow_udf(StructType([StructField(part, StringType()) for part in ("prefix", "middle", "suffix")]))
def _cut(texts: pa.Array, begin: pa.Array, end: pa.Array) -> pa.Array:
    """The parts before, between and after two boundaries; null for a null text."""
    parts: tuple[list, list, list] = ([], [], [])
    ranks = np.column_stack([x.to_numpy(zero_copy_only=False) for x in (begin, end)])
    for start in range(0, len(texts), 256):
        for data, rank in zip(as_bytes(texts.slice(start, 256)), ranks[start : start + 256]):
            if data is None:
                made = (None, None, None)
            else:
                a, b = RankIndex.fit(boundaries(data)).offset(rank)
                made = (data[:a], data[a:b], data[b:])
            for column, part in zip(parts, made):
                column.append(part)
    columns = [pa.array(p, pa.binary()).cast(pa.string()) for p in parts]
    return pa.StructArray.from_arrays(columns, ["prefix", "middle", "suffix"])


def _digits(digest: Column, which: int) -> Column:
    """One of a hex digest's groups of eight digits as a number."""
    return F.conv(F.substring(digest, 8 * which - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = SEED, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, output) per row; the parts are null where ``form`` is plain.

    ``form`` is ``psm`` (prefix, suffix, middle), ``spm`` (suffix first) or ``plain``.
    """
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    docs = with_small_batches(docs).select("doc_id", text.alias("text"), F.char_length(text).cast("long").alias("n"), digest.alias("digest"))
    one, two = (F.pmod(_digits("digest", i), F.col("n") + 1) for i in (1, 2))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.contains("text", F.lit(mark))
    plain = (F.col("n") == 0) | marked | (_digits("digest", 3) % 100 >= cut_percent)
    form = F.when(plain, "plain").when(_digits("digest", 4) % 100 < spm_percent, "spm").otherwise("psm")
    formed = docs.withColumns({"form": form, "begin": F.least(one, two), "end": F.greatest(one, two)})
    cut = formed.withColumn("p", _cut(F.when(F.col("form") != "plain", F.col("text")), "begin", "end")).select(
        "doc_id", "text", "n", "form", "p.prefix", "p.middle", "p.suffix"
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return cut.withColumn("output", output).drop("text")


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of."""
    inner = F.substring(output, len(PREFIX) + 1, 2**31 - 1)
    psm, spm = F.split(inner, f"{SUFFIX}|{MIDDLE}"), F.split(inner, f"{PREFIX}|{MIDDLE}")
    return (
        F.when(form == "psm", F.concat(psm[0], psm[2], psm[1]))
        .when(form == "spm", F.concat(spm[1], spm[2], spm[0]))
        .otherwise(output)
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        F.char_length("prefix").cast("long").alias("prefix_chars"),
        F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP12_SQL = """
WITH numbers AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents
), ranks AS (
  SELECT doc_id, text, n,
         CAST('0x' || substr(digest, 1, 8) AS BIGINT) % (n + 1) AS one,
         CAST('0x' || substr(digest, 9, 8) AS BIGINT) % (n + 1) AS two,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR CAST('0x' || substr(digest, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || substr(digest, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm'
              ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT *, substr(text, 1, least(one, two)) AS prefix,
         substr(text, least(one, two) + 1, greatest(one, two) - least(one, two)) AS middle,
         substr(text, greatest(one, two) + 1) AS suffix
  FROM ranks
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                        ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
