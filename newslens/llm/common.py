"""What the operators of this package share: tables, scratch storage, words and columns of bytes.

Rows are never identified by position. Where results must find their rows
again, a row's key is its ``doc_id`` with a 128-bit digest of its text, so
rows equal in both count as one document and get the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.session import shared_path

#: ASCII white space, the separators of words.
SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, whose session now sends few rows at a time to Python: whole texts are large.

    Only Spark's default number of rows, 10,000, is lowered, for the rest of the session; any other number stays.
    """
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", docs.sparkSession.conf
    if conf.get(key) == "10000":
        conf.set(key, "1000")
    return docs


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder and read from there: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_digest(text: Column) -> Column:
    """128 bits of a text, as two longs; null has a digest of its own."""
    return F.struct(
        F.xxhash64(text, F.lit(0)).alias("a"), F.xxhash64(F.lit(1), text, F.length(text)).alias("b")
    )


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a text column."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of few rows, so that long texts do not pile up decoded."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; the same on every machine."""
    one = xxhash.xxh3_64_intdigest
    return np.fromiter(map(one, words), np.uint64, len(words))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of a 64-bit value spread over all bits."""
    with np.errstate(over="ignore"):
        y = x >> np.uint64(33)
        y ^= x
        y *= np.uint64(0xFF51AFD7ED558CCD)
        y ^= y >> np.uint64(33)
        y *= np.uint64(0xC4CEB9FE1A85EC53)
        y ^= y >> np.uint64(33)
    return y


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes; empty where there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # A run's sum of hashes by powers of _MIX is put together from those of its two halves.
    out, width, power = hashes, 1, int(_MIX)
    with np.errstate(over="ignore"):
        for bit in bin(k)[3:]:
            out = out[: len(out) - width] * np.uint64(power) + out[width:]
            width, power = 2 * width, power * power % (1 << 64)
            if bit == "1":
                out = out[:-1] * _MIX + hashes[width : width + len(out) - 1]
                width, power = width + 1, power * int(_MIX) % (1 << 64)
    return mixed(out)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Positions holding the rightmost minimum of some window of ``width`` values.

    Fewer values than ``width`` form one window. The choice depends on a
    window's own values alone, so equal passages choose equal positions.
    """
    if not len(values):
        return np.empty(0, np.int64)
    return np.unique(_rightmost_minima(values, min(width, len(values))))


def _rightmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the rightmost minimum of each window, by window."""
    n = len(values) - width + 1
    # Windows of twice the width from two that touch, and the last ones from two that overlap: the right one's is taken if it is as low.
    low, best, now = values, np.arange(len(values)), 1
    while now < width:
        step = min(now, width - now)
        m = len(low) - step
        take = low[step:] <= low[:m]
        low, best, now = np.where(take, low[step:], low[:m]), np.where(take, best[step:], best[:m]), now + step
    return best[:n]


def hashed_texts(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of several texts in one array, and where each text begins and ends in it."""
    words: list[bytes] = []
    ends = []
    for data in texts:
        words += (data or b"").lower().split()
        ends.append(len(words))
    end = np.array(ends, np.int64)
    return word_hashes(words), np.concatenate([[0], end[:-1]]).astype(np.int64), end


def minima_within(values: np.ndarray, width: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``window_minima`` over the stretches [begin, end) of ``values`` one by one; stretches below ``width`` have none."""
    if len(values) < width:
        return np.empty(0, np.int64)
    best = _rightmost_minima(values, width)
    inside = np.zeros(len(best) + 1, np.int64)
    full = end - begin >= width
    np.add.at(inside, begin[full], 1)
    np.add.at(inside, end[full] - width + 1, -1)
    return np.unique(best[np.cumsum(inside)[:-1] > 0])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first lengthening of it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bits of a Bloom filter sent to all tasks (4 MB), and probes per hash.
FILTER_BITS = 1 << 25
PROBES = 3


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit numbers of each hash, one row per probe."""
    with np.errstate(over="ignore"):
        return np.stack([mixed(hashes.view(np.uint64) + np.uint64(i)) % np.uint64(bits) for i in range(PROBES)])


def bloom_filter(hashes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Bytes of a filter over the only column, a bigint.

    Its size is fixed, whatever the number of rows: more rows let more others pass, so
    it only ever stands before an exact join. Tasks' set bytes are merged by
    Spark, and the driver gets each byte once.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = _probes(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits).ravel()
            np.bitwise_or.at(field, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        used = np.flatnonzero(field)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(field[used].astype(np.int32))], names=["at", "bits"])

    rows = hashes.mapInArrow(mark, "at int, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    field = np.zeros(bits // 8, np.uint8)
    for batch in rows.toArrow().to_batches():
        field[batch.column(0).to_numpy()] = batch.column(1).to_numpy().astype(np.uint8)
    return field


def passes(field: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter."""
    at = _probes(hashes, len(field) * 8)
    return ((field[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)
