"""Byte-level BPE: merges replayed over words, not over texts.

A text is cut into words by the tokenizer's pattern, and a word's token ids are the same
wherever it stands. So words are encoded, many at once, and texts are put together from them.

*Replay.* An inverted index leads from the pairs of tokens that the ranks can merge, by their rank and ``TOGETHER``
ranks at a time, to the places in all words where they stand. Merges are applied in the order of their
ranks: they take their places from the index, in each word those of its lowest rank, join the two tokens there, and enter
only the pairs that the joined token forms with its two neighbours. A new pair of a rank below those at work is taken up next. Where a
merge in several places of a word makes such a pair (no trained vocabulary does), that word is replayed place by place.

*Corpus.* Words are counted over the whole corpus. The ``SHARED`` most frequent ones are
replayed once, dealt over tasks, and their ids are sent to all tasks (a fixed number of words of
at most ``SHARED_BYTES`` bytes, so a fixed size). They cover nearly all of a
text; the other words of some megabytes of text are replayed together by the task that reads them,
and kept there for the texts that follow. So no text and no word of a text is ever shuffled; only the
counts are. The result does not depend on which words are shared.

*Pattern.* ``splits`` gives the words of the fixed pattern ``PATTERN`` from the kinds of code points (letter, number,
white space, other) and where they change, without a search at each place.

As in the usual library, a word that is itself in the vocabulary is that token, whatever the merges give.

Cases: a null or empty text has no tokens. Texts and single words may be of any length.
Every row is encoded by itself, whatever its id. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.llm.common import as_bytes, slices, stored, table, with_small_batches

SHARED = 1 << 17
SHARED_BYTES = 32
#: Distinct words a task counts, or keeps encoded beside the shared ones, before it starts anew.
KEPT = 200_000
#: Bytes of text whose words are replayed together.
REPLAYED = 4 << 20
#: Ranks whose places the index holds together.
TOGETHER = 256
NO_PAIR = 1 << 40
OTHER, LETTER, NUMBER, BLANK = range(4)

# The pattern that `splits` follows, and the endings it sets apart after an apostrophe.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


class Vocabulary:
    """Token ids by their bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """A file of lines, each a token in base 64 and its rank."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())})

    @cached_property
    def byte_ids(self) -> list[int]:
        return [self.ranks[bytes([b])] for b in range(256)]

    @cached_property
    def merges(self) -> dict[tuple[int, int], int]:
        """The token that two tokens make, for all pairs that make one."""
        ranks, found = self.ranks, {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[left, right] = rank
        return found

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that make a token, as sorted numbers, and the tokens."""
        left, right = np.array(list(self.merges), np.int64).reshape(-1, 2).T
        key, made = left << 32 | right, np.array(list(self.merges.values()), np.int64)
        order = np.argsort(key)
        return key[order], made[order]

    def for_tasks(self) -> Vocabulary:
        """The same, with its pairs made once, in 16 bytes each: no task builds ``merges`` for them."""
        small = Vocabulary(self.ranks)
        small.pairs = self.pairs
        return small

    def made_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair makes, or ``NO_PAIR``."""
        keys, made = self.pairs
        key = left << 32 | right
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((keys[at] == key) & (left >= 0) & (right >= 0), made[at], NO_PAIR) if len(keys) else np.full(len(left), NO_PAIR)

    @cached_property
    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all tokens in one array, and by id where a token's bytes begin and how many there are."""
        size = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for token, rank in self.ranks.items():
            size[rank] = len(token)
        in_order = sorted(self.ranks, key=self.ranks.__getitem__)
        return np.frombuffer(b"".join(in_order), np.uint8), np.cumsum(size) - size, size


@lru_cache(1)
def kinds() -> np.ndarray:
    """The kind of every code point, as the usual library's own patterns see it: Unicode's tables differ between libraries."""
    found = np.zeros(0x110000, np.uint8)
    for kind, sort in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        # Every byte is a token of its own, and what the pattern does not match gives none.
        matched = tiktoken.Encoding("kinds", pat_str=sort, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        for start in range(0, 0x110000, 0x800):  # some at a time: each byte is a Python object for a moment
            if start != 0xD800:  # the surrogates
                members = bytes(matched.encode_ordinary("".join(map(chr, range(start, start + 0x800))))).decode()
                found[np.frombuffer(members.encode("utf-32-le"), np.uint32)] = kind
    return found


def splits(data: bytes) -> np.ndarray:
    """Byte offsets at which a text's words begin, and its end."""
    if not data:
        return np.zeros(1, np.int64)
    plain = data.isascii()
    codes = np.frombuffer(data, np.uint8) if plain else np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
    kind, n = kinds()[codes], len(codes)
    run = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1])
    end, sort = np.append(run[1:], n), kind[run]
    begins = np.zeros(n + 4, bool)
    before = np.zeros(len(run), np.uint32)  # the code point before a run
    before[1:] = codes[run[1:] - 1]
    glued = before == 32  # a space goes with what follows it
    # A blank run has its last character set apart, unless it ends the text.
    blank = sort == BLANK
    begins[run[blank]] = True
    begins[end[blank & (end < n)] - 1] = True
    begins[run[~blank & ~glued]] = True
    # An apostrophe alone, not after a space, with one of the endings behind it.
    alone = run[(sort == OTHER) & (end - run == 1) & (codes[run] == 39) & ~glued]
    if len(alone):
        ahead = np.append(codes, np.zeros(3, codes.dtype))
        for ending in ENDINGS:
            fits = np.ones(len(alone), bool)
            for i, c in enumerate(ending, 1):
                fits &= ahead[alone + i] == ord(c)
            begins[alone[fits] + 1] = False
            # What is left of the letters, or else the next run, begins here.
            rest = alone[fits] + 1 + len(ending)
            same = rest[rest < n]
            begins[same[kind[same] == LETTER]] = True
    at = np.append(np.flatnonzero(begins[:n]), n)
    if plain:
        return at
    size = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    return np.concatenate([[0], np.cumsum(size)])[at]


def words_of(data: bytes | None) -> list[bytes]:
    data = data or b""
    at = splits(data).tolist()
    return [data[a:b] for a, b in zip(at, at[1:])]


def place_by_place(words: list[bytes], vocabulary: Vocabulary) -> list[list[int]]:
    """Token ids of each word, by one merge after the other."""
    merges, byte_ids = vocabulary.merges.get, vocabulary.byte_ids
    ids: list[int] = []
    first = []
    for word in words:
        first.append(len(ids))
        ids += [byte_ids[b] for b in word]
        ids.append(-1)  # no pair reaches over a word's end
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    index: dict[int, list[int]] = defaultdict(list)
    for i, pair in enumerate(zip(ids, ids[1:])):
        if (rank := merges(pair)) is not None:
            index[rank].append(i)
    waiting = list(index)
    heapq.heapify(waiting)

    def enter(i: int) -> int:
        """The pair at ``i`` into the index; its rank, or a greater one than any if it cannot be merged."""
        rank = merges((ids[i], ids[after[i]]))
        if rank is None:
            return 1 << 62
        if rank not in index:
            heapq.heappush(waiting, rank)
        index[rank].append(i)
        return rank

    while waiting:
        rank = heapq.heappop(waiting)
        places = sorted(index.pop(rank, ()))
        for k, i in enumerate(places):
            j = after[i]
            if ids[i] < 0 or merges((ids[i], ids[j])) != rank:
                continue  # a neighbour took part in another merge since
            ids[i], ids[j] = rank, -2
            after[i] = after[j]
            before[after[j]] = i
            least = enter(i)
            if i and ids[before[i]] >= 0:
                least = min(least, enter(before[i]))
            if least < rank:
                if places[k + 1 :]:
                    index[rank] += places[k + 1 :]
                    heapq.heappush(waiting, rank)
                break
    found = []
    for i in first:
        made = []
        while ids[i] >= 0:
            made.append(ids[i])
            i = after[i]
        found.append(made)
    return found


def gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``begin``, one behind the other."""
    return flat[np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)]


def _in_order(places: np.ndarray) -> np.ndarray:
    """Each once, ascending; faster here than by hashing."""
    places = np.sort(places)
    return places[np.diff(places, prepend=-1) > 0]


def replayed(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words in one array, and their number per word, by all merges in the order of their ranks."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    byte_ids = np.array(vocabulary.byte_ids, np.int64)
    # A word's last place is no token, so that no pair reaches over its end.
    word = np.repeat(np.arange(len(words)), size + 1)
    ids = np.full(len(word), -1, np.int64)
    inside = np.ones(len(word), bool)
    inside[np.cumsum(size + 1) - 1] = False
    ids[inside] = byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    after, before = np.arange(1, len(word) + 1), np.arange(-1, len(word) - 1)
    pair = np.full(len(word), NO_PAIR, np.int64)
    pair[:-1] = vocabulary.made_of(ids[:-1], ids[1:])
    rank_at_work, odd = np.zeros(len(words), np.int64), np.zeros(len(words), bool)
    index: dict[int, list[np.ndarray]] = {}
    waiting: list[int] = []

    def enter(places: np.ndarray) -> None:
        places = places[pair[places] != NO_PAIR]
        group = pair[places] // TOGETHER
        order = np.argsort(group, kind="stable")
        places, group = places[order], group[order]
        cuts = np.flatnonzero(np.diff(group, prepend=-1))
        for g, some in zip(group[cuts].tolist(), np.split(places, cuts[1:])):
            if g not in index:
                index[g] = []
                heapq.heappush(waiting, g)
            index[g].append(some)

    if len(word):
        enter(np.arange(len(word)))
    while waiting:
        group = heapq.heappop(waiting)
        places = _in_order(np.concatenate(index.pop(group)))
        places = places[pair[places] // TOGETHER == group]  # a neighbour may have taken part in another merge since
        if not len(places):
            continue
        # In each word its lowest rank, at all its places; of places that overlap every second one.
        first = np.flatnonzero(np.diff(word[places], prepend=-1))
        least = np.repeat(np.minimum.reduceat(pair[places], first), np.diff(first, append=len(places)))
        lowest = pair[places] == least
        if not lowest.all():
            enter(places[~lowest])
        places = places[lowest]
        follows = np.zeros(len(places), bool)
        follows[1:] = after[places[:-1]] == places[1:]
        number = np.arange(len(places))
        places = places[(number - np.maximum.accumulate(np.where(follows, 0, number))) % 2 == 0]
        rank, right = pair[places], after[places]
        several = np.zeros(len(places), bool)  # a further place of the word follows
        several[:-1] = word[places[:-1]] == word[places[1:]]
        ahead = vocabulary.made_of(rank, ids[after[right]]) < rank
        odd[word[places[several & ahead]]] = True
        ids[places], ids[right], pair[right] = rank, -2, NO_PAIR
        after[places] = after[right]
        before[after[places]] = places
        left = before[places]
        left = left[(left >= 0) & (ids[left] >= 0)]
        touched = _in_order(np.concatenate([places, left]))
        pair[touched] = vocabulary.made_of(ids[touched], ids[after[touched]])
        rank_at_work[word[places]] = rank
        early = touched[pair[touched] < rank_at_work[word[touched]]]
        if len(early):
            odd[np.intersect1d(word[early], word[places[several]])] = True
        enter(touched)
    kept = ids >= 0
    flat, count = ids[kept], np.bincount(word[kept], minlength=len(words))
    exact = {i: np.array([rank], np.int64) for i, w in enumerate(words) if (rank := vocabulary.ranks.get(w)) is not None}
    again = [i for i in np.flatnonzero(odd).tolist() if i not in exact]
    if again:  # seldom, and it takes a table of all merges
        exact |= zip(again, (np.array(x, np.int64) for x in place_by_place([words[i] for i in again], vocabulary)))
    if not exact:
        return flat, count
    # Words that are tokens themselves, and those replayed place by place, stand behind the others until all are gathered.
    begin = np.cumsum(count) - count
    which = np.fromiter(exact, np.int64, len(exact))
    sizes = np.fromiter(map(len, exact.values()), np.int64, len(exact))
    begin[which], count[which] = len(flat) + np.cumsum(sizes) - sizes, sizes
    return gathered(np.concatenate([flat, *exact.values()]), begin, count), count


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all words of all texts of at most ``SHARED_BYTES`` bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        found: Counter = Counter()
        for batch in slices(batches):
            for data in as_bytes(batch.column(0)):
                found.update(w for w in words_of(data) if len(w) <= SHARED_BYTES)
                if len(found) > KEPT:
                    yield out()
                    found = Counter()
        yield out()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Numbers(dict):
    """Words by number; a new one gets the next."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def shared_words(docs: DataFrame, vocabulary, n: int = SHARED) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The ``n`` most frequent words of the corpus, their ids, and how many each has; the driver gets that many short rows."""
    top = stored(word_counts(docs).orderBy(F.desc("n"), "word").limit(n).select("word"), "shared-words")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [w for batch in batches for w in as_bytes(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), _lists(*replayed(words, vocabulary.value))], names=["word", "ids"])

    rows = top.repartition(16, "word").mapInArrow(encode, "word binary, ids array<int>").toArrow()
    ids = rows["ids"].combine_chunks()
    return as_bytes(rows["word"]), ids.flatten().to_numpy(), pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat, pa.int32()))


def by_bytes(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    """The same rows (key, text) in lists of small batches, each of ``limit`` bytes of text or little more."""
    held, size = [], 0
    for batch in slices(batches, 256):
        held.append(batch)
        size += pa.compute.sum(pa.compute.binary_length(batch.column(1))).as_py() or 0
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, path: str, shared: int = SHARED, together: int = REPLAYED) -> DataFrame:
    """(doc_id, ids) per row, by the vocabulary file ``path``, which only the driver reads."""
    docs = with_small_batches(docs)
    context = docs.sparkSession.sparkContext
    vocabulary = context.broadcast(Vocabulary.read(path).for_tasks())
    common = context.broadcast(shared_words(docs, vocabulary, shared))
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, flat, size = common.value
        start = Numbers(zip(words, range(len(words))))
        numbers, known, kept = Numbers(start), (flat, size), 0
        for some in by_bytes(batches, together):
            before = len(numbers)
            texts = [[np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in map(words_of, as_bytes(b.column(1)))] for b in some]
            new = list(islice(numbers, before, None))
            known = tuple(np.concatenate([a, b]) for a, b in zip(known, replayed(new, vocabulary.value)))
            begin = np.cumsum(known[1]) - known[1]
            for batch, found in zip(some, texts):
                word = np.concatenate([np.empty(0, np.int64), *found])
                per_word = known[1][word]
                ends = np.cumsum([0, *map(len, found)])
                per_text = np.diff(np.concatenate([[0], np.cumsum(per_word)])[ends])
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(gathered(known[0], begin[word], per_word), per_text)], names=["doc_id", "ids"])
            kept += sum(map(len, new))
            if len(numbers) > len(start) + KEPT or kept > KEPT * SHARED_BYTES:
                numbers, known, kept = Numbers(start), (flat, size), 0

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decoder(spark: SparkSession, path: str):
    """A function from a column of id arrays to the bytes they stand for."""
    tokens = spark.sparkContext.broadcast(Vocabulary.read(path).tokens)

    def decoded(ids: pa.Array) -> pa.Array:
        data, begin, size = tokens.value
        token = ids.flatten().to_numpy(zero_copy_only=False)
        per_text = pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(size[token])])[np.concatenate([[0], np.cumsum(per_text)])]
        whole = gathered(data, begin[token], size[token])
        made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(whole)])
        return pa.compute.if_else(ids.is_valid(), made.cast(pa.binary()), pa.scalar(None, pa.binary()))

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        parts = [decoded(ids.slice(i, 256)) for i in range(0, len(ids), 256)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    return decode


def _joined(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), " ")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = encode(table(spark, sf_dir, "documents"), path)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(_joined(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2(decoder(spark, path)("ids"), 256).alias("decoded_sha256"),
    )
