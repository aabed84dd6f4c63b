"""Fill-in-the-middle and byte-level BPE: exact round trips, the usual library, hard rows."""

import pickle
import random
import tracemalloc
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from newslens.llm import bpe as B
from newslens.llm import fim as M
from newslens.llm.common import table
from newslens.llm.queries import QUERIES
from tests.llm import hard

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def digest(data):
    return sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def texts_of_all_kinds(seed, n):
    chooser = random.Random(seed)
    parts = ["a", "Z", "é", "ñ", "中", "文", "😀", " ", "\n", "\t", "'", "'s", "'ll", "'re", "1", "٣", "!", "…", "　", "the", "ing", "\r\n", "\x00", "é"]
    return ["".join(chooser.choice(parts) for _ in range(chooser.randint(0, 30))) for _ in range(n)]


# -- rank index ---------------------------------------------------------------


@pytest.mark.parametrize("bound", [0, 1, 7, 31, 120])
def test_rank_index_gives_every_boundary(bound):
    for text in [*texts_of_all_kinds(1, 60), "a" * 5000 + "中" * 5000 + "é😀" * 3000, "x" * 300, ""]:
        offsets = M.boundaries(text.encode())
        assert offsets.tolist() == [len(text[:i].encode()) for i in range(len(text) + 1)]
        index = M.RankIndex.fit(offsets, bound)
        ranks = np.arange(len(offsets))
        assert index.offset(ranks).tolist() == offsets.tolist()
        assert np.abs(index.residual.astype(int)).max(initial=0) <= bound + 1


def test_segments_are_few_and_as_long_as_can_be():
    offsets = M.boundaries(("a" * 4000 + "中" * 4000 + "a" * 4000).encode())
    index = M.RankIndex.fit(offsets, 8)
    assert 3 <= len(index.first) <= 4
    assert len(M.RankIndex.fit(M.boundaries(b"a" * 10_000)).first) == 1
    # one more boundary would leave every line through the first: checked by all slopes between the points
    steps = np.random.default_rng(2).integers(1, 5, 400).cumsum()
    for at in (0, 57, 200):
        end, slope = M._segment(steps, at, 5)
        run, rise = np.arange(1, len(steps) - at), steps[at + 1 :] - steps[at]
        assert (np.abs(rise[: end - at - 1] - slope * run[: end - at - 1]) <= 5 + 1e-9).all()
        if end < len(steps):
            lows, highs = (rise - 5) / run, (rise + 5) / run
            assert lows[: end - at].max() > highs[: end - at].min()


def brute_cut(doc_id, text):
    text = text or ""
    h = [int(digest(f"1:{'' if doc_id is None else doc_id}")[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, digest(text), digest(text)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return n, form, len(prefix), len(middle), digest(out), digest(text)


def test_cuts_equal_brute_force_and_restore_the_text(spark, tmp_path):
    tricky = ["<P", "<", "<S", "<<<", "a<P>b", "<M>", "S>", "P><S", "<S><P", "M>x<"]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts_of_all_kinds(3, 300) + tricky * 30 + [chr(0x1F600) * 70_000])] + hard.ROWS
    sf = hard.folder(spark, tmp_path, documents=hard.documents(spark, rows))
    got = QUERIES["op12_fill_in_middle"](spark, sf)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr((i, *brute_cut(i, t))) for i, t, *_ in rows)
    parts = M.fill_in_middle(hard.documents(spark, rows)).where("form <> 'plain'")
    assert parts.where(M.restored(F.col("output"), F.col("form")) != F.concat("prefix", "middle", "suffix")).count() == 0
    assert {r.form for r in parts.select("form").distinct().collect()} == {"psm", "spm"}
    empty = hard.folder(spark, tmp_path / "empty", documents=hard.documents(spark, []))
    assert QUERIES["op12_fill_in_middle"](spark, empty).count() == 0


# -- byte-level BPE -----------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return B.Vocabulary.read(RANKS)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("usual", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def replay(words, vocabulary):
    flat, size = B.replayed(words, vocabulary)
    return [x.tolist() for x in np.split(flat, np.cumsum(size)[:-1])]


def test_splits_follow_the_pattern():
    assert B.PATTERN == public_tokenizers.PATTERN
    pattern = regex.compile(B.PATTERN)
    for text in [*texts_of_all_kinds(4, 4000), "'s", "x's 's''s", "'", " '", "''ll", "'lla", "'r", "a\n\n b", "  ", "\n x"]:
        assert [w.decode() for w in B.words_of(text.encode())] == pattern.findall(text), text


def test_kinds_of_code_points_are_the_library_s(library):
    """Every code point between letters, digits and spaces, where a wrong kind would split words elsewhere."""
    some = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x1E000, 0x1F700)]
    text = "".join(f"a{c}b 1{c}2 {c}" for c in some)
    vocabulary = B.Vocabulary.read(RANKS)
    words = B.words_of(text.encode())
    ids = dict(zip(set(words), replay(list(set(words)), vocabulary)))
    assert [i for w in words for i in ids[w]] == library.encode_ordinary(text)


def test_replay_equals_the_library(vocabulary, library):
    words = [w for t in texts_of_all_kinds(5, 2000) for w in B.words_of(t.encode())] + [b"a" * 20_000, b" " * 9_000, b"the" * 5000, b"ab" * 7001, b""]
    words = sorted(set(words))
    for word, ids in zip(words, replay(words, vocabulary)):
        assert ids == library.encode_ordinary(word.decode()) or B.words_of(word) != [word]


@pytest.mark.parametrize("seed", range(6))
def test_replay_of_ranks_in_any_order(seed):
    """Ranks that no training would give: a merge may make a pair that comes before it."""
    chooser = random.Random(seed)
    tokens = {bytes([b]) for b in range(256)}
    while len(tokens) < 300:
        a, b = chooser.choice([t for t in tokens if t in (b"a", b"b", b"c") or len(t) > 1]), chooser.choice([b"a", b"b", b"c"])
        tokens.add(a + b if chooser.random() < 0.5 else b + a)
    order = sorted(t for t in tokens if len(t) > 1)
    chooser.shuffle(order)
    ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(order)}
    usual = tiktoken.Encoding("odd", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    words = ["".join(chooser.choice("abc") for _ in range(chooser.randint(1, 60))) for _ in range(400)]
    words += ["abc" * 40, "aab" * 50, "a" * 100]
    got = replay([w.encode() for w in words], B.Vocabulary(ranks))
    assert [x if w.encode() not in ranks else [ranks[w.encode()]] for w, x in zip(words, B.place_by_place([w.encode() for w in words], B.Vocabulary(ranks)))] == got
    assert got == [usual.encode_ordinary(w) for w in words]


def expected_tokens(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), digest(" ".join(map(str, ids))), digest(text or "")


def test_query_equals_the_library(spark, library):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_byte_bpe"](spark, hard.SF).collect()}
    docs = table(spark, hard.SF, "documents").collect()
    assert got == {r.doc_id: expected_tokens(library, r.text) for r in docs} and len(got) == len(docs) > 100


@pytest.mark.parametrize("shared, replayed, kept", [(0, 1, 0), (3, 200, 5), (1000, 1 << 20, 1000)])
def test_sharing_changes_nothing(spark, monkeypatch, library, shared, replayed, kept):
    monkeypatch.setattr(B, "KEPT", kept)
    rows = [(i, t, "en", "a") for i, t in enumerate(texts_of_all_kinds(6, 200))] + hard.ROWS
    encoded = B.encode(hard.documents(spark, rows), RANKS, shared, replayed)
    back = encoded.withColumn("data", B.decoder(spark, RANKS)("ids")).collect()
    assert sorted((repr(r.doc_id), r.ids, bytes(r.data)) for r in back) == sorted(
        (repr(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows
    )


def test_tasks_hold_little(vocabulary, library):
    """A task gets the pairs ready and builds no table of its own for them; the kinds of code points are found some at a time."""
    sent = pickle.loads(pickle.dumps(B.Vocabulary(vocabulary.ranks).for_tasks()))
    words = [b" unseen", b"wordsthat", b" areno", b"tokenshere"]
    assert replay(words, sent) == [library.encode_ordinary(w.decode()) for w in words]
    assert "merges" not in vars(sent)
    tracemalloc.start()
    try:
        kinds = B.kinds.__wrapped__()
        assert (kinds == B.kinds()).all() and tracemalloc.get_traced_memory()[1] < 8 << 20
    finally:
        tracemalloc.stop()


def test_tokens_of_an_empty_table(spark, tmp_path):
    sf = hard.folder(spark, tmp_path, documents=hard.documents(spark, []))
    assert QUERIES["op13_byte_bpe"](spark, sf).count() == 0
