"""Toxicity and language-model scoring: held-out accuracy, exact parts, hard rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newslens.llm import lm as L
from newslens.llm import toxicity as T
from newslens.llm.common import table
from newslens.llm.queries import QUERIES
from tests.llm import hard


def test_toxic_documents_are_caught_when_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    english = table(spark, sf, "documents").where("lang = 'en'").select("doc_id", "text")
    got = T.toxicity(english, labels, ["toxic"], limit=1500)
    known = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(1500)
    held = got.join(labels.withColumnRenamed("toxic", "truth").join(known, "doc_id", "left_anti"), "doc_id").toPandas()
    hits = (held.toxic & (held.truth == 1)).sum()
    assert hits / held.toxic.sum() > 0.85 and hits / (held.truth == 1).sum() > 0.85


def test_later_models_use_earlier_categories():
    random = np.random.default_rng(0)
    rows = [np.unique(random.integers(0, 40, 8).astype(np.int32)) for _ in range(600)]
    first = np.array([1 in r for r in rows], int)
    second = np.where(random.random(600) < 0.9, first, 1 - first)
    chain = T.fit_chain(rows, np.column_stack([first, second]), np.arange(600) % 4, buckets=64, least=2)
    assert chain[0].earlier.shape == (0,) and chain[1].earlier.shape == (1,)
    assert chain[1].earlier[0] > 0.1
    p = np.array([T.score(chain, r) for r in rows])
    assert ((p[:, 0] >= chain[0].cut) == first).mean() > 0.99
    assert ((p[:, 1] >= chain[1].cut) == second).mean() > 0.85


def test_scores_feed_probabilities_on():
    random = np.random.default_rng(4)
    chain = [T.Link(random.normal(size=16), random.normal(size=c), float(random.normal())) for c in range(3)]
    found = np.array([1, 5, 9], np.int32)
    p = []
    for link in chain:
        z = sum(link.pieces[i] for i in (1, 5, 9)) + sum(w * q for w, q in zip(link.earlier, p)) + link.constant
        p.append(1 / (1 + np.exp(-z)))
    assert T.score(chain, found) == pytest.approx(p)
    assert T.score(chain, np.empty(0, np.int32))[0] == pytest.approx(1 / (1 + np.exp(-chain[0].constant)))


def test_a_missing_label_is_left_out_of_its_category():
    random = np.random.default_rng(5)
    rows = [np.unique(random.integers(0, 20, 6).astype(np.int32)) for _ in range(200)]
    y = np.column_stack([[1 in r for r in rows], [2 in r for r in rows]]).astype(float)
    missing = y.copy()
    missing[::3, 1] = np.nan
    folds = np.arange(200) % 4
    chain, whole = T.fit_chain(rows, missing, folds, buckets=32, least=1), T.fit_chain(rows, y, folds, buckets=32, least=1)
    assert np.array_equal(chain[0].pieces, whole[0].pieces)
    # as if those documents were not there, but for the first category's probabilities
    kept = ~np.isnan(missing[:, 1])
    alone = T.fit_chain([r for r, k in zip(rows, kept) if k], missing[kept][:, 1:], folds[kept], buckets=32, least=1)
    assert np.abs(chain[1].pieces - alone[0].pieces).max() < 0.3 < chain[1].pieces[2]


def test_one_document_per_labelled_id_reaches_the_driver(spark):
    docs = spark.createDataFrame([(1, f"text {i % 3}") for i in range(500)] + [(2, "b"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (2, None, 0), (3, 0, None)], "doc_id long, a int, b int")
    pieces, y, folds = T.labelled_sample(docs, labels, ["a", "b"])
    assert len(pieces) == len(folds) == 3
    assert np.array_equal(y, [[1, 1], [np.nan, 0], [0, np.nan]], equal_nan=True)


def test_the_fit_is_the_minimum():
    random = np.random.default_rng(1)
    rows = [np.unique(random.integers(0, 6, 3).astype(np.int32)) for _ in range(80)]
    y = (random.random(80) < 0.4).astype(float)
    sets = T.PieceSets(rows, 6, 1)
    x = T._fit(sets, np.zeros((80, 0)), y, np.ones(80, bool))
    dense = np.zeros((80, 6))
    for i, r in enumerate(rows):
        dense[i, r] = 1
    w = np.zeros(7)
    for _ in range(20000):
        p = 1 / (1 + np.exp(-(dense @ w[:6] + w[6])))
        w -= 0.01 * np.concatenate([dense.T @ (p - y) + T.PENALTY * w[:6], [(p - y).sum()]])
    assert np.abs(x - w).max() < 0.05


def test_best_cut():
    z, y = np.array([3.0, 2, 1, 0, -1]), np.array([1, 1, 0, 1, 0])
    cut = T._best_cut(z, y)
    assert [1 / (1 + np.exp(-v)) >= cut for v in z] == [True, True, True, True, False]


def test_toxicity_of_hard_rows(spark, tmp_path):
    for name, tables in {"hard": {}, "empty": {"documents": hard.documents(spark, [])}, "unlabelled": {"labels": hard.labels(spark, [])}}.items():
        sf = hard.folder(spark, tmp_path / name, **tables)
        rows = QUERIES["op2_toxicity"](spark, sf).collect()
        assert len(rows) == (0 if name == "empty" else len(hard.ROWS))
        if name == "unlabelled":
            assert not any(r.toxic for r in rows)


SIZE = 4096


def tiny(seed=2):
    random = np.random.default_rng(seed)
    return {k: v + random.normal(0, 0.3, v.shape).astype(np.float32) for k, v in L.starting_parameters(np.ones(SIZE)).items()}


def test_probabilities_of_all_tokens_sum_to_one():
    p = tiny()
    ids = np.array([5, 70, 4000, 5, 9], np.int32)
    around = np.repeat(L.contexts(ids, np.array([2]), SIZE), SIZE, axis=1)
    logs = L.forward(p, around, np.arange(SIZE, dtype=np.int32))[3]
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


def test_contexts_are_the_words_on_both_sides():
    none = SIZE
    got = L.contexts(np.array([10, 11, 12], np.int32), np.arange(3), none)
    assert got.T.tolist() == [[none, none, 11, 12], [none, 10, 12, none], [10, 11, none, none]]


def test_steps_follow_the_slope():
    p, eps = tiny(), 1e-2
    ids = np.arange(100, 140, dtype=np.int32)
    around = L.contexts(ids, np.arange(40), SIZE)
    trainer = L.Trainer(p)
    for name in trainer.sums:
        trainer.sums[name][:] = 1e12  # so that steps are tiny and show the slope alone
    before = {k: v.astype(np.float64) for k, v in p.items()}
    L.RATE, rate = 1e6 * 1e6, L.RATE
    try:
        trainer.step(around, ids)
    finally:
        L.RATE = rate
    for name, at in (("band", (3, 1)), ("place", (2, 40)), ("bias", (5,)), ("band_bias", (1,)), ("context", (1, 105, 4)), ("place_bias", (1, 40))):
        loss = []
        for sign in (1, -1):
            moved = {k: v.copy() for k, v in p.items()}
            moved[name][at] += sign * eps
            loss.append(-L.forward(moved, around, ids)[3].mean(dtype=np.float64))
        slope = (loss[0] - loss[1]) / (2 * eps)
        step = (before[name][at] - trainer.p[name][at]) / 1e6
        assert step == pytest.approx(slope, rel=0.05, abs=2e-4), name


def one(p, ids):
    return L.log_probability(p, ids)


def sentences(spark, n=400):
    sentence = ["the cat sat on the mat and the dog ran to the door", "a bird flew over the old house near the river"]
    docs = spark.createDataFrame([(i, " ".join([sentence[i % 2]] * 20)) for i in range(n)], "doc_id long, text string")
    return sentence, docs


def test_training_helps_and_order_matters(spark):
    sentence, docs = sentences(spark)
    words = L.vocabulary(L.word_counts(docs))
    assert words.numbers[b"the"] == 0 and words.seen[0] == 200 * 20 * 4 + 200 * 20 * 2 and words.seen.sum() == 400 * 20 * 11.5
    numbered = L.numbered_texts(docs, words)
    start = L.starting_parameters(words.seen)
    model = L.trained(numbered, start, 92_000, rounds=1, shard_tokens=46_000)
    ids = L.Numbering(words).read(sentence[0].encode())[0].astype(np.int32)
    mixed = np.random.default_rng(0).permutation(ids)
    scores = [one(start, ids), one(model, mixed), one(model, ids)]
    assert scores[0] < scores[2] - 2 and scores[1] < scores[2] - 2, scores
    # the same from other files and tasks, and better by more rounds over the same rows
    again = L.trained(L.numbered_texts(docs.repartition(7), words), start, 92_000, rounds=1, shard_tokens=46_000)
    assert all(np.array_equal(model[k], again[k]) for k in model)
    more = L.trained(numbered, start, 92_000, rounds=2, shard_tokens=46_000)
    assert one(more, ids) > scores[2]


def test_scores_do_not_hang_on_files(spark, tmp_path):
    docs = table(spark, hard.SF, "documents").select("doc_id", "text").where("doc_id < 120")
    scores = []
    for files in (1, 8):
        docs.repartition(files).write.parquet(f"{tmp_path}/{files}")
        scores.append(sorted(map(str, L.pseudo_likelihood(spark.read.parquet(f"{tmp_path}/{files}")).collect())))
    assert scores[0] == scores[1]


def test_scores_are_sums_over_words_by_brute_force(spark, monkeypatch):
    """Own, shared and rare words: the number's probability times the word's share of it, and all words' add up to one."""
    random = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in random.zipf(1.3, 40) % 400) for _ in range(60)] + ["W1 w1", None, "z" * 90 + " w1", "z" * 90, " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    models = []
    monkeypatch.setattr(L, "trained", lambda *a, real=L.trained: models.append(real(*a)) or models[-1])
    got = {r.doc_id: r for r in L.pseudo_likelihood(docs, rounds=1, known=60).collect()}
    counts = {}
    for text in texts:
        for w in (text or "").lower().encode().split():
            counts[w] = counts.get(w, 0) + 1
    bands = L.bands_for(len(counts))
    own = bands**2 - bands**2 // 4
    ranked = sorted(counts, key=lambda w: (-counts[w], L.word_key(w)))
    number = {w: i if i < own else own + L.signed_hash(w) % (bands**2 - own) for i, w in enumerate(ranked)}
    seen = np.bincount(list(number.values()), [counts[w] for w in number], bands**2)
    for i, text in enumerate(texts):
        words = (text or "").lower().encode().split()
        ids = np.array([number[w] for w in words], np.int32)
        expected = one(models[0], ids) + sum(np.log(counts[w] / seen[number[w]]) for w in words)
        assert got[i].n_tokens == len(words) and got[i].log_likelihood == pytest.approx(expected, abs=1e-4)
    # over all words at one place
    around = np.repeat(L.contexts(np.array([1, 0, 2], np.int32), np.array([1]), bands**2), len(ranked), axis=1)
    logs = L.forward(models[0], around, np.array([number[w] for w in ranked], np.int32))[3]
    share = np.array([counts[w] / seen[number[w]] for w in ranked])
    whole = L.forward(models[0], np.repeat(around[:, :1], bands**2, axis=1), np.arange(bands**2, dtype=np.int32))[3]
    assert (np.exp(logs) * share).sum() == pytest.approx(np.exp(whole)[np.unique(list(number.values()))].sum(), abs=1e-5)
    assert len(ranked) > 60 > own


def test_random_strings_score_below_real_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    random = np.random.default_rng(0)
    junk = " ".join("".join(random.choice(list("bcdfghjklmnpqrstvwxz"), random.integers(3, 9))) for _ in range(300))
    scored = L.pseudo_likelihood(docs.union(spark.createDataFrame([(-1, junk)], docs.schema))).where("n_tokens > 0").toPandas()
    mine = scored[scored.doc_id == -1].mean_log_likelihood.iloc[0]
    assert (scored[scored.doc_id != -1].mean_log_likelihood > mine).mean() > 0.95


def test_training_predicts_every_token():
    texts = [np.array(x, np.int32) for x in ([1, 2, 3, 4, 5], [], list(range(3000)), [2])]
    batches = list(L.examples(texts, SIZE))
    assert np.concatenate([t for _, t in batches]).tolist() == np.concatenate(texts).tolist()
    assert np.array_equal(np.concatenate([a for a, _ in batches], axis=1), np.concatenate([L.contexts(i, np.arange(len(i)), SIZE) for i in texts], axis=1))
    assert all(len(t) == L.BATCH for _, t in batches[:-1])


def test_average_is_weighed_by_tokens():
    import pyarrow as pa

    def row(n, value):
        return pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0]), pa.array([0]), pa.array([n]), pa.array([(np.full(3, value) * n).tobytes()])],
                                          names=["key", "chunk", "shard", "n", "total"])

    (out,) = list(L._summed(iter([row(1.0, 2.0), row(3.0, 6.0)])))
    assert (np.frombuffer(out.column(4)[0].as_py()) / out.column(3)[0].as_py()).tolist() == [5.0] * 3


def test_numbers_grow_with_the_words():
    assert [L.bands_for(n) for n in (0, 100, 90_000, 3_000_000, 10**12)] == [8, 8, 13, 31, 256]


def test_words_seen_often_have_numbers_of_their_own(spark):
    """Also far more of them than ``bands_for`` gives; numbers end where two bytes do."""
    texts = [" ".join(f"w{i}" for i in range(4000)) for _ in range(L.LEAST)] + [f"once{i}" for i in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = L.vocabulary(L.word_counts(docs), known=100)
    own = [words.numbers[b"w%d" % i] for i in range(4000)]
    assert len(set(own)) == 4000 and max(own) < words.others and (words.seen[own] == L.LEAST).all()
    assert words.seen.sum() == 4000 * L.LEAST + 3000 and words.size == 18**3
    assert [L.numbers_for(*n) for n in ((0, 0), (321, 36), (90_000, 3072), (90_000, 3073), (10**12, 10**9))] == [8**2, 8**2, 64**2, 17**3, 40**3]


def test_three_layers_follow_the_slope_and_sum_to_one(monkeypatch):
    random, size = np.random.default_rng(6), 17**3
    seen = random.integers(0, 1000, size)
    p = {k: v + random.normal(0, 0.3, v.shape).astype(np.float32) for k, v in L.starting_parameters(seen).items()}
    assert L.layers_of(size) == (3, 17) and p["spot_bias"].shape == (17**2, 17)
    ids = random.permutation(size)[:40].astype(np.int32)
    around = L.contexts(ids, np.arange(40), size)
    logs = L.forward(p, np.repeat(around[:, 7:8], size, axis=1), np.arange(size, dtype=np.int32))[3]
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)
    plain = {k: v if k.endswith("_bias") else 0 * v for k, v in L.starting_parameters(seen).items()}
    assert L.forward(plain, around, ids)[3] == pytest.approx(np.log((seen[ids] + 1) / (seen.sum() + size)), abs=1e-4)
    trainer, eps = L.Trainer(p), 1e-2
    for name in trainer.sums:
        trainer.sums[name][:] = 1e12  # so that steps show the slope alone
    monkeypatch.setattr(L, "RATE", 1e12)
    before = {k: v.astype(np.float64) for k, v in p.items()}
    trainer.step(around, ids)
    for name, at in (("spot", (3, ids[2] % 17)), ("spot_bias", (ids[4] // 17, ids[4] % 17)), ("place", (2, 5)), ("place_bias", (ids[0] // 289, 4)), ("context", (1, ids[9], 4))):
        loss = []
        for sign in (1, -1):
            moved = {k: v.copy() for k, v in p.items()}
            moved[name][at] += sign * eps
            loss.append(-L.forward(moved, around, ids)[3].mean(dtype=np.float64))
        slope = (loss[0] - loss[1]) / (2 * eps)
        assert (before[name][at] - trainer.p[name][at]) / 1e6 == pytest.approx(slope, rel=0.05, abs=2e-4), name


def test_copies_are_averaged_in_one_or_two_rounds_of_keys(spark, monkeypatch):
    _, docs = sentences(spark)
    words = L.vocabulary(L.word_counts(docs))
    numbered, start = L.numbered_texts(docs, words), L.starting_parameters(words.seen)
    once = L.trained(numbered, start, 92_000, 1, 10_000)
    monkeypatch.setattr(L, "SPREAD", 4)
    twice = L.trained(numbered, start, 92_000, 1, 10_000)
    assert all(np.allclose(once[k], twice[k], atol=1e-6) for k in once) and not np.array_equal(once["band"], start["band"])


def test_pieces_of_a_long_text_score_like_the_whole(monkeypatch):
    p, ids = tiny(), np.random.default_rng(3).integers(0, SIZE, 500).astype(np.int32)
    whole = one(p, ids)
    monkeypatch.setattr(L, "BATCH", 37)
    assert one(p, ids) == pytest.approx(whole, rel=1e-5) and one(p, ids[:0]) == 0


def test_scoring_of_hard_rows(spark, tmp_path):
    sf = hard.folder(spark, tmp_path / "hard")
    rows = QUERIES["op3_lm_scoring"](spark, sf).collect()
    assert len(rows) == len(hard.ROWS)
    for r in rows:
        assert (r.mean_log_likelihood is None) == (r.n_tokens == 0) and r.log_likelihood <= 0
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {0} and max(r.n_tokens for r in rows) == 60_000
    # the model is the same in every run over the same files
    again = QUERIES["op3_lm_scoring"](spark, sf).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    empty = hard.folder(spark, tmp_path / "empty", documents=hard.documents(spark, []))
    assert QUERIES["op3_lm_scoring"](spark, empty).count() == 0
