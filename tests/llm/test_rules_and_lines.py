"""Quality rules, line dedup, mixing and decontamination against brute force and hard rows."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from newslens.llm import decontaminate as D
from newslens.llm import linededup as L
from newslens.llm import mixing as M
from newslens.llm import quality as Q
from newslens.llm.common import table
from newslens.llm.queries import ORACLES, QUERIES
from tests.llm import hard


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{hard.SF}/{t}.parquet'")
    mine = QUERIES[name](spark, hard.SF)
    theirs = con.execute(ORACLES[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(mine.columns) == sorted(columns)
    assert sorted(map(tuple, mine.select(columns).collect()), key=repr) == sorted(theirs.fetchall(), key=repr)


# --- quality ---------------------------------------------------------------


def brute_base(text):
    words = [w for w in (text or "").encode().split()]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    n = len(words)
    return (n, sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n)


def test_base_counts(spark):
    rows = QUERIES["op8_quality_rules"](spark, hard.SF).collect()
    texts = {r.doc_id: r.text for r in table(spark, hard.SF, "documents").collect()}
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(texts[r.doc_id])
        assert r.kept == (not r.base_failed and r.llr >= Q.THRESHOLD)


def test_score_is_the_mean_log_ratio(spark):
    docs = spark.createDataFrame([(1, "a b c a b"), (2, "x y x"), (3, "a b x"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (4, 1)], "doc_id long, quality int")
    bins = 64
    raw, good = np.zeros(bins), np.zeros(bins)
    grams = {r.doc_id: Q.grams((r.text or "").encode().split(), bins) for r in docs.collect()}
    for doc_id, g in grams.items():
        np.add.at(raw, g, 1)
        np.add.at(good, g, doc_id in (1, 4))
    counts = {r.bin: (r.raw, r.good) for r in Q.gram_counts(docs, Q.trusted_ids(labels), bins).collect()}
    assert counts == {b: (raw[b], good[b]) for b in range(bins) if raw[b]}
    share = (raw + 1) / (raw.sum() + bins)
    ratio = np.log((good + share * bins * 0.1) / (good.sum() + bins * 0.1)) - np.log(share)
    got = {r.doc_id: r.quality_verdict for r in Q.quality_verdicts(docs, labels, buckets=bins).collect()}
    for doc_id, g in grams.items():
        assert got[doc_id].llr == pytest.approx(ratio[g].mean() if len(g) else 0.0, abs=1e-5)
    none = Q.quality_verdicts(docs, labels.limit(0), buckets=bins).collect()
    assert {r.quality_verdict.llr for r in none} == {0.0}


def test_clean_documents_are_kept_and_junk_goes(spark):
    got = QUERIES["op8_quality_rules"](spark, "/root/testdata/sf0.01").join(
        table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("NOT base_failed")
    shares = {r.quality: r.kept for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert shares[1] > 0.99 and shares[0] < 0.05


@pytest.mark.parametrize(("sf", "part"), [("/root/testdata/sf0.001", 2), ("/root/testdata/sf0.01", 2), ("/root/testdata/sf0.01", 4)])
def test_clean_documents_outside_the_trusted_set_are_kept(spark, sf, part):
    """The verdict must not hang on how many documents are trusted, nor on whether a clean one is among them."""
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    held_out = (F.col("quality") == 1) & (F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(part)) > 0)
    got = Q.quality_verdicts(docs, labels.where(~held_out)).select("doc_id", "quality_verdict.*").where("NOT base_failed")
    rows = got.join(labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max(held_out.cast("int")).alias("held")), "doc_id", "left").collect()
    share = lambda some: sum(r.kept for r in some) / len(some)
    assert share([r for r in rows if r.held]) > 0.9
    assert share([r for r in rows if r.quality == 0]) < 0.05
    assert share([r for r in rows if r.quality is None]) > 0.8


def test_cut_between_good_and_bad():
    assert Q.best_cut({10: 3, 40: 1}, {}) == (1, 0.01)
    assert Q.best_cut({10: 3, 40: 1}, {-10: 2, -1: 5}) == (1, 0.005)
    assert Q.best_cut({10: 9, 40: 90}, {0: 50, 20: 1})[1] == 0.0055


def test_repeated_windows_are_told_apart_where_their_hashes_are_equal():
    for text in ("", "a b", "a b c", "a b c d e f g", "a b c a b c", "a a a a", "x a b c y a b c z b c y"):
        words = text.encode().split()
        equal, real = np.zeros(len(words), np.uint64), Q.word_hashes(words)
        assert Q.repeated_words(words, equal) == Q.repeated_words(words, real) == brute_base(text)[4]


def test_only_labelled_documents_are_scored_for_the_cut(spark):
    """The cut is found on labelled documents: reading the others word by word, or any text twice, is work for nothing."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{text} x{i}") for i in range(3000)] + [(5, f"{text} again"), (None, text), (6, None), (7, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("own", F.when(F.expr("doc_id < 40 AND doc_id % 2 = 1"), True))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (None, 1), (2000, None), (9999, 1)], "doc_id long, quality int")
    ratios = Q.log_ratios(Q.gram_counts(docs.drop("own"), Q.trusted_ids(labels), 64), 64)
    scored = Q.labelled_scores(docs, labels, "own", spark.sparkContext.broadcast(ratios), 64)
    got = scored.collect()
    expected = sorted((i, [ratios.score(Q.grams(t.encode().split(), 64), i % 2 == 1, k) for k in range(3)]) for i, t in rows
                      if i is not None and i < 40 and t and t != "short")
    assert sorted((r.doc_id, r.scores) for r in got if r.doc_id < 40) == expected
    assert len(got) < len(expected) + 10
    plan = scored.join(labels, "doc_id").select(F.explode("scores"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan


def test_null_and_repeated_ids_get_their_own_verdicts(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (1, f"{text} more"), (None, text), (None, None), (2, ""), (3, text.replace("w", "v")), (4, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (None, 1), (8, 1), (4, None)], "doc_id long, quality int")
    got = [(r.doc_id, r.text, r.quality_verdict) for r in Q.quality_verdicts(docs, labels).collect()]
    assert Counter((i, t) for i, t, _ in got) == Counter(rows)
    assert all((v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words, v.base_failed) == brute_base(t) for _, t, v in got)
    kept = {(i, t) for i, t, v in got if v.kept}
    assert (1, text) in kept and (3, rows[6][1]) not in kept and all(v.llr == 0 and not v.kept for _, t, v in got if not t)


# --- line dedup ------------------------------------------------------------


def brute_lines(rows):
    """Text left per (doc_id, text)."""
    seen, covered, lines = {}, defaultdict(set), {}
    key = lambda r: (r[0] is not None, r[0] or 0, L_digest(r[1]))
    for doc_id, text in sorted(set(rows), key=key):
        if text is None:
            continue
        lines[doc_id, text] = text.split("\n")
        at = [i for i, x in enumerate(lines[doc_id, text]) if x.strip(" \t\n\x0b\x0c\r")]
        for k in range(len(at) - 2):
            window = tuple(lines[doc_id, text][i] for i in at[k : k + 3])
            if window in seen:
                covered[doc_id, text] |= set(at[k : k + 3])
            seen.setdefault(window, True)
    return {k: "\n".join(x for i, x in enumerate(v) if i not in covered[k]) for k, v in lines.items()}


def L_digest(text):
    return text or ""


def test_repeated_windows_go_and_the_first_stays(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\n\nb\n \nc\ny"), (3, "b\nc\nd\ne"), (4, "p\np\np\np\np"), (5, "a\nb"), (6, None), (7, ""), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = L.dedup_lines(docs).collect()
    left = {(r.doc_id): r.text for r in got}
    assert left == {1: "a\nb\nc\nd", 2: "x\n\n \ny", 3: "e", 4: "p", 5: "a\nb", 6: None, 7: ""}
    assert {r.doc_id: tuple(r.line_dedup) for r in got}[4] == (5, 4)
    expected = brute_lines(rows)
    assert all(r.text == expected[r.doc_id, dict(rows)[r.doc_id]] for r in got if r.text is not None)


def test_line_dedup_of_hard_rows(spark, tmp_path):
    docs = hard.documents(spark)
    got = L.dedup_lines(docs.drop("line_dedup"))
    assert got.columns == [*docs.drop("line_dedup").columns, "line_dedup"]
    rows = got.collect()
    # documents 0 and 1 are copies: the later one loses all its lines; equal rows are one document
    assert sorted((r.line_dedup.n_removed for r in rows if r.doc_id in (0, 1))) == [0, 5]
    assert [r.line_dedup.n_removed for r in rows if r.doc_id == 2 and r.text == hard.PROSE[1]] == [0, 0]
    assert all(r[c] == "mine" for r in rows for c in hard.CLASHES if c != "line_dedup")
    assert L.dedup_lines(hard.documents(spark, [])).count() == 0


# --- mixing ----------------------------------------------------------------


def poured(sizes):
    """Targets by sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        left = total - sum(target.values())
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / w for s in open_}
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_are_poured_up_to_the_caps(spark, seed):
    random = np.random.default_rng(seed)
    sizes = {f"s{i:02d}": int(10 ** random.uniform(0, 5)) for i in range(9)} | {None: 40, "é": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in M.targets(df).collect()}
    expected = poured(sizes)
    assert got == {s: pytest.approx(expected[s], rel=1e-9) for s in sizes}


def test_mix_of_hard_rows(spark, tmp_path):
    got = M.mix(hard.documents(spark), hard.labels(spark)).drop("digest")
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert len(rows) == len(hard.ROWS) and rows == sorted(map(tuple, got.collect()), key=repr)
    by_source = defaultdict(list)
    for doc_id, source, size, source_size, target, taken in rows:
        by_source[source].append((size, taken, target))
        assert taken <= 3 * size and (size == 0 or taken % size == 0)
    for members in by_source.values():
        assert abs(sum(t for _, t, _ in members) - members[0][2]) <= max(s for s, _, _ in members) / 2 + 1e-6
    assert M.mix(hard.documents(spark, []), hard.labels(spark, [])).count() == 0


def test_better_documents_are_drawn_first(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "s") for i in range(4000)] + [(9000 + i, "w " * 10, "t") for i in range(900)],
                                 "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(4000)], "doc_id long, quality int")
    rows = M.mix(docs, labels).where("source = 's'").collect()
    extra = [r.doc_id % 2 for r in rows if r.taken > min(x.taken for x in rows)]
    assert 0.7 < sum(extra) / len(extra) < 0.9  # odds 4 : 1 for equal shares of both


# --- decontamination -------------------------------------------------------


def brute_hits(rows, items, window=10):
    windows, lengths = defaultdict(set), set()
    for item_id, text in items:
        words = D.benchmark_words((text or "").encode())
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[i : i + n])].add(item_id)
            lengths.add(n)
    out = []
    for doc_id, text in rows:
        words, hit, found = D.benchmark_words((text or "").encode()), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(words[i : i + n])]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sf", ["hard", "/root/testdata/sf0.01"])
def test_decontamination_equals_brute_force(spark, tmp_path, sf):
    sf = hard.folder(spark, tmp_path) if sf == "hard" else sf
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    got = sorted(map(tuple, QUERIES["op6_decontamination"](spark, sf).collect()), key=repr)
    expected = brute_hits(docs, items)
    assert got == expected and any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_no_benchmark_or_no_documents(spark, tmp_path):
    none = D.contamination(hard.documents(spark), hard.benchmark(spark, []))
    assert none.count() == len(hard.ROWS) and none.agg(F.sum("n_hit")).first()[0] == 0
    assert D.contamination(hard.documents(spark, []), hard.benchmark(spark)).count() == 0


@pytest.mark.parametrize(("gram", "width"), [(6, 5), (3, 8), (1, 10)])
def test_every_shared_span_keeps_a_common_fingerprint(gram, width):
    random = np.random.default_rng(gram)
    for _ in range(300):
        shared = [b"%d" % x for x in random.integers(0, 4, gram + width - 1)]
        a = [b"%d" % x for x in random.integers(0, 4, random.integers(0, 9))] + shared
        at, hashes = D.fingerprints(a, gram, width)
        mine, all_ = D.fingerprints(shared, gram, width)
        assert set(all_[mine]) <= set(hashes[at])
