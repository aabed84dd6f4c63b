"""Hard negatives against brute force, with many buckets, blocks and slices, and hard rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newslens.llm import negatives as N
from newslens.llm.queries import QUERIES


def brute(rows, positives=N.POSITIVES, negatives=N.NEGATIVES, every=50):
    """All (anchor_id, positive_id, rank, negative_id, positive_score, negative_score), rows as (id, label, vector)."""
    rows = sorted({(i, y, tuple(v)) for i, y, v in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in rows:
        if a[0] is None or a[0] % every:
            continue
        order = lambda r: (-r[0], r[1] is None, r[1] or 0)
        scored = [(dot(a[2], b[2]), b[0], b[1]) for b in rows if b != a]
        for p, pid, _ in sorted((r for r in scored if r[2] == a[1]), key=order)[:positives]:
            hard = sorted((r for r in scored if r[2] != a[1] and 50 * p <= 100 * r[0] <= 95 * p), key=order)[:negatives]
            out += [(a[0], pid, k, nid, p, n) for k, (n, nid, _) in enumerate(hard, 1)]
    return sorted(out, key=repr)


def found(spark, rows, every=50, **options):
    df = spark.createDataFrame(list(rows), "vec_id long, label int, v array<int>").withColumn("score", F.lit("mine"))
    got = N.hard_negatives(df, F.col("vec_id") % every == 0, **options)
    return sorted((tuple(r) for r in got.collect()), key=repr)


def cloud(seed, n, dims=12, labels=3, scale=120):
    random = np.random.default_rng(seed)
    centres = random.normal(0, scale, (labels, dims))
    lengths = random.gamma(2, 0.5, n)
    y = random.integers(labels, size=n)
    v = np.floor((centres[y] * 0.6 + random.normal(0, scale, (n, dims))) * lengths[:, None]).astype(int)
    return [(i, int(y[i]), v[i].tolist()) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"bucket_rows": 20, "anchor_rows": 7, "sample": 10}, {"bucket_rows": 64, "sample": 0}])
def test_equals_brute_force(spark, options):
    rows = cloud(1, 400)
    expected = brute(rows, every=10)
    assert found(spark, rows, 10, **options) == expected and len(expected) > 300


def test_more_blocks_than_buckets(spark, monkeypatch):
    monkeypatch.setattr(N, "MAX_BUCKETS", 2)
    rows = cloud(2, 300, labels=40)
    assert found(spark, rows, 10, bucket_rows=15) == brute(rows, every=10)


def test_groups_of_equal_vectors_and_ties(spark):
    rows = [(i, 0, [8, 8, 0]) for i in range(60)] + [(i, 1, [4, 5, 6]) for i in range(60, 120)]
    rows += [(i, 1, [5, 4, -6]) for i in range(120, 130)] + [(i, 2, [-8, -8, 0]) for i in range(130, 134)] + rows[:3]
    expected = brute(rows)
    assert found(spark, rows) == expected == found(spark, rows, bucket_rows=2, anchor_rows=1)
    assert {r[1] for r in expected if r[0] == 50} == {0, 1, 2, 3, 4}
    assert {r[3] for r in expected if r[0] == 0} == {60, 61, 62}


HARD = [
    (0, 1, [3, 4]), (0, 1, [3, 4]), (0, 2, [3, 4]), (0, 1, [4, 3]), (None, 1, [4, 4]), (None, 2, [2, 3]), (50, 1, []), (100, 1, [0, 0]),
    (150, 2, [1, 1, 1, 1]), (1, 2, [2, 1]), (2, 2, [2, 1]), (3, 1, [-3, -4]), (200, 3, [5]), (250, 4, [-1, -1]), (4, 4, [1, 1]), (5, 4, [1 << 30, 1]),
]


def test_hard_rows(spark):
    excluded = [(6, None, [3, 4]), (7, 1, None), (8, 1, [1, None]), (9, 1, [2**31 - 1] * 3)]
    rows = [(i, y, v + [0] * (4 - len(v))) for i, y, v in HARD]
    assert found(spark, HARD + excluded) == brute(rows) and len(brute(rows)) > 5
    assert found(spark, []) == [] and found(spark, excluded) == [] and found(spark, [(50, 1, [1])]) == []


def test_large_components_are_exact(spark):
    rows = [(i, i % 2, [(1 << 30) + 7 * i, (1 << 29) - 3 * i * i]) for i in range(120)]
    near = [(1000 + i, 0, [(1 << 29) + i, (1 << 28) + 3 * i]) for i in range(40)]
    assert found(spark, rows + near) == brute(rows + near)


def test_candidates_hold_all_rows_above_the_threshold():
    random = np.random.default_rng(3)
    vectors = np.floor(random.normal(0, 60, (500, 8))).astype(np.int64)
    vectors[:5] = 0
    block = N.Block(vectors, np.zeros(500, np.int64), [[i] for i in range(500)])
    pruned = 0
    for anchor in np.floor(random.normal(0, 60, (60, 8))).astype(np.int64):
        scores = vectors @ anchor
        for threshold in (1, int(np.quantile(scores, 0.9)), int(np.quantile(scores, 0.99)), int(scores.max()), int(scores.max()) + 1):
            at = block.candidates(anchor, threshold)
            assert set(np.flatnonzero(scores >= threshold)) <= set(at.tolist())
            pruned += len(vectors) - len(at)
    assert pruned > 30_000


def test_quantised_rows(spark):
    rows = [(7, 9, [0.5, -0.001]), (14, 3, [1.0, None]), (1, 2, [float("nan")]), (2, 2, [float("inf")]), (3, None, [1.0]), (4, 4, None), (5, 1, [-1.0]), (None, 1, [0.25]), (6, 1, [1e30])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = {(r.vec_id, r.label, tuple(r.v)) for r in N.quantised(df).collect()}
    assert got == {(7, 0, (128, -1)), (5, 1, (-256,)), (None, 1, (64,)), (6, 1, (None,))}


def test_query_on_tables_without_anchors(spark, tmp_path):
    for name, rows in {"empty": [], "none": [(1, 1, [0.1]), (2, 1, [0.3])]}.items():
        spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        assert QUERIES["op11_hard_negatives"](spark, f"{tmp_path}/{name}").count() == 0
