import numpy as np
import pytest
import xxhash

from newslens.llm import simhash as S
from newslens.llm.common import table
from newslens.llm.components import connected_components
from newslens.llm.queries import QUERIES
from tests.llm import hard


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(codes, ids):
    parent = list(range(len(codes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(codes):
        for j in range(i):
            if bin(a ^ codes[j]).count("1") <= 2:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    members = {}
    for i in range(len(codes)):
        members.setdefault(find(i), []).append(ids[i])
    return [min((x for x in members[find(i)] if x is not None), default=None) for i in range(len(codes))]


def check(rows, texts):
    codes = [brute_fingerprint(t) for t in texts]
    assert [f"{c:016x}" for c in codes] == [r[1] for r in rows]
    assert brute_components(codes, [r[0] for r in rows]) == [r[2] for r in rows]


def test_query_equals_brute_force(spark):
    got = sorted(map(tuple, QUERIES["op1_simhash"](spark, hard.SF).collect()))
    texts = {r.doc_id: r.text for r in table(spark, hard.SF, "documents").collect()}
    check(got, [texts[r[0]] for r in got])


def test_hard_rows_and_empty_table(spark, tmp_path):
    sf = hard.folder(spark, tmp_path / "hard")
    got = QUERIES["op1_simhash"](spark, sf).collect()
    assert len(got) == len(hard.ROWS)
    by_code = {}
    for (doc_id, text, *_), code in zip(hard.ROWS, [brute_fingerprint(r[1]) for r in hard.ROWS]):
        by_code.setdefault(code, []).append(doc_id)
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert sorted(str(r.doc_id) for r in zero) == sorted(map(str, by_code[0])) and {r.component_id for r in zero} == {3}
    empty = hard.folder(spark, tmp_path / "empty", documents=hard.documents(spark, []))
    assert QUERIES["op1_simhash"](spark, empty).count() == 0


def clusters(n, seed):
    """Codes around a few centres, so that one node holds very many and links form chains."""
    random = np.random.default_rng(seed)
    centres = random.integers(0, 1 << 63, 3, dtype=np.uint64)
    out = set()
    while len(out) < n:
        code = int(random.choice(centres))
        for b in random.choice(64, random.integers(0, 6), replace=False):
            code ^= 1 << int(b)
        out.add(code)
    return sorted(out)


@pytest.mark.parametrize("leaf_rows", [40, 4096])
def test_crowded_nodes_are_dealt_on_and_lose_no_link(spark, leaf_rows):
    codes = clusters(300, leaf_rows)
    df = spark.createDataFrame([(int(np.uint64(c).astype(np.int64)),) for c in codes], "fp long")
    found = {r.node: r.root for r in connected_components(S.fingerprint_links(df, leaf_rows=leaf_rows)).collect()}
    signed = [int(np.uint64(c).astype(np.int64)) for c in codes]
    expected = brute_components(codes, signed)
    groups = {}
    for code, root in zip(signed, expected):
        groups.setdefault(root, set()).add(code)
    mine = {}
    for code in signed:
        mine.setdefault(found.get(code, code), set()).add(code)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


@pytest.mark.parametrize("max_bits", [0, 1, 2])
def test_tree_search_finds_exactly_the_close_pairs(max_bits):
    codes = np.array(clusters(500, 1), np.uint64)
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    codes = codes[np.argsort(rank)]
    found = {(int(a), int(b)) for who, other in S.close_pairs(codes, max_bits) for a, b in zip(who, other)}
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= max_bits
    assert found == {(i, j) for i in range(len(codes)) for j in range(i) if near[i, j]}
    if max_bits == 2:
        visited = sum(len(level[0]) for level in S._levels(codes))
        assert visited < 1.2 * len(codes)


def test_gray_order_and_masks(spark):
    df = spark.range(16).select(S.gray_rank(S.F.col("id")).alias("r"), "id")
    order = [r.id for r in df.orderBy("r").collect()]
    assert order == [i ^ i >> 1 for i in range(16)]
    parts = S.thirds(0)
    assert parts[0] | parts[1] | parts[2] == (1 << 64) - 1 and sum(bin(p).count("1") for p in parts) == 64
    assert all(bin(m).count("1") - 21 in (14, 15) for m in S.thirds(parts[1]))
    with pytest.raises(ValueError):
        S.fingerprint_links(spark.createDataFrame([], "fp long"), max_bits=3)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9), (7, 9)], [(i, i + 1) for i in range(60)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got.keys() == nodes
    if len(edges) == 60:
        assert set(got.values()) == {0}
    elif len(edges) == 7:
        assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7}


def test_codes_are_dealt_without_a_table_from_the_driver(spark):
    """A table of masks took a second set of Python workers on every executor, which stayed."""
    codes = [0, 5, -1, 1 << 62, -(1 << 63)]
    rows = spark.createDataFrame([(c, 0) for c in codes], "fp long, mask long")
    level = {0: S.thirds(0)}
    for _ in range(2):
        dealt = S._dealt(rows, level)
        assert "Join" not in dealt._jdf.queryExecution().analyzed().toString()
        got = sorted((r.fp, r.mask, r.pattern) for r in dealt.collect())
        wanted = [(r.fp, S._signed(m), r.fp & S._signed(m)) for r in rows.collect() for m in level[r["mask"] % (1 << 64)]]
        assert got == sorted(wanted)
        rows, level = dealt.select("fp", "mask"), {m: S.thirds(m) for following in level.values() for m in following}
