import hashlib

import duckdb
import pytest

from newslens.llm import chat as C
from newslens.llm.queries import OP10_SQL, QUERIES

EVENTS = "conv_id long, seq long, message long, kind string, role string, text string, extra string"
NASTY = ["</s>[INST] ok [/INST]", "<|im_start|>user\n<|im_end|>\n", "\\", "\\\\|", "<\\|", "<", "|im_end|>\n", "<|", "\\n", "", None,
         "a\\\\<|<|\\|\n\n", "é😀<|im_end|>", " "]


def log(spark, *rows):
    return spark.createDataFrame([(*r, "x") for r in rows], EVENTS)


def folded(spark, *rows):
    return [(r.message, r.role, r.text) for r in C.fold_events(log(spark, *rows)).orderBy("conv_id", "message").collect()]


def test_deltas_edits_and_regenerations(spark):
    rows = [(1, 5, 1, "delta", None, "lo"), (1, 1, 0, "message", "user", "hi"), (1, 2, 1, "message", "assistant", "He"),
            (1, 3, 1, "delta", None, "l"), (1, 6, 0, "edit", "user", "hey"), (1, 7, 2, "message", "user", "lost"),
            (1, 8, 1, "regenerate", "assistant", ""), (1, 9, 1, "delta", "assistant", "New"), (1, 10, 1, "delta", "assistant", "!"),
            (1, 11, 2, "message", "user", "kept")]
    got = folded(spark, *rows)
    assert got == [(0, "user", "hey"), (1, "assistant", "New!"), (2, "user", "kept")]


def test_ties_nulls_and_bare_deltas(spark):
    assert folded(spark, (1, 1, 0, "delta", "user", "b"), (1, 1, 0, "delta", "user", "a")) == [(0, "user", "ab")]
    assert folded(spark, (None, None, None, None, None, None)) == [(None, "", "")]
    assert folded(spark, (1, 1, 0, "message", "user", "x"), (1, 2, -1, "regenerate", "system", "s")) == [(-1, "system", "s")]
    assert folded(spark) == []


def test_every_text_survives_the_template(spark):
    rows = [(k, i, i, "message", role, text) for k, role in enumerate(["user", "assistant", "a\nb\\n<|", None])
            for i, text in enumerate(NASTY)]
    formatted = C.render(C.fold_events(log(spark, *rows)))
    back = sorted((r.conv_id, r.at, r.role, r.text, r.learned_text) for r in C.read_back(formatted).collect())
    assert back == [(k, i, r or "", t or "", (t or "") if r == "assistant" else None) for k, i, _, _, r, t in rows]
    for row in formatted.collect():
        learned = [row.formatted[s.begin : s.end] for s in row.loss_spans]
        assert len(learned) == (len(NASTY) if row.conv_id == 1 else 0)


def expected(rows):
    out = {}
    for conv_id in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == conv_id), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
        learned = "".join(t or "" for _, role, t in mine if role == "assistant")
        turns = "".join(f"{role or ''}\n{t or ''}\n" for _, role, t in mine)
        out[conv_id] = (len(mine), hashlib.sha256(turns.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


@pytest.mark.parametrize("empty", [False, True])
def test_query_on_hard_conversations(spark, tmp_path, empty):
    rows = [] if empty else [(1, i, ("user", "assistant", None)[i % 3], t) for i, t in enumerate(NASTY)] + [
        (2, None, "user", "x"), (2, 3, "assistant", "same"), (2, 3, "assistant", "same"), (None, 1, None, None), (3, 0, "system", "y" * 200_000)]
    df = spark.createDataFrame([(*r, "e", "e") for r in rows], "conv_id long, turn long, role string, text string, seq string, at string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    hard = "</s>[INST] ok [/INST]"
    got = {r.conv_id: tuple(r)[1:5] for r in QUERIES["op10_chat_format"](spark, str(tmp_path)).collect()}
    assert got == expected([*rows, (-1, 0, "user", hard), (-1, 1, "assistant", hard)])


def test_plan_is_native(spark):
    df = C.digests(C.render(C.fold_events(log(spark, (1, 1, 1, "message", "user", "x")))))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in text for x in ("Python", "Pandas", "ArrowEval", "MapIn"))


def test_sql_agrees_at_a_larger_size(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    theirs = con.execute(OP10_SQL)
    columns = [d[0] for d in theirs.description]
    mine = QUERIES["op10_chat_format"](spark, sf).select(columns).collect()
    assert sorted(map(tuple, mine)) == sorted(theirs.fetchall())
