import pytest

from newslens.operators import resume as R

STORED = "recordKey string, id string, label string, evento_chave string, v int"


def test_last_row_per_key_wins(spark):
    rows = [("a", "x", "neutro", "e", 1), ("a", "x", "positivo", "e", 2), ("", "b", "n/a", "", 3),
            (None, "b", "neutro", "e", 4), ("", "", "neutro", "e", 5), (None, None, "neutro", "e", 6)]
    got = R.latest_labels(spark.createDataFrame(rows, STORED), "v").orderBy("recordKey").collect()
    assert [(r.recordKey, r.label, r.v) for r in got] == [("a", "positivo", 2), ("b", "neutro", 4)]


def test_key_falls_back_when_a_column_is_absent(spark):
    df = spark.createDataFrame([("b", 1)], "id string, v int")
    assert R.latest_labels(df, "v").first().recordKey == "b"
    with pytest.raises(ValueError, match="recordKey"):
        R.latest_labels(df.drop("id"), "v")


def test_pending_includes_failed_calls(spark):
    stored = spark.createDataFrame(
        [("done", "", "neutro", "e", 1), ("failed", "", "n/a", "", 1), ("nolabel", "", "", "e", 1),
         ("null", "", None, "e", 1), ("done", "", "neutro", "e", 2)], STORED)
    articles = spark.createDataFrame([(k,) for k in ("done", "failed", "nolabel", "null", "new")], "recordKey string")
    got = sorted(r.recordKey for r in R.pending_articles(articles, stored).collect())
    assert got == ["failed", "new", "nolabel", "null"]


def labels(spark, **rows):
    return spark.createDataFrame(list(rows.items()), "recordKey string, label string")


def pairs(rows):
    return sorted((r.recordKey, r.label) for r in rows.collect())


def test_upsert(spark):
    existing = labels(spark, a="old", b="old", gone="old")
    new = labels(spark, b="new", c="new", stranger="new")
    current = spark.createDataFrame([(k,) for k in "abcd"], "recordKey string")
    once = R.upsert_labels(existing, new, current)
    assert once.columns == R.LABEL_COLUMNS
    assert pairs(once) == [("a", "old"), ("b", "new"), ("c", "new")]
    assert pairs(R.upsert_labels(once, new, current)) == pairs(once)


def test_upsert_into_a_text_store_with_fewer_columns(spark):
    existing = spark.createDataFrame([("a", "old", "")], "recordKey string, label string, sentiment_score string")
    new = spark.createDataFrame([("b", "new", 1, "t", 7)], "recordKey string, label string, sentiment_score int, title string, jsonIndex long")
    got = R.upsert_labels(existing, new, labels(spark, a="", b="").select("recordKey"))
    assert sorted((r.recordKey, r.sentiment_score, r.title, r.jsonIndex) for r in got.collect()) == [
        ("a", None, None, None), ("b", 1, "t", 7)]


def test_two_rows_of_one_key_have_an_order(spark):
    twice = labels(spark, a="y").union(labels(spark, a="x"))
    keys = labels(spark, a="").select("recordKey")
    assert pairs(R.upsert_labels(twice.limit(0), twice, keys)) == [("a", "y")]
    assert pairs(R.upsert_labels(twice, labels(spark, a="new"), keys)) == [("a", "new")]


def test_existing_rows_of_a_file_or_none(spark, tmp_path):
    from newslens.sources.labels import read_existing

    assert read_existing(spark, str(tmp_path / "absent")).count() == 0
    (tmp_path / "labels.csv").write_text('recordKey,label,articleId\na,one,7\nb,two,x\na,"thr\nee",8\n,lost,1\n')
    got = {r.recordKey: (r.label, r.articleId) for r in read_existing(spark, str(tmp_path / "labels.csv")).collect()}
    assert got == {"a": ("thr\nee", 8), "b": ("two", None)}
