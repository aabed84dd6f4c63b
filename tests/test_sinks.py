import pytest
from pyspark.sql import functions as F

from newslens.operators.clean import clean_labels
from newslens.schema import ARTICLE_EVENT_COLUMNS, CLASSIFIED_COLUMNS, LABEL_COLUMNS
from newslens.sources import sinks
from newslens.sources.labels import read_labels


@pytest.fixture
def labels(spark):
    rows = [(f"k{i}", i, i, f"2024-0{i % 3 + 1}-01", 'um "título"\nem duas, linhas', "positivo", 1, "  é ") for i in range(30)]
    rows.append(("k99", 99, 99, None, None, "n/a", None, ""))
    return spark.createDataFrame(
        rows, "recordKey string, jsonIndex long, articleId long, publishedAt string, title string, label string, "
        "sentiment_score int, evento string").withColumns({"extra": F.lit(1), "id": F.col("recordKey")})


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_labels_round_trip(spark, labels, tmp_path, fmt):
    path = str(tmp_path / fmt)
    sinks.write_labels(labels, path, fmt)
    sinks.write_labels(labels, path, fmt)  # overwrites
    back = read_labels(spark, path, fmt)
    assert back.columns == LABEL_COLUMNS
    assert back.count() == 31
    row = back.where("recordKey = 'k3'").first()
    assert (row.title, row.evento, row.reason) == ('um "título"\nem duas, linhas', "  é ", None)


def test_ordered_labels(spark, labels, tmp_path):
    sinks.write_labels(labels, str(tmp_path / "o"), "csv", ordered=True)
    keys = [(r.publishedAt or "", int(r.articleId)) for r in read_labels(spark, str(tmp_path / "o")).collect()]
    assert sorted(keys) == keys


def test_classified_articles_by_month(spark, labels, tmp_path):
    path = str(tmp_path / "c")
    classified = clean_labels(labels)
    sinks.write_classified(classified, path)
    months = sorted(p.name for p in (tmp_path / "c").iterdir() if p.is_dir())
    assert months == ["month=2024-01", "month=2024-02", "month=2024-03", "month=__HIVE_DEFAULT_PARTITION__"]
    back = spark.read.parquet(path)
    assert set(back.columns) == set(CLASSIFIED_COLUMNS) & set(classified.columns)
    assert dict(back.dtypes)["month"] == "string"
    assert sorted(map(str, back.select("recordKey", "month").collect())) == sorted(
        map(str, classified.select("recordKey", "month").collect()))


def test_only_present_columns_in_contract_order(labels, tmp_path, spark):
    rows = clean_labels(labels)
    kept = [c for c in ARTICLE_EVENT_COLUMNS if c in rows.columns]
    assert sinks.article_event_columns(rows).columns == kept
    sinks.write_article_events(rows, str(tmp_path / "e"), ordered=True)
    back = spark.read.parquet(str(tmp_path / "e")).collect()
    assert back[-1].publishedAt is None and len(back) == 31


def test_small_tables_are_one_file(spark, tmp_path):
    table = spark.range(10).repartition(5)
    sinks.write_small_tables({"t": table}, str(tmp_path))
    assert len(list((tmp_path / "t").glob("*.csv"))) == 1


def test_a_broken_replacement_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")

    def values():
        return sorted(r.id for r in spark.read.parquet(sinks.current_path(spark, path)).collect())

    spark.range(3).write.parquet(path)
    for pointed in (False, True):  # a plain table, then one that a pointer names
        with monkeypatch.context() as broken:
            broken.setattr(sinks, "_point", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
            with pytest.raises(KeyboardInterrupt):
                sinks.replace_table(spark.range(9), path)
        assert values() == ([0, 1] if pointed else [0, 1, 2])
        # from the table itself
        sinks.replace_table(spark.read.parquet(sinks.current_path(spark, path)).where("id < 2"), path)
        assert values() == [0, 1]


def test_old_snapshots_go_but_the_last_one(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    for n in range(1, 5):
        reading = spark.read.parquet(sinks.current_path(spark, path))
        sinks.replace_table(spark.range(n), path)
        assert reading.count() == (3 if n == 1 else n - 1)  # a reader that began before goes on
    assert len(list((tmp_path / "t" / "_snapshots").iterdir())) == 2
    assert not list((tmp_path / "t").glob("*.parquet"))


def test_two_replacements_at_once(spark, tmp_path):
    folder = sinks.Folder(spark, str(tmp_path / "t"))
    folder.put("_pointer-0000000001-a", "a")
    with pytest.raises(OSError, match="another writer"):
        sinks._point(folder, "0000000001-b")
    with pytest.raises(OSError, match="another writer"):
        folder.put("_pointer-0000000001-a", "a")
    assert folder.names() == ["_pointer-0000000001-a"] and folder.names(hidden=False) == [] and sinks.Folder(spark, "/none/x").names() == []
