"""What one task holds must not grow with the tables."""

from pyspark.sql import functions as F

from checks import catalog
from newslens.operators.resume import upsert_labels
from newslens.schema import LABEL_COLUMNS
from newslens.sources import sinks
from newslens.sources.labels import read_existing, read_labels

SF = "/root/testdata/sf0.001"


def test_label_rows_are_sorted_in_tasks_smaller_than_the_scan(spark):
    rows = catalog._labels(spark, SF).select("articleId", F.spark_partition_id().alias("task"))
    per_task = rows.groupBy("task").agg(F.count("*").alias("n"), F.countDistinct("articleId").alias("articles")).collect()
    assert len(per_task) > 8 and max(r.n for r in per_task) < 2000
    # the rows of an article stay together, so that a task can cut them to one
    assert sum(r.articles for r in per_task) < rows.select("articleId").distinct().count() + len(per_task)


def test_csv_files_are_bounded_and_keep_their_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "CSV_ROWS", 10, raising=False)
    path = str(tmp_path / "labels")
    rows = spark.range(0, 120, 1, 1).select(
        F.concat(F.lit("k"), F.col("id") % 60).alias("recordKey"), F.concat(F.lit("a\nb"), "id").alias("evento"))
    sinks.write_labels(rows, path, "csv")
    stored = read_labels(spark, path)
    sizes = stored.groupBy(F.col("_metadata.file_name")).count().collect()
    assert [r["count"] for r in sizes] == [10] * 12
    # of two rows of a key, the one in the later file counts
    assert {r.evento for r in read_existing(spark, path).collect()} == {f"a\nb{i}" for i in range(60, 120)}


def test_upsert_moves_only_the_columns_that_are_there(spark):
    old = spark.createDataFrame([("a", "neutro", "x"), ("b", "neutro", "y")], "recordKey string, label string, evento_chave string")
    new = spark.createDataFrame([("b", "positivo", None, 7), ("b", "positivo", "z", 6)], "recordKey string, label string, evento_chave string, jsonIndex long")
    rows = upsert_labels(old, new, old)
    assert rows.columns == LABEL_COLUMNS
    assert {(r.recordKey, r.label, r.evento_chave, r.jsonIndex, r.model) for r in rows.collect()} == {
        ("a", "neutro", "x", None, None), ("b", "positivo", None, 7, None)}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window"):]
    assert "descricao_curta" not in below and "struct(" not in below
