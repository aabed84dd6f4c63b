import json
import re

from pyspark.sql import functions as F

from newslens.operators.classify import classify, phrase_articles
from newslens.operators.responses import label_rows
from newslens.operators.resume import upsert_labels
from newslens.sources.articles import normalize_articles
from newslens.streaming import incremental as I

RAW = "jsonIndex long, articleId long, id string, title string, rawText string"


def answer(prompt):
    if "fails" in prompt:
        raise RuntimeError("refused")
    return json.dumps({"label": "positivo" if len(prompt) % 2 else "negativo", "evento_chave": f"e {len(prompt) % 5}"})


def arrivals(spark, n=60):
    rows = [(i, i, f"d{i}", "nova obra" if i % 4 else "outro", "x" * i) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, RAW)


def run(spark, folder, store, fn=answer):
    stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = I.classify_stream(
        stream, str(store), f"{store}/checkpoint", fn, "m", "nova obra", normalize_articles, wait=lambda a, e: 0.0)
    query.awaitTermination()
    return I.stored_labels(spark, str(store))


def as_set(df):
    return sorted(tuple(str(v) for v in r) for r in df.select(sorted(df.columns)).collect())


def test_three_files_equal_one_batch(spark, tmp_path):
    df = arrivals(spark)
    for part in range(3):
        df.where(F.col("jsonIndex") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = run(spark, tmp_path / "in", tmp_path / "store")
    candidates = phrase_articles(normalize_articles(df), "nova obra")
    new = label_rows(candidates, classify(candidates, answer), "m")
    assert as_set(got) == as_set(upsert_labels(new.limit(0), new, candidates))
    assert got.count() == 45


def test_failures_are_asked_again_and_done_ones_are_not(spark, tmp_path):
    rows = [(1, 1, "a", "nova obra", "fails"), (2, 2, "b", "nova obra", "x")]
    first = spark.createDataFrame(rows, RAW)
    first.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = {r.recordKey: (r.label, r.reason) for r in run(spark, tmp_path / "in", tmp_path / "s").collect()}
    assert got["a"] == ("n/a", "API error: refused") and got["b"][0] != "n/a"
    before = got["b"]

    first.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    later = run(spark, tmp_path / "in", tmp_path / "s", lambda p: '{"label":"neutro","evento_chave":"k"}')
    got = {r.recordKey: (r.label, r.reason) for r in later.collect()}
    assert got == {"a": ("neutro", ""), "b": before}


def test_ids_go_on_over_batches(spark, tmp_path):
    rows = [(1, 1, "x", "nova obra", "a"), (2, 2, "x", "nova obra", "bb"), (3, 3, "y", "nova obra", "c")]
    df = spark.createDataFrame(rows, RAW)
    for i in (1, 2, 2, 3):
        df.where(F.col("jsonIndex") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = run(spark, tmp_path / "in", tmp_path / "store")
    assert sorted((r.recordKey, r.articleId) for r in got.collect()) == [("x", 1), ("x__dup2", 2), ("y", 3)]
    batch = label_rows(normalize_articles(df), classify(normalize_articles(df), answer), "m")
    assert as_set(got) == as_set(upsert_labels(batch.limit(0), batch, batch))


def test_a_failed_call_is_repeated_without_arriving_again(spark, tmp_path):
    first = spark.createDataFrame([(1, 1, "a", "nova obra", "fails")], RAW)
    first.coalesce(1).write.parquet(str(tmp_path / "in"))
    assert run(spark, tmp_path / "in", tmp_path / "s").first().label == "n/a"
    spark.createDataFrame([(2, 2, "b", "nova obra", "x")], RAW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    later = run(spark, tmp_path / "in", tmp_path / "s", lambda p: '{"label":"neutro","evento_chave":"k"}')
    assert sorted((r.recordKey, r.label) for r in later.collect()) == [("a", "neutro"), ("b", "neutro")]


def test_compacting_changes_no_label(spark, tmp_path):
    store = str(tmp_path / "s")
    I.create_store(spark, store)
    df = arrivals(spark, 8).withColumn("rawText", F.when(F.col("jsonIndex") == 3, "fails").otherwise(F.col("rawText")))
    for batch in (0, 1):
        part = normalize_articles(df.where(F.col("jsonIndex") % 2 == batch))
        I.classify_batch(part, batch, store, answer, "m", attempts=1)
    before = as_set(I.stored_labels(spark, store))
    I.compact_store(spark, store)
    assert as_set(I.stored_labels(spark, store)) == before and I.stored_rows(spark, store).count() == 8
    I.classify_batch(normalize_articles(df), 2, store, lambda p: '{"label":"neutro","evento_chave":"k"}', "n")
    assert [(r.recordKey, r.label) for r in I.stored_labels(spark, store).where("model = 'n'").collect()] == [("d3", "neutro")]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    store = str(tmp_path / "s")
    I.create_store(spark, store)
    batch = normalize_articles(arrivals(spark, 8))
    I.classify_batch(batch.unionByName(batch), 0, store, answer, "m")
    once = as_set(I.stored_labels(spark, store))
    I.classify_batch(batch, 0, store, answer, "m")
    assert as_set(I.stored_labels(spark, store)) == once
    assert I.stored_rows(spark, store).count() == 8


def test_an_article_seen_again_is_not_asked(spark, tmp_path):
    store = str(tmp_path / "s")
    I.create_store(spark, store)
    batch = normalize_articles(arrivals(spark, 8))
    I.classify_batch(batch, 0, store, answer, "m")

    def never(prompt):
        raise AssertionError("asked again")

    I.classify_batch(batch, 1, store, never, "m")
    assert I.stored_labels(spark, store).where("label = 'n/a'").count() == 0


def test_shared_folder_comes_from_the_session(spark):
    from newslens.session import shared_path

    base = spark.conf.get("spark.checkpoint.dir")
    a, b = shared_path(spark, "x"), shared_path(spark, "x")
    assert a != b and a.startswith(base)


def test_what_a_batch_reads_does_not_grow_with_the_store(spark, tmp_path):
    """Ten times the articles in the key base, the same batch: as many rows of keys are read."""
    read = {}
    for n in (2_000, 20_000):
        store = str(tmp_path / str(n))
        existing = spark.range(1, n + 1).select(
            F.concat(F.lit("d"), "id").alias("recordKey"), F.concat(F.lit("d"), "id").alias("id"), F.col("id").alias("articleId"),
            F.col("id").alias("jsonIndex"), F.lit("neutro").alias("label"), F.lit("e").alias("evento_chave"))
        I.create_store(spark, store, existing, rows_per_bucket=100)
        arrived = spark.createDataFrame([(f"d{n - i}", n - i, n - i) for i in range(3)], "id string, articleId long, jsonIndex long")
        known = I.known_keys(spark, store, arrived, 0)
        # what the folders of the touched buckets hold is read, and nothing else
        read[n] = known.count()
        plan = known._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+ IN", plan) or re.search(r"PartitionFilters: \[[^]]*bucket", plan)
        assert I.number_arrivals(arrived, known).count() == 0 and read[n] >= 3
    assert read[20_000] <= 1.5 * read[2_000] < 0.3 * 2_000


def test_a_batch_reads_no_labels_and_no_earlier_candidates(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "s")
    I.create_store(spark, store)
    I.classify_batch(normalize_articles(arrivals(spark, 4)), 0, store, answer, "m")
    monkeypatch.setattr(I, "stored_rows", None)
    seen = []
    monkeypatch.setattr(I, "answer_durably", lambda prompts, *a, **k: seen.append(prompts.inputFiles()) or real(prompts, *a, **k))
    from newslens.operators.classify import answer_durably as real

    I.classify_batch(normalize_articles(arrivals(spark, 8)), 1, store, answer, "m")
    assert all("/candidates/batch=1/" in f or "/pending/batch=0/" in f for f in seen[0])


def test_keys_are_folded_and_a_repeated_batch_still_changes_nothing(spark, tmp_path):
    store = str(tmp_path / "s")
    I.create_store(spark, store)
    df = arrivals(spark, 30).withColumn("rawText", F.when(F.col("jsonIndex") == 9, "fails").otherwise(F.col("rawText")))
    for batch in range(3):
        I.classify_batch(normalize_articles(df.where(F.col("jsonIndex") % 3 == batch)), batch, store, answer, "m", attempts=1)
    before = as_set(I.stored_labels(spark, store))
    I.compact_keys(spark, store, rows_per_bucket=4)
    assert not (tmp_path / "s" / "arrivals" / "batch=1").exists()
    I.classify_batch(normalize_articles(df.where(F.col("jsonIndex") % 3 == 2)), 2, store, answer, "m", attempts=1)
    assert as_set(I.stored_labels(spark, store)) == before
    I.classify_batch(normalize_articles(df), 3, store, lambda p: '{"label":"neutro","evento_chave":"k"}', "n")
    assert [r.recordKey for r in I.stored_labels(spark, store).where("model = 'n'").collect()] == ["d9"]


def test_a_stream_folds_its_keys(spark, tmp_path, monkeypatch):
    df = arrivals(spark, 12)
    for part in range(4):
        df.where(F.col("jsonIndex") % 4 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = str(tmp_path / "store")
    I.classify_stream(stream, store, f"{store}/checkpoint", answer, "m", "nova obra", normalize_articles, fold_every=2).awaitTermination()
    assert len(list((tmp_path / "store" / "arrivals").glob("batch=*"))) <= 2
    assert I.stored_labels(spark, store).count() == 9
