import json

import pytest
from pyspark.sql import functions as F

from newslens.operators.classify import SECONDS_PER_ATTEMPT
from newslens.plans import stages
from newslens.schema import EVENT_SUMMARY_COLUMNS, LABEL_SCHEMA
from newslens.sources.articles import normalize_articles
from newslens.sources.labels import read_labels


def answer(prompt):
    kind = prompt[0]
    label = {"a": "muito positivo", "b": "negativo"}.get(kind, "neutro")
    return f"```json\n{json.dumps({'label': label, 'evento': f'Evento {kind}', 'evento_chave': f'chave {kind}'})}\n```"


def articles(spark):
    rows = [(i, i if i % 9 else i - 1, f"k{i % 20}", f"{'abc'[i % 3]} título {i % 4}", "Polícia Nova",
             f"2024-0{i % 5 + 1}-01" if i % 6 else "") for i in range(1, 61)]
    raw = spark.createDataFrame(
        rows, "jsonIndex long, articleId long, id string, title string, rawText string, publishedAt string")
    return normalize_articles(raw)


def test_whole_run_writes_every_table(spark, tmp_path):
    none = spark.createDataFrame([], LABEL_SCHEMA)
    stages.run_all(spark, articles(spark), none, "policia nova", answer, "m", str(tmp_path), parallelism=3)
    names = {p.name for p in tmp_path.iterdir()}
    assert names == {
        "work", "labels", "noticias_classificadas", "sentiment_counts", "monthly_sentiment_counts",
        "monthly_sentiment_percent", "top_sources_sentiment_counts", "eventos_por_noticia", "eventos_resumo",
        "eventos_muito_positivos", "eventos_muito_negativos", "ranking_resumo", "ranking_positivo", "ranking_negativo",
    }

    def read(name):
        return spark.read.parquet(str(tmp_path / name))

    labels = read_labels(spark, str(tmp_path / "labels"), "parquet")
    assert labels.count() == 60
    unique = read("noticias_classificadas").count()
    assert unique == labels.select("articleId").distinct().count() < 60
    summary = read("eventos_resumo")
    assert summary.columns == EVENT_SUMMARY_COLUMNS
    assert summary.agg(F.sum("n_artigos")).first()[0] == unique
    assert [r.evento_id for r in read("eventos_muito_positivos").collect()] == ["chave-a"]
    assert [r.evento_id for r in read("eventos_muito_negativos").collect()] == ["chave-b"]
    counts = spark.read.csv(str(tmp_path / "sentiment_counts"), header=True).collect()
    assert [r.label for r in counts][0] == "muito negativo" and sum(int(r.n_articles) for r in counts) == unique
    line = spark.read.csv(str(tmp_path / "ranking_positivo"), header=True).first().line
    assert line.startswith("1. **Evento a** - score medio 2.0; ")
    months = [r.month for r in spark.read.csv(str(tmp_path / "monthly_sentiment_counts"), header=True).collect()]
    assert months == sorted(months) and len(months) == 5


def test_resume_keeps_completed_rows(spark, tmp_path):
    args = (articles(spark), spark.createDataFrame([], LABEL_SCHEMA), "policia nova", answer, "one")
    stages.label_articles(*args, str(tmp_path / "w1")).write.parquet(str(tmp_path / "labels"))
    stored = spark.read.parquet(str(tmp_path / "labels"))
    failed = stored.withColumn("evento_chave", F.when(F.col("recordKey") == "k1", "").otherwise(F.col("evento_chave")))
    again = stages.label_articles(args[0], failed, "policia nova", answer, "two", str(tmp_path / "w2"))
    assert [(r.recordKey, r.model) for r in again.where("model = 'two'").collect()] == [("k1", "two")]
    fresh = stages.label_articles(args[0], failed, "policia nova", answer, "three", str(tmp_path / "w3"), resume=False)
    assert fresh.where("model = 'three'").count() == 60


def test_event_tables(spark, tmp_path):
    from newslens.operators.clean import clean_event_rows

    labels = stages.label_articles(
        articles(spark), spark.createDataFrame([], LABEL_SCHEMA), "policia nova", answer, "m", str(tmp_path / "w"))
    tables = stages.event_tables(clean_event_rows(labels), min_articles=2)
    assert tables["eventos_resumo"].count() == 3
    assert [r.evento_id for r in tables["eventos_muito_positivos"].collect()] == ["chave-a"]
    assert SECONDS_PER_ATTEMPT == 2


def test_a_second_run_in_the_same_folder_asks_only_for_what_failed(spark, tmp_path):
    def first(prompt):
        if prompt.startswith("a"):
            raise RuntimeError("refused")
        return answer(prompt)

    def second(prompt):
        if not prompt.startswith("a"):
            raise RuntimeError("asked again")
        return answer(prompt)

    for fn in (first, second):
        stages.run_all(spark, articles(spark), None, "policia nova", fn, "m", str(tmp_path), attempts=1,
                       timestamp_formats=["yyyy/MM/dd"], ordered=True)
    labels = read_labels(spark, str(tmp_path / "labels"), "parquet")
    assert labels.count() == 60 and labels.where("label = 'n/a'").count() == 0
    keys = [(r.publishedAt, r.articleId, r.jsonIndex) for r in labels.collect()]
    assert keys == sorted(keys)


def test_event_tables_take_a_stored_summary(spark):
    from newslens.operators.clean import clean_event_rows
    from newslens.operators.events import event_summary

    rows = spark.createDataFrame([("k", 1, "2024-01-01", "h", "t", "positivo", 1.0, "E", "e", "e-1", "", "")],
        "recordKey string, articleId long, publishedAt string, sourceHost string, title string, label string, "
        "sentiment_score double, evento string, evento_chave string, evento_id string, tipo_evento string, local string")
    summary = event_summary(clean_event_rows(rows))
    tables = stages.event_tables(rows.limit(0), summary=summary)
    assert tables["eventos_muito_positivos"].count() == 1


def test_a_broken_run_goes_on_at_the_stage_that_broke(spark, tmp_path, monkeypatch):
    articles(spark).write.parquet(str(tmp_path / "in"))
    folder = str(tmp_path / "run")

    def run(fn=answer, **more):
        stages.run_all(spark, spark.read.parquet(str(tmp_path / "in")), None, "policia nova", fn, "m", folder, **more)

    def fail(*args, **kwargs):
        raise RuntimeError("broken")

    with monkeypatch.context() as broken:
        broken.setattr(stages, "write_article_events", fail)
        with pytest.raises(RuntimeError, match="broken"):
            run()
    done = []
    with monkeypatch.context() as watched:
        for name in ("phrase_articles", "answer_durably", "upsert_labels", "replace_table", "write_classified", "sentiment_tables"):
            watched.setattr(stages, name, fail)
        watched.setattr(stages, "write_article_events", lambda *a, real=stages.write_article_events, **k: done.append(1) or real(*a, **k))
        run(fn=fail)
    assert done == [1] and read_labels(spark, f"{folder}/labels", "parquet").where("label = 'n/a'").count() == 0
    assert spark.read.parquet(f"{folder}/eventos_resumo").count() == 3
    # the run is complete, so the next one begins anew
    assert not [p for p in (tmp_path / "run" / "work" / "finished").iterdir() if not p.name.startswith(".")]


def test_a_changed_parameter_redoes_its_stage_and_those_behind(spark, tmp_path, monkeypatch):
    articles(spark).write.parquet(str(tmp_path / "in"))
    log = []
    for name in ("write_classified", "write_article_events"):
        monkeypatch.setattr(stages, name, lambda *a, name=name, real=getattr(stages, name), **k: log.append(name) or real(*a, **k))
    monkeypatch.setattr(stages.Progress, "end", lambda self: None)  # as if each run broke at its very end

    def run(**more):
        log.clear()
        stages.run_all(spark, spark.read.parquet(str(tmp_path / "in")), None, "policia nova", answer, "m", str(tmp_path / "run"), **more)
        return list(log)

    assert run() == ["write_classified", "write_article_events"]
    assert run() == []
    assert run(ordered=True) == ["write_classified", "write_article_events"]
    assert run(ordered=True, min_articles=2) == []
    spark.read.parquet(str(tmp_path / "in")).limit(50).write.parquet(str(tmp_path / "fewer"))
    stages.run_all(spark, spark.read.parquet(str(tmp_path / "fewer")), None, "policia nova", answer, "m", str(tmp_path / "run"))
    assert read_labels(spark, str(tmp_path / "run" / "labels"), "parquet").count() == 50
