from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from newslens.operators import sentiment as S
from newslens.schema import LABELS

SCHEMA = "label string, month string, sourceHost string, sentiment_score double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def repeated(spark, counts):
    rows = [(label, "2020-01", "h", None) for label, n in zip(LABELS, counts) for _ in range(n)]
    return frame(spark, rows)


def test_counts_in_label_order_with_zeros(spark):
    got = S.sentiment_counts(repeated(spark, [30, 184, 19, 499, 5, 110])).collect()
    assert [tuple(r) for r in got] == [
        ("muito negativo", 30, 3.5419),
        ("negativo", 184, 21.7237),
        ("neutro", 19, 2.2432),
        ("positivo", 499, 58.9138),
        ("muito positivo", 5, 0.5903),
        ("n/a", 110, 12.987),
    ]
    sparse = S.sentiment_counts(repeated(spark, [0, 0, 1, 0, 0, 127])).collect()
    assert [(r.n_articles, r.percent) for r in sparse] == [
        (0, 0.0), (0, 0.0), (1, float(np.round(1 / 128 * 100, 4))), (0, 0.0), (0, 0.0), (127, float(np.round(127 / 128 * 100, 4))),
    ]


def test_empty_input_gives_zero_counts_and_no_percent(spark):
    got = S.sentiment_counts(repeated(spark, [0] * 6)).collect()
    assert [(r.n_articles, r.percent) for r in got] == [(0, None)] * 6


def test_bars_have_display_names(spark):
    got = S.label_bars(repeated(spark, [1, 0, 0, 0, 0, 2])).orderBy("ord").collect()
    assert [(r.display, r.score, r.n_articles) for r in got] == [
        ("Muito negativo", -2, 1), ("Negativo", -1, 0), ("Neutro", 0, 0), ("Positivo", 1, 0),
        ("Muito positivo", 2, 0), ("Não aplicável", None, 2),
    ]


MONTHLY = [
    ("positivo", "2017-12", "a", 1.0),
    ("positivo", "2018-01", "a", 1.0),
    ("negativo", "2018-01", "b", -1.0),
    ("n/a", "2018-01", "b", None),
    ("neutro", "2018-03", None, 0.0),
    ("neutro", None, "c", 0.0),
]


def test_monthly_tables(spark):
    df = frame(spark, MONTHLY)
    counts = S.monthly_sentiment_counts(df).orderBy("month").collect()
    assert [tuple(r) for r in counts] == [
        ("2017-12", 0, 0, 0, 1, 0, 0), ("2018-01", 0, 1, 0, 1, 0, 1), ("2018-03", 0, 0, 1, 0, 0, 0),
    ]
    percent = S.monthly_sentiment_percent(df).where("month = '2018-01'").first()
    assert tuple(percent) == ("2018-01", 0.0, 33.3333, 0.0, 33.3333, 0.0, 33.3333)
    assert [tuple(r) for r in S.monthly_volume(df).orderBy("month").collect()] == [("2018-01", 3), ("2018-03", 1)]


def test_chart_series(spark):
    df = frame(spark, MONTHLY)
    lines = S.percent_lines(df).where("month = '2018-01'").collect()
    assert [(r.label, r.percent) for r in lines] == [
        ("muito negativo", 0.0), ("negativo", 1 / 3 * 100), ("positivo", 1 / 3 * 100), ("muito positivo", 0.0),
    ]
    bands = S.stacked_area(df).where("month = '2018-01'").orderBy("ord").collect()
    assert [r.label for r in bands] == LABELS
    edges = np.cumsum([r.percent for r in bands]).tolist()
    assert [r.upper for r in bands] == edges and [r.lower for r in bands] == [0.0, *edges[:-1]]
    assert {r.month for r in S.stacked_area(df).collect()} == {"2018-01", "2018-03"}


def test_top_sources_break_ties_by_name_at_the_cut(spark):
    rows = [("positivo", None, f"s{i:02}", None) for i in range(20, 0, -1)]
    rows += [("n/a", None, "big", None)] * 3 + [("neutro", None, None, None)] * 9
    top = S.top_sources(frame(spark, rows)).collect()
    assert [r.sourceHost for r in top] == ["big", *[f"s{i:02}" for i in range(1, 12)]]
    assert tuple(top[0])[1:] == (0, 0, 0, 0, 0, 3)
    assert [tuple(r) for r in S.source_volume(frame(spark, rows), 2).collect()] == [("big", 3), ("s01", 1)]


def test_histogram_edges(spark):
    scores = [-2.5, -2.0, -1.5, -0.5, 0.0, 0.5, 1.4, 1.5, 2.0, 2.5, 3.0, -3.0, None]
    got = S.score_histogram(frame(spark, [("n/a", None, None, s) for s in scores])).collect()
    counts, edges = np.histogram([s for s in scores if s is not None], bins=[-2.5, -1.5, -0.5, 0.5, 1.5, 2.5])
    assert [r.n_articles for r in got] == counts.tolist()
    assert [(r.bin_from, r.bin_to) for r in got] == list(zip(edges[:-1], edges[1:]))


def test_funnel(spark):
    rows = [(1, True, True), (1, True, False), (2, True, False), (3, False, True), (4, True, True), (1, False, True)]
    df = spark.createDataFrame(rows, "articleId int, m boolean, d boolean")
    got = S.corpus_funnel(df, F.col("m"), F.col("d")).first()
    assert tuple(got) == (6, 4, 3, 2)
    assert tuple(S.corpus_funnel(df.limit(0), F.col("m"), F.col("d")).first()) == (0, 0, 0, 0)


def test_polarity_and_coverage(spark):
    got = S.polarity_share(repeated(spark, [27, 189, 21, 512, 2, 96])).first()
    assert (got.n_positive, got.n_negative, got.percent_positive, got.percent_negative) == (514, 216, 60.6848, 25.5018)
    days = spark.createDataFrame([("2016-05-31",), ("2026-06-11",), (None,)], "d string")
    cover = S.date_coverage(days.select(F.to_timestamp("d").alias("publishedAt"))).first()
    assert tuple(cover) == (datetime(2016, 5, 31), datetime(2026, 6, 11))


@pytest.mark.parametrize("parts", [1, 9])
def test_invariants(spark, parts):
    df = spark.range(2000).select(
        F.element_at(F.array(*[F.lit(l) for l in LABELS]), (F.hash("id") % 3 + 4).cast("int")).alias("label"),
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("20"), (F.col("id") % 20 + 10).cast("string"), F.lit("-05"))).alias("month"),
        F.lit("h").alias("sourceHost"),
    ).repartition(parts)
    assert sum(r.n_articles for r in S.sentiment_counts(df).collect()) == 2000
    monthly = S.monthly_sentiment_counts(df).collect()
    assert sum(sum(r[1:]) for r in monthly) == df.where("month is not null").count()
    for r in S.monthly_sentiment_percent(df).collect():
        assert abs(sum(r[1:]) - 100) <= 6 * 0.00005 + 1e-9
