"""Plan shapes that must hold at any size."""

import re

import pytest

from checks import catalog

SF = "/root/testdata/sf0.001"
PYTHON_ALLOWED = {"classify_stub", "classify_errors", "label_rows", "retries"}
TOP_EVENTS = {"top_positive", "top_negative", "ranking_lines"}
WRITES = {"read_articles", "read_labels", "classified_by_month", "labels_end_to_end", "stream_classify"}
# these number the rows of a written table to show its order
WRITES |= {"full_ranks", "read_corpus", "article_order", "event_row_order", "summary_order", "whole_run", "upsert_from_csv"}


def plan(spark, name):
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - WRITES))
def test_shape(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    python = re.findall(r"(MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMapGroups)", text)
    assert bool(python) == (name in PYTHON_ALLOWED)
    # a window without keys is one task; only the listed top events may have it
    if name not in TOP_EVENTS:
        for first_argument in re.findall(r"windowspecdefinition\(([^,]*)", text):
            assert not re.search(" (ASC|DESC)", first_argument)


@pytest.mark.parametrize("name", ["top_positive", "top_negative", "top_sources", "source_volume"])
def test_top_lists_are_cut_while_sorting(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


@pytest.mark.parametrize("name", ["dedupe_articles", "latest_labels", "upsert_labels"])
def test_first_row_per_key_is_cut_before_the_shuffle(spark, name):
    text = plan(spark, name)
    partial = re.search(r"Exchange hashpartitioning(?!.*Exchange hashpartitioning.*WindowGroupLimit).*?WindowGroupLimit .*?Partial", text, re.S)
    assert partial


def test_summary_reads_its_rows_twice_and_never_explodes_them(spark):
    text = plan(spark, "event_summary")
    rows = re.findall(r"FileScan parquet", text)
    assert len(rows) == 2
    # sums per combination of values are taken apart, below them nothing is
    assert text.count("Generate inline") == 1
    below = text[text.index("Generate inline") :]
    assert "HashAggregate" in below[: below.index("Exchange")]


def test_scans_read_only_needed_columns(spark):
    text = plan(spark, "sentiment_counts")
    scan = re.search(r"ReadSchema: struct<([^>]*)>", text[text.index("lineitem.parquet"):]).group(1)
    assert "l_tax" not in scan and "l_discount" not in scan and "l_linestatus" not in scan


def test_months_need_one_aggregate_shuffle(spark):
    text = plan(spark, "monthly_sentiment_counts")
    after_dedupe = text[: text.index("WindowGroupLimit")]
    assert after_dedupe.count("Exchange hashpartitioning") == 1
