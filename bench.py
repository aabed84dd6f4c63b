"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) names the tables and
``BENCH_CPUS`` (default 8) the local cores. Each query runs once to warm up and
then ``BENCH_RUNS`` (default 3) times; its time is the median. All rows and
columns of a result are computed and then discarded.

The views that the queries start from are written once before, as many files, and are read from there:
the given tables are one row group each, and reading one is a single task.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from checks import catalog
from checks.fixtures import store_views
from newslens.session import build_session, shared_path

HEADLINE = [
    "normalize_articles",
    "fold_accents",
    "phrase_filter",
    "record_keys",
    "parse_responses",
    "responses_to_labels",
    "pending_articles",
    "upsert_labels",
    "labels_end_to_end",
    "dedupe_articles",
    "load_event_rows",
    "sentiment_counts",
    "monthly_sentiment_counts",
    "monthly_sentiment_percent",
    "top_sources",
    "score_histogram",
    "event_titles",
    "event_summary",
    "rank_positive",
    "top_positive",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    store_views(spark, sf_dir, shared_path(spark, "bench-views"))
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries (median of warm runs)",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
