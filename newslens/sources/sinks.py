"""Writers for label tables, classified articles and summary tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newslens.schema import ARTICLE_EVENT_COLUMNS, CLASSIFIED_COLUMNS, LABEL_COLUMNS

#: rows of a CSV file: cells may hold line breaks, so a file is read by one task
CSV_ROWS = 100_000


def _present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def _write(df: DataFrame, path: str, fmt: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        # by default the CSV writer trims every cell
        writer = writer.options(
            header=True,
            escape='"',
            maxRecordsPerFile=CSV_ROWS,
            emptyValue="",
            nullValue="",
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        )
    writer.save(path)


def landed(df: DataFrame, path: str) -> DataFrame:
    """Write a table and return it as read back, so that nothing computes it twice."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def label_table(labels: DataFrame, ordered: bool = False) -> DataFrame:
    """The 25 label columns; others are ignored and absent ones are NULL.

    ``ordered`` sorts by date, article id and position.
    """
    for column in LABEL_COLUMNS:
        if column not in labels.columns:
            labels = labels.withColumn(column, F.lit(None).cast(T.StringType()))
    labels = labels.select(*LABEL_COLUMNS)
    return labels.orderBy("publishedAt", "articleId", "jsonIndex") if ordered else labels


def write_labels(labels: DataFrame, path: str, fmt: str = "parquet", ordered: bool = False) -> None:
    """``label_table`` written to ``path``, over what is there."""
    _write(label_table(labels, ordered), path, fmt)


class Folder:
    """A folder of the cluster's file system, by the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._make = path.rstrip("/"), spark._jvm.org.apache.hadoop.fs.Path
        self.files = self._make(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, inside: str = "", hidden: bool = True) -> list[str]:
        """What is in the folder, or in one inside it; nothing where there is none."""
        at = self._make(f"{self.path}/{inside}" if inside else self.path)
        found = [f.getPath().getName() for f in self.files.listStatus(at)] if self.files.exists(at) else []
        return sorted(n for n in found if hidden or not n.startswith(("_", ".")))

    def delete(self, name: str) -> None:
        self.files.delete(self._make(f"{self.path}/{name}"), True)

    def put(self, name: str, text: str) -> None:
        """A small file that is there whole or not at all; fails if there is one of that name."""
        made, wanted = self._make(f"{self.path}/_{uuid.uuid4().hex}"), self._make(f"{self.path}/{name}")
        stream = self.files.create(made, False)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        if self.files.exists(wanted) or not self.files.rename(made, wanted):
            self.files.delete(made, False)
            raise OSError(f"{self.path} was replaced by another writer at the same time")


_SNAPSHOTS, _POINTER = "_snapshots", "_pointer-"


def current_path(spark: SparkSession, path: str) -> str:
    """Where the table at ``path`` lies now: in the snapshot that its newest pointer names, else in the folder itself."""
    pointers = [n for n in Folder(spark, path).names() if n.startswith(_POINTER)]
    return f"{path.rstrip('/')}/{_SNAPSHOTS}/{pointers[-1].removeprefix(_POINTER)}" if pointers else path


def replace_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()
) -> None:
    """Put ``df``, which may be read from the table itself, in the place of the table at ``path``.

    It is written as a snapshot of its own, and then a pointer to it is put in place by one rename; until then readers
    (``current_path``) see the old table whole, whatever breaks. A plain folder becomes such a table with
    its first replacement. The snapshot before stays for those who read it now; older ones go.
    """
    spark = df.sparkSession
    folder = Folder(spark, path)
    before = [n for n in folder.names() if n.startswith(_POINTER)]
    number = int(before[-1].removeprefix(_POINTER).split("-")[0]) + 1 if before else 1
    name = f"{number:010d}-{uuid.uuid4().hex}"
    _write(df, f"{folder.path}/{_SNAPSHOTS}/{name}", fmt, partition_by)
    _point(folder, name)
    kept = {name, *(p.removeprefix(_POINTER) for p in before[-1:])}
    for old in folder.names(_SNAPSHOTS):
        # a snapshot without a pointer may be another writer's
        if old not in kept and old < min(kept):
            folder.delete(f"{_SNAPSHOTS}/{old}")
    for old in before[:-1]:
        folder.delete(old)
    if before:  # the plain table has been out of use for one replacement
        for old in folder.names():
            if not old.startswith((_SNAPSHOTS, _POINTER)):
                folder.delete(old)


def _point(folder: Folder, name: str) -> None:
    number = name.split("-")[0]
    if any(n.startswith(f"{_POINTER}{number}-") for n in folder.names()):
        raise OSError(f"{folder.path} was replaced by another writer at the same time")
    folder.put(f"{_POINTER}{name}", name)


def classified_columns(classified: DataFrame) -> DataFrame:
    """Up to 26 columns, those present, in their fixed order."""
    return _present(classified, CLASSIFIED_COLUMNS)


def article_event_columns(rows: DataFrame) -> DataFrame:
    """Up to 16 columns, those present, in their fixed order."""
    return _present(rows, ARTICLE_EVENT_COLUMNS)


def write_classified(
    classified: DataFrame, path: str, fmt: str = "parquet", ordered: bool = False
) -> None:
    """Classified articles, one folder per month; ``ordered`` sorts by date (undated last) and article id.

    The rebalance hint lets adaptive execution split a month that is too large
    for one file and join small ones, instead of every task writing every month.
    """
    out = classified_columns(classified)
    if ordered:
        out = out.orderBy("month", F.col("publishedAt").asc_nulls_last(), "articleId")
    else:
        out = out.hint("rebalance", F.col("month"))
    _write(out, path, fmt, partition_by=["month"])


def write_article_events(
    rows: DataFrame, path: str, fmt: str = "parquet", ordered: bool = False
) -> None:
    """Article-event relation; ``ordered`` sorts by date (undated last) and article id."""
    out = article_event_columns(rows)
    if ordered:
        out = out.orderBy(F.col("publishedAt").asc_nulls_last(), "articleId")
    _write(out, path, fmt)


def write_tables(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Each table to ``folder/<name>``, with as many files as its size calls for."""
    for name, table in tables.items():
        _write(table, f"{folder.rstrip('/')}/{name}", fmt)


def write_small_tables(tables: Mapping[str, DataFrame], folder: str, fmt: str = "csv") -> None:
    """Tables of a few rows per label, month or top source: one file each."""
    write_tables({name: table.coalesce(1) for name, table in tables.items()}, folder, fmt)
