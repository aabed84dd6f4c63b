"""Views over the driver tables, mapped onto the data contract (see FIXTURES.md).

Each view is one SQL text that Spark and DuckDB both run; the tables it names are
resolved by whoever runs it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: columns of the tables in use; reading with a schema needs no look into the files
SCHEMAS = {
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
}
_LABEL_TABLES = ("nation", "supplier", "part", "lineitem")
_ARTICLE_TABLES = ("documents", "labels", "orders")

#: tasks that the rows of one part of a file are dealt to, and the order they are dealt by
TASKS_PER_SPLIT = 16
_LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")

PHRASE = "re"

#: label rows, several per article, undated articles, every label
FX_LABELS = """
SELECT l_orderkey AS articleId,
       concat('r-', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-',
              CAST(round(l_extendedprice * 100) AS BIGINT)) AS recordKey,
       l_linenumber AS lineNumber, l_returnflag AS flag, l_linestatus AS status,
       CAST(l_shipdate AS TIMESTAMP) AS shipped,
       CASE WHEN l_orderkey % 37 = 0 THEN NULL ELSE CAST(l_shipdate AS TIMESTAMP) END AS publishedAt,
       n_name AS sourceHost,
       concat(p_name, ' / ', s_name) AS title,
       CASE WHEN l_quantity <= 5  THEN 'muito negativo' WHEN l_quantity <= 15 THEN 'negativo'
            WHEN l_quantity <= 20 THEN 'neutro'         WHEN l_quantity <= 40 THEN 'positivo'
            WHEN l_quantity <= 45 THEN 'muito positivo' ELSE 'n/a' END AS label,
       concat(p_name, ' ', p_type)  AS evento,
       concat(p_name, ' ', p_brand) AS evento_chave,
       replace(replace(concat(p_name, '-', lower(p_brand)), ' ', '-'), '#', '-') AS evento_id,
       p_type AS tipo_evento, n_name AS local
FROM lineitem JOIN part ON l_partkey = p_partkey
              JOIN supplier ON l_suppkey = s_suppkey
              JOIN nation ON s_nationkey = n_nationkey
"""

#: corpus rows with accents, repeated ids and near copies; some undated
FX_ARTICLES = """
SELECT d.doc_id + 1 AS articleId,
       d.doc_id + 1 AS jsonIndex,
       concat('d-', d.doc_id % 900) AS id,
       substring(d.text, 1, 60) AS title, '' AS summaryPreview,
       d.text AS rawText, d.source AS sourceHost, d.lang AS lang,
       CASE WHEN l.doc_id IS NULL THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS published,
       CASE WHEN l.doc_id IS NULL THEN 'n/a'
            WHEN quality = 0 AND toxic = 1 THEN 'muito negativo'
            WHEN quality = 0 THEN 'negativo'   WHEN toxic = 1 THEN 'neutro'
            WHEN d.doc_id % 10 = 0 THEN 'muito positivo' ELSE 'positivo' END AS label
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
                 LEFT JOIN orders ON d.doc_id = o_orderkey
"""

#: raw classifier answers: plain, fenced, with prose around, and broken
FX_RESPONSES = """
SELECT articleId, recordKey,
       CASE WHEN articleId % 50 = 0 THEN '{bad'
            WHEN articleId % 3 = 0 THEN concat('```json', chr(10), body, chr(10), '```')
            WHEN articleId % 3 = 1 THEN concat('Answer: ', body, ' end')
            ELSE body END AS content
FROM (SELECT articleId, recordKey,
             concat('{"label":"', upper(label), '","evento":"', evento,
                    '","evento_chave":"', evento_chave, '","local":null}') AS body
      FROM fx_labels) b
"""

#: label rows as an earlier run left them: articles shipped before 1999, and
#: without an event key where the label is n/a (a failed call)
FX_EXISTING = """
SELECT recordKey, label, CASE WHEN label = 'n/a' THEN '' ELSE evento_chave END AS evento_chave,
       'old' AS model
FROM fx_labels WHERE shipped < TIMESTAMP '1999-01-01 00:00:00'
"""

#: label rows as messy text, the way a label file may look
FX_TEXT_LABELS = """
SELECT recordKey, concat('id-', recordKey) AS id, title, sourceHost, evento, evento_chave,
       CASE lineNumber WHEN 1 THEN upper(label) WHEN 2 THEN concat('  ', label, ' ')
                       WHEN 3 THEN concat('sentimento ', label) WHEN 4 THEN 'null'
                       ELSE label END AS label,
       CASE lineNumber WHEN 1 THEN '' WHEN 2 THEN 'x' WHEN 3 THEN '1' WHEN 4 THEN '-0.5'
                       WHEN 5 THEN ' 2.0 ' ELSE 'n/a' END AS sentiment_score,
       CASE flag WHEN 'A' THEN 'n/a' WHEN 'R' THEN 'None' ELSE tipo_evento END AS tipo_evento,
       CASE status WHEN 'F' THEN 'NaN' ELSE local END AS local,
       CASE flag WHEN 'A' THEN '' ELSE evento_id END AS evento_id,
       CASE WHEN lineNumber = 7 AND flag = 'A' THEN 'x'
            ELSE CAST(articleId AS VARCHAR(20)) END AS articleId,
       publishedAt
FROM fx_labels
"""

_PARTS = {
    "fx_labels": FX_LABELS,
    "fx_articles": FX_ARTICLES,
    "fx_responses": FX_RESPONSES,
    "fx_existing": FX_EXISTING,
    "fx_text_labels": FX_TEXT_LABELS,
}
_NEEDS_LABELS = ("fx_responses", "fx_existing", "fx_text_labels")


def with_views(*names: str) -> str:
    """A WITH clause that defines the named views (and what they build on)."""
    wanted = ["fx_labels"] if any(n in _NEEDS_LABELS for n in names) else []
    wanted += [n for n in names if n not in wanted]
    return "WITH " + ", ".join(f"{n} AS ({_PARTS[n].strip()})" for n in wanted)


#: where tables and views lie that have been stored before, by folder and name
_stored: dict[tuple[str, str], str] = {}


def store_views(spark: SparkSession, sf_dir: str, folder: str, files: int = 32) -> None:
    """Write the views, and the documents, as Parquet tables of ``files`` files, which are read from then on.

    The driver's tables are one row group each, so reading them is one task whatever is done with them.
    """
    for name in ("documents", *_PARTS):
        rows = table(spark, sf_dir, name) if name in SCHEMAS else view(spark, sf_dir, name)
        rows.repartition(files).write.parquet(f"{folder}/{name}")
    _stored.update({(sf_dir, name): f"{folder}/{name}" for name in ("documents", *_PARTS)})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.schema(SCHEMAS[name]).parquet(_stored.get((sf_dir, name), f"{sf_dir}/{name}.parquet"))


def view(spark: SparkSession, sf_dir: str, name: str, dealt: bool = False) -> DataFrame:
    """The named view over the Parquet tables in ``sf_dir``.

    A label row is some twenty times as wide as what ``lineitem`` takes for it in its file, so one task's part of
    the file gives more rows than the task can sort in memory. For a use that sorts them, ``dealt`` moves the narrow
    rows to smaller tasks first, the rows of an article together unless it has very many.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if (sf_dir, name) in _stored:
        return spark.read.parquet(_stored[sf_dir, name])
    for t in _ARTICLE_TABLES if name == "fx_articles" else _LABEL_TABLES:
        rows = table(spark, sf_dir, t)
        if dealt and t == "lineitem":
            rows = rows.repartitionByRange(TASKS_PER_SPLIT * rows.rdd.getNumPartitions(), *_LINE_KEY)
        rows.createOrReplaceTempView(t)
    return spark.sql(f"{with_views(name)} SELECT * FROM {name}")
