"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources in code point order, null last, weigh 1, 2, 3, and so on in turn, and share all
words of the corpus. A source's target stops at ``MAX_EPOCHS`` times its own words; what is
left over is shared again by weight among the others.

A target is met with whole documents. Complete epochs come first: every document
of the source, as often as its words fit. The rest is a weighted draw without replacement: each
document has the key ``-ln(u) / weight`` with ``u`` from a digest of its id, and
documents are taken by rising key until their words are as near to the rest as whole documents get.
Nothing is drawn at random, so reruns agree.

The order by (source, key) is a range partitioning, which splits a large source
over many tasks. Words before a document are the sum of its source's earlier
ranges, one number each, and of the earlier documents in its own range. The
window over sources sees one row per source, so the list of sources (not
their documents) must fit one task.

Cases: a null, empty or blank text has no words and takes none. Null source is one source,
the last. Rows with equal ids have equal keys; they follow each other by size, then text,
and each counts. Unlabelled documents weigh ``UNLABELLED``. A source without
words has target zero. An empty table gives no rows. Other columns are not read by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newslens.llm.common import stored, table, text_digest

MAX_EPOCHS = 3
WEIGHT_CYCLE = 3
#: Sampling weight by label ``quality``, and without a label.
QUALITY_WEIGHTS = {1: 2.0, 0: 0.5}
UNLABELLED = 1.0
SEED = "mix"

WORDS = "[^ \\t-\\r]+"


def sampling_keys(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One narrow row per document: doc_id, digest, source, size in words, and its sampling key."""
    weight = F.lit(UNLABELLED)
    for quality, value in QUALITY_WEIGHTS.items():
        weight = F.when(F.col("quality") == quality, F.lit(value)).otherwise(weight)
    sized = docs.select(
        "doc_id",
        text_digest(F.col("text")).alias("digest"),
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
    )
    best = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    hexed = F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13)
    u = (F.conv(hexed, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return sized.join(best, "doc_id", "left").select(
        "doc_id", "digest", "source", "size", (-F.log(u) / weight).alias("sampling_key")
    )


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target) per source of ``sized``, by filling up to the caps in closed form."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = (F.row_number().over(in_order) - 1) % WEIGHT_CYCLE + 1
    cap = (F.col("source_size") * MAX_EPOCHS).cast("double")
    weighed = sources.withColumn("weight", weight.cast("double")).withColumn("cap", cap)
    # Sources reach their caps in this order as the level rises.
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    every = Window.partitionBy()
    leveled = weighed.withColumn("level", (F.sum("source_size").over(every) - full) / open_)
    first_open = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(every)
    return leveled.withColumn("level", first_open).select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target")
    )


def mix(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, digest, source, size, source_size, target, taken) per row of ``docs``."""
    keyed = sampling_keys(docs, labels)
    order = ["sampling_key", "doc_id", "size", "digest"]
    ranged = stored(
        keyed.repartitionByRange("source", *order).withColumn("part", F.spark_partition_id()), "mix-ranges"
    )
    parts = ranged.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        targets(ranged)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumnRenamed("source", "s")
    )
    parts = (
        parts.withColumn("before", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)))
        .join(plan, F.col("source").eqNullSafe(F.col("s")))
        .select(F.col("source").alias("s"), F.col("part").alias("p"), "before", "source_size", "target", "epochs", "rest")
    )
    inside = Window.partitionBy("source", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranged.withColumn("up_to", F.sum("size").over(inside)).join(
        parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))
    )
    up_to = F.col("before") + F.col("up_to")
    # Taken if that brings the sum nearer to the rest than stopping before this document does.
    drawn = 2 * up_to - F.col("size") < 2 * F.col("rest")
    return rows.select(
        "doc_id",
        "digest",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("epochs") + F.when(drawn, 1).otherwise(0))).cast("long").alias("taken"),
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("digest")


OP4_SQL = r"""
WITH sized AS (
  SELECT d.doc_id, d.source, CAST(coalesce(len(regexp_extract_all(text, '[^ \t-\r]+')), 0) AS BIGINT) AS size,
         -ln((CAST('0x' || substr(md5('mix:' || CAST(d.doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
           / CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS k
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS DOUBLE) AS cap,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w
  FROM sized GROUP BY source
), lev AS (
  SELECT *, ((SELECT sum(source_size) FROM src)
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM src
), plan AS (
  SELECT source, source_size, least(cap, w * (SELECT max(level) FROM lev WHERE level <= cap / w)) AS target FROM lev
), run AS (
  SELECT s.doc_id, s.source, s.size, source_size, target, floor(target / source_size) AS epochs,
         target - floor(target / source_size) * source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id ROWS UNBOUNDED PRECEDING) AS up_to
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, source, size, source_size, target,
       CAST(size * (epochs + CASE WHEN 2 * up_to - size < 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run
"""
