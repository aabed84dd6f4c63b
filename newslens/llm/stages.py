"""The corpus pipeline's stages: each applies one operator's decisions to documents.

Every function takes (spark, docs, sf_dir) and works on all rows of ``docs``,
whatever columns it has besides ``doc_id``, ``text`` and ``source``. The columns
of the input are those of the result, but for ``mixing``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.llm import decontaminate, linededup, mixing as mixer, quality, simhash as near
from newslens.llm.common import free_name, stored, table, text_digest


def _rows(docs: DataFrame) -> DataFrame:
    """Whole rows in one column, out of the way of other names."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def _same(doc_id: str, digest: str) -> Column:
    """A row of ``_rows`` is the document with this id and text digest."""
    return F.col("row.doc_id").eqNullSafe(F.col(doc_id)) & (text_digest(F.col("row.text")) == F.col(digest))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Raw counts are of ``docs``, trusted ones of its labelled documents."""
    verdict = free_name(docs, "quality_verdict")
    judged = quality.quality_verdicts(docs, table(spark, sf_dir, "labels"), into=verdict)
    return judged.where(F.col(verdict).kept).drop(verdict)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their later copies of repeated lines; one that keeps no word goes."""
    counts = free_name(docs, "line_dedup")
    left = linededup.dedup_lines(docs, into=counts).where(F.regexp_like("text", F.lit("[^ \\t-\\r]"))).drop(counts)
    return left.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else left


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the least id, and of rows with that id the least text digest.

    Rows equal in id and text are one document and leave one row, whichever.
    """
    kept = near.near_duplicates(docs.select("doc_id", "text")).where("representative")
    kept = kept.groupBy(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest")).agg(F.count("*").alias("times"))
    found = _rows(docs).join(stored(kept, "representatives"), _same("kept_id", "kept_digest"))
    # Only rows that are there several times are shuffled again.
    several = found.where("times > 1").dropDuplicates(["kept_id", "kept_digest"])
    return found.where("times = 1").unionByName(several).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = found.where("n_hit > 0").select(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest")).distinct()
    return _rows(docs).join(hit, _same("hit_id", "hit_digest"), "left_anti").select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``size``, ``source_size``, ``target`` and ``taken``.

    Where ``docs`` has a column of such a name, the added one's name is lengthened.
    """
    added = ["size", "source_size", "target", "taken"]
    plan = mixer.mix(docs, table(spark, sf_dir, "labels")).where("taken > 0").dropDuplicates(["doc_id", "digest"])
    plan = plan.select(F.struct(*added).alias("mix"), F.col("doc_id").alias("m_id"), F.col("digest").alias("m_digest"))
    found = _rows(docs).join(plan, _same("m_id", "m_digest"))
    return found.select("row.*", *(F.col(f"mix.{c}").alias(free_name(docs, c)) for c in added))
