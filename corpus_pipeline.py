"""Training text from raw documents: five stages, each on all that the stage before kept.

1. quality rules drop the documents they reject;
2. line dedup takes repeated runs of lines out of the texts;
3. SimHash keeps one document of each class of near copies, the one with the least id;
4. benchmark decontamination drops the documents that hold benchmark passages;
5. mixing takes the rest to the sources' target shares.

All stages but the last return the columns of ``documents``. Each result is
written to the cluster's shared folder and read again as the next stage's input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newslens.llm import stages
from newslens.llm.common import stored, table

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", stages.quality_rules),
    ("line_dedup", stages.line_dedup),
    ("simhash", stages.simhash),
    ("decontamination", stages.decontamination),
    ("mixing", stages.mixing),
]

#: SQL has neither the stage's hash functions nor its component search.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table ``documents`` to the mix."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
