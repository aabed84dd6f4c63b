"""Connected components of an undirected graph whose edges are rows.

Large-star and small-star steps in turn: every node passes the least
neighbour it knows to its larger neighbours, then to its smaller ones, until the
graph is a set of stars around each component's least node. Each round is joins
and partial aggregates on node ids, is written to the shared folder, and takes
the place of the round before. Nothing is gathered on the driver but a count and
a checksum of the edges.

One component may hold a third of all nodes, so the centre of its star is the end of
as many edges. Least neighbours are written before edges meet them: then
both sides of that join are plain shuffles, which Spark splits where one node has too
many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.llm.common import stored


def _to_larger(edges: DataFrame) -> DataFrame:
    """Large star: an edge (u, v), u > v, leads from u to the least neighbour of v, if that is below v."""
    ends = edges.union(edges.select("v", "u"))
    least = ends.groupBy("u").agg(F.min("v").alias("m")).where("m < u").select(F.col("u").alias("k"), "m")
    told = edges.join(stored(least, "least"), F.col("v") == F.col("k"), "left")
    return told.select("u", F.coalesce("m", "v").alias("v")).distinct()


def _to_smaller(edges: DataFrame) -> DataFrame:
    """Small star: a node and all its smaller neighbours are led to the least of those."""
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    told = edges.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).where("v <> m")
    return told.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of an edge, root being the least node of its component.

    Edges from a node to itself, repeated edges and edges with a null end add
    nothing: a node that has only such edges is not returned.
    """
    now = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v")
    now = stored(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        sign = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if sign == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select("v", "v").distinct()
            )
        state = sign
        now = stored(_to_smaller(_to_larger(now)), "edges")
