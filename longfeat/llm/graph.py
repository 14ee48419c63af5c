"""Connected components of an edge table by alternating large-star and small-star steps (O(log n) rounds).

A node's minimum is combined before the shuffle and joined back to its edges, so a node with very many edges is no
group in one task. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longfeat.sources.storage import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    across = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return across.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _is_starry(edges: DataFrame) -> bool:
    """Does every node point to one node at most, and none to a node that points on?"""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out")).union(edges.select("v", F.lit(0)))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("pointed"))
    on = (F.col("out") > 1) | ((F.col("out") > 0) & (F.col("pointed") == 0))
    return not nodes.agg(F.count_if(on)).first()[0]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node it is joined with; only nodes that have an edge. Loops are ignored.

    Edges point to the smaller node, so they are done when they are stars, which one narrow aggregate tells.
    """
    down = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = materialize(down.distinct(), "edges")
    while not _is_starry(now):
        now = materialize(_small_star(_large_star(now)), "edges")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
