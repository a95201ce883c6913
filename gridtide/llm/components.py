"""Connected components of a table of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.llm.common import stored


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for every end of a link (a, b); a component is named by its smallest node.

    Large-star and small-star steps in turn until no link changes: each node's links are re-hung to the smallest of its
    neighbours. The rounds grow with the logarithm of the longest chain, and each is written, so none is redone.
    """
    edges = stored(_both_ways(links).where("u > v").distinct(), "edges")
    seen = None
    while True:
        edges = stored(_small_star(_large_star(edges)), "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def _both_ways(links: DataFrame) -> DataFrame:
    ends = links.select(links.columns[0], links.columns[1]).toDF("u", "v")
    return ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node to the smallest of the node and its neighbours."""
    around = _both_ways(edges)
    least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))
    hung = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return hung.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("least"))
    hung = down.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return hung.unionByName(least.select("u", F.col("least").alias("v"))).where("u <> v").distinct()
