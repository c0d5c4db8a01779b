"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie a node's larger (large) or smaller neighbours to the least node around."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = around.join(least, "u")
    if large:
        return tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    ties = tied.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return ties.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down at most, and none where another node's edge ends."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.where("down > 1 or (down > 0 and up > 0)").isEmpty()


def components(links: DataFrame, root: str, name: str) -> DataFrame:
    """(node, component): component is the least node reachable. links: u, v of one orderable type.

    Nodes without a link have no row. Each round is written to the shared folder, so a lost
    executor costs a round at most. Rounds end when the edges are stars.
    """
    edges = materialise(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), root, f"{name}-0")
    turn = 0
    while not _stars(edges):
        turn += 1
        edges = materialise(_star(_star(edges, True), False), root, f"{name}-{turn}")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
