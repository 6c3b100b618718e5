"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every neighbour above a node to the least neighbour of the node (itself included)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its lower neighbours to the least of them. Edges go from high to low."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one link to a lower node or is itself one that others link to, not both."""
    links = edges.groupBy("u").agg(F.count("*").alias("n"))
    return links.filter("n > 1").limit(1).count() == 0 and links.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count() == 0


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph.

    edges: columns `a`, `b` of any orderable type, null-free; loops and repeats are ignored.
    Returns one row per node that has a link to another node: `node`, `component` (the least node
    of its component). An empty edge table gives an empty result.

    Each round is two hash aggregations and two equi-joins, written to the shared folder; rounds
    grow with the logarithm of the longest path, and stars take none. No list of neighbours is ever gathered.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(now, "cc-edges")
    for _ in range(max_rounds):
        if _are_stars(now):
            break
        now = materialize(_small_star(_large_star(now)), "cc-round")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
