"""Connected components of a table of links, by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import cut

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest of its neighbourhood."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_n")).select("a", F.least("a", "_n").alias("_m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, move to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("_m"))
    moved = edges.join(least, "a").filter("b > _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return moved.union(least.select("a", F.col("_m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node it reaches), for every node of links(a, b).

    The links stay distributed; each round is written to the checkpoint folder. Stars
    are reached in a number of rounds that grows with the logarithm of the longest path.
    """
    greater = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = cut(links.filter("a <> b").select(*greater).distinct())
    for _ in range(MAX_ROUNDS):
        # stars already: no node has two smaller neighbours and no centre has one
        crossing = edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        forked = edges.groupBy("a").count().filter("count > 1")
        if crossing.isEmpty() and forked.isEmpty():
            break
        edges = cut(_small_star(_large_star(edges)))
    else:
        raise RuntimeError("components did not settle")
    centres = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(centres)
