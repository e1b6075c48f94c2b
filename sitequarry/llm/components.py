"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.common import discard, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node's neighbourhood (itself included)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select(F.col("m").alias("a"), F.col("u").alias("b"))
    rest = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return own.unionByName(rest).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes with an edge; component is the smallest node reachable.

    edges has columns a and b, in either order, repeated or not; loops and nulls are left out.  Every round is written to
    the shared folder, so lineage stays short, and the round before is removed.  It ends when edges form stars, after O(log^2) rounds.
    """
    now = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        last, now = now, stored(_small_star(_large_star(now)), "edges")
        discard(last)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if mark == before:
            break
        before = mark
    found = stored(now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct(), "components")
    discard(now)
    return found
