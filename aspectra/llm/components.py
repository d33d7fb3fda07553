"""Connected components of an edge table by alternating large-star and small-star steps.

Only minima per node are aggregated (with partial aggregation); neighbour lists are never
gathered. A node with more than 1 / ``HOT`` of all edges, of which there are fewer than ``HOT``, has its minimum broadcast, so
its edges stay where they are; the others are joined by shuffle. Every step is checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import discard, stash


HOT = 1000


def _with_least(edges: DataFrame, least: DataFrame, node: str, n_edges: int) -> DataFrame:
    """``edges`` with the columns of ``least`` (node, m, n edges of the node); the n of all nodes sum up to at most 2 * ``n_edges``."""
    hot = F.col("n") * HOT > 2 * n_edges
    few = F.broadcast(least.where(hot).drop("n"))
    rest = edges.join(F.broadcast(least.where(hot).select(node)), node, "left_anti")
    return edges.join(few, node).unionByName(rest.join(least.where(~hot).drop("n"), node))


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return _with_least(both.where("b > a"), least, "a", n_edges).select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """``a`` < ``b``: every larger node's smaller neighbours go to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _with_least(edges, least, "b", n_edges).where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node.
    Loops, repeated and reversed edges and null ends are allowed (nulls link nothing)."""
    spark = edges.sparkSession
    tidy = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tidy = edges.where("a is null or b is null").limit(0).select("a", "b").unionByName(tidy.where("a < b").distinct())
    now, path = stash(tidy, "edges")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if seen == mark or seen["n"] == 0:
            break
        mark = seen
        new, new_path = stash(_small_star(_large_star(now, seen["n"]), seen["n"]), "edges")
        discard(spark, path)
        now, path = new, new_path
    roots = now.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("a").alias("component")))
