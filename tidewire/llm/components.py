"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Edges, two numbers each, that one task takes with ease.
HUB_EDGES = 1 << 20

def with_least(edges: DataFrame, least: DataFrame, count: int) -> DataFrame:
    """``edges`` (a, b) with ``least`` (a, m, n: the edges of a) of their a.

    There are ``count`` edges or twice that, so few nodes have a five-hundredth of them: these are broadcast, and
    no task gets all edges of a hub.  Below ``HUB_EDGES`` edges a task may well get them all.
    """
    if count <= HUB_EDGES:
        return edges.join(least.select("a", "m"), "a")
    hot = F.broadcast(least.where(F.col("n") > max(1000, count // 500)).select("a", "m"))
    return edges.join(hot, "a").unionByName(edges.join(hot, "a", "left_anti").join(least.select("a", "m"), "a"))


def connected_components(edges: DataFrame, scratch: Scratch, name: str, max_rounds: int = 60) -> DataFrame:
    """Label each node of ``edges`` (a, b: bigint) with the smallest node that it can reach.

    Returns (node, component), a row for each node of an edge between two different nodes; null ends are ignored.
    Each round is two aggregations and joins over a table no larger than the edges, written to the shared
    folder; nothing is collected but the sums that tell the end.  Rounds grow with the logarithm of the longest path.
    """
    edges = edges.select("a", "b").where("a <> b").distinct()
    current = scratch.save(edges, f"{name}-0")
    before, count = None, current.count()
    for i in range(1, max_rounds + 1):
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        # large star: every larger neighbour goes to the smallest one
        large = with_least(both.where("b > a"), least, count).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every smaller neighbour, and the node itself, goes to the smallest
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        hung = with_least(down, low, count)
        small = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        current = scratch.save(small, f"{name}-{i}")
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{i - 1}")
        if now == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(current.select("b", "b")).distinct()
        before, count = now, now[0]
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
