"""Connected components by repeated joins, for links that fit no single machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): smallest node reachable over ``links`` (a, b), for all linked nodes.

    Alternates two steps until nothing changes: every node hands its larger
    neighbours to its smallest one, then its smaller neighbours. Each step is one
    aggregate and one join; a node with very many neighbours is aggregated before the
    shuffle and its join side is split by Spark where it is skewed. The number of steps
    grows with the logarithm of the longest path. Each step's table is written, so lost
    executors cost only tasks.
    """
    def pairs(df: DataFrame) -> DataFrame:
        return df.filter("a <> b").distinct()

    def towards_smallest(edges: DataFrame, larger_only: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not larger_only:
            both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        moved = both.join(least, "a")
        if larger_only:
            return pairs(moved.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")))
        return pairs(moved.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b"))))

    def sums(edges: DataFrame):
        wide = [F.sum(F.xxhash64(F.lit(salt), "a", "b").cast("decimal(38,0)")) for salt in (1, 2)]
        return edges.agg(F.count("*"), *wide).first()

    edges = scratch.store(pairs(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "links")
    seen = sums(edges)
    while True:
        wide = scratch.store(towards_smallest(edges, True), "links")
        small = scratch.store(towards_smallest(wide, False), "links")
        now = sums(small)
        scratch.drop(edges, wide)
        edges = small
        if now == seen:
            break
        seen = now
    found = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = edges.select(F.col("b").alias("node")).distinct().join(found, "node", "left_anti")
    return found.unionByName(roots.select("node", F.col("node").alias("component")))
