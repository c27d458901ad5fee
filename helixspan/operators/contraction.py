"""Connected components of any size, by stars: no component, and no node's neighbours, are ever one row or one task's.

An edge joins two numbers. In turns, every node's larger neighbours are linked to the least of its
neighbourhood (large stars), then its smaller ones and itself (small stars), until every edge ends at
its component's least number. Both steps are a least-of-group with partial sums and a join; rows are cut off from
their history by a table in the shared folder after each round, and the number of rounds grows with the
logarithm of the longest chain.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """edges (a, b) with b < a."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least number reachable over edges (a, b), for every number in an edge but the least ones themselves."""
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        after = staged(_small(_large(now)), "edges")
        # Stars on the least numbers: no node has two links, and none that is linked to is linked itself.
        tails = after.groupBy("a").count().filter("count > 1").select("a")
        if tails.isEmpty() and after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("component"))
        now = after
