"""Connected components of an edge list, by alternating stars over tables.

Every round first contracts the edges inside each partition (union-find in bounded memory: the
partition's own edges), then lets each node hand its larger neighbours to its smallest one
(large star) and its smaller ones likewise (small star), until the edges form stars around the
smallest node of each component. No edges are collected; rounds are cut by tables in the shared
folder, and their number grows with the logarithm of the longest path.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, drop_dir, stage

DDL = "u bigint, v bigint"
TASK_EDGES = 100_000


def contracted(edges: DataFrame) -> DataFrame:
    """In each partition, every node of a component with its smallest node there: (u larger, v smallest)."""
    target = arrow_schema(edges.sparkSession, DDL)

    def run(batches):
        parent: dict[int, int] = {}

        def root(x):
            top = x
            while parent[top] != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = np.fromiter(parent, np.int64, len(parent))
        tops = np.fromiter(map(root, parent), np.int64, len(parent))
        keep = nodes != tops
        for i in range(0, len(nodes), 65536):
            k = keep[i : i + 65536]
            cols = (nodes[i : i + 65536][k], tops[i : i + 65536][k])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=target)

    return edges.select("u", "v").mapInArrow(run, DDL)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the smallest node it can reach."""
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    spark = edges.sparkSession
    pairs = stage(pairs, "edges")
    tasks = -(-pairs.count() // TASK_EDGES)
    if tasks <= 1:  # one task's union-find is then all there is to do
        done = stage(contracted(pairs.coalesce(1)), "components")
        return done.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(_tops(done))
    current, state = stage(contracted(pairs.repartition(tasks, "v")), "components"), None
    for _ in range(rounds):
        nxt = stage(_star(_star(contracted(current), True), False), "components")
        drop_dir(spark, current._staged_at)
        current = nxt
        got = current.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if tuple(got) == state:
            break
        state = tuple(got)
    else:
        raise RuntimeError("components didn't settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(_tops(current))


def _tops(stars: DataFrame) -> DataFrame:
    """Each component's smallest node with itself."""
    return stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
