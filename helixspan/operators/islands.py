"""Gaps and islands over sorted intervals: bundles, merges, run lengths.

A running maximum of the ends tells where an island begins. It runs inside blocks of the axis,
each a task's work, and takes up what the blocks before hold: their largest end, then the number
of their islands. What is carried is a row for each block, so no window holds a whole chromosome's
rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BLOCK = 1 << 20


def _carried(rows: DataFrame, keys: list[str], value: Column, name: str, how) -> DataFrame:
    """rows with value, an aggregate of each block, put together by `how` over all blocks before the row's own."""
    per_block = rows.groupBy(*keys, "_block").agg(value.alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    over = how("_v").over(w)
    per_block = per_block.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), over.alias(name))
    same = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(per_block, same, "left").drop("_b", *[f"_k{i}" for i in range(len(keys))])


def island_ids(
    df: DataFrame, distance: int | None = None, keys=("chrom",), order=(), name: str = "island", block: int = BLOCK
) -> DataFrame:
    """Adds the number of the row's island within its keys, from 1.

    distance: an island goes on while the gap is at most so long (0: touching rows merge).
    None: only rows that share bases, or that start at the island's own start, stay together.
    """
    keys = list(keys)
    order = [F.col("start"), F.col("stop"), *[F.col(c) for c in order]]
    rows = _carried(df.withColumn("_block", F.floor(F.col("start") / block)), keys, F.max("stop"), "_far", F.max)
    w = Window.partitionBy(*keys, "_block").orderBy(*order)
    far = F.greatest(F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), "_far")
    new = F.col("start") - far > distance if distance is not None else F.col("start") >= far
    rows = rows.withColumn("_new", F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0))
    rows = rows.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = _carried(rows, keys, F.sum("_new"), "_before", F.sum)
    return rows.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_new", "_block", "_far", "_before")


def merged(df: DataFrame, distance: int = 0, names: str | None = None, count: bool = False, same_name: str | None = None, block: int = BLOCK) -> DataFrame:
    """Merged intervals: chrom, start, stop, and on request sorted distinct names and row counts.

    same_name: only consecutive rows with an equal value merge (missing equals missing).
    """
    keys = ["chrom"]
    if same_name:
        own, place = F.struct(F.col(same_name).alias("v")), F.struct("start", "stop", same_name)
        df = _carried(df.withColumn("_block", F.floor(F.col("start") / block)), keys, F.max_by(own, place), "_last", F.last)
        order = Window.partitionBy("chrom", "_block").orderBy("start", "stop", F.col(same_name).asc_nulls_first())
        before = F.coalesce(F.lag(own).over(order), "_last")
        df = df.withColumn("_turn", F.when(before.isNull() | ~before["v"].eqNullSafe(F.col(same_name)), 1).otherwise(0))
        df = df.withColumn("_run", F.sum("_turn").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        df = _carried(df, keys, F.sum("_turn"), "_before", F.sum)
        df = df.withColumn("_run", F.col("_run") + F.coalesce("_before", F.lit(0))).drop("_before", "_turn", "_last", "_block")
        keys.append("_run")
    ids = island_ids(df, distance, keys, block=block)
    out = [F.min("start").alias("start"), F.max("stop").alias("stop")]
    if names:
        out.append(F.array_join(F.array_sort(F.collect_set(names)), ";").alias("names"))
    if same_name:
        out.append(F.first(same_name).alias("name"))
    if count:
        out.append(F.count("*").alias("n"))
    return ids.groupBy(*keys, "island").agg(*out).drop("island", "_run")


def bundle_stats(sizes: DataFrame, column: str = "n") -> DataFrame:
    n = F.col(column)
    return sizes.agg(F.count("*").alias("bundles"), F.max(n).alias("largest"), F.avg(n).alias("mean"), F.stddev_pop(n).alias("sd"))


def run_lengths(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal consecutive values: keys, value, run number, first and last of order[0], rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    turn = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = df.withColumn("_turn", turn).withColumn("run", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run", value).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n"))


def carried(value: Column, keys: list[str], order: list[str]) -> Column:
    """The last value that isn't null, up to the row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(w)


def unsorted_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows that come before their predecessor in locus order (a validator)."""
    w = Window.partitionBy("chrom").orderBy(*order)
    return df.withColumn("_before", F.lag("start").over(w)).filter(F.col("start") < F.col("_before")).drop("_before")
