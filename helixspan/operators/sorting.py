"""Sort, union, distinct and best-of-group in natural order. Ties go by a given ordinal."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.natkey import locus_order


def sorted_union(frames: list[DataFrame], ordinal: str | None = None, unique: bool = False, allele: str = "alleles") -> DataFrame:
    """All rows in natural locus order; unique keeps the first row of each position and allele text."""
    rows = union_all(frames)
    if unique:
        rows = distinct_loci(rows, allele, [ordinal] if ordinal else [])
    key, *rest = locus_order()
    rows = rows.withColumn("_key", key)  # once for each row: sampling, dealing out and sorting then read it
    return rows.orderBy("_key", *rest, *([F.col(ordinal)] if ordinal else [])).drop("_key")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("source", F.lit(i)) if "source" not in f.columns else f for i, f in enumerate(frames)])


def distinct_loci(df: DataFrame, allele: str = "alleles", order: list[str] = ()) -> DataFrame:
    """The first row of each (chrom, start, stop, allele text); a missing allele is the empty text."""
    key = [F.col("chrom"), F.col("start"), F.col("stop"), F.coalesce(F.col(allele), F.lit(""))]
    if not order:
        return df.withColumn("_a", key[3]).dropDuplicates(["chrom", "start", "stop", "_a"]).drop("_a")
    return first_of(df, key, [F.col(c) for c in order])


def first_of(df: DataFrame, keys: list, order: list, name: str | None = None) -> DataFrame:
    """The first row of each group; an aggregate, so rows shrink before the shuffle."""
    picked = df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(map(_col, keys))]).agg(
        F.min_by(F.struct(*df.columns), F.struct(*[_col(o).alias(f"o{i}") for i, o in enumerate(order)])).alias("_row")
    )
    return picked.select("_row.*")


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def ranked(df: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
