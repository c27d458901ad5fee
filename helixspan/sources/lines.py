"""Lines with their numbers, and what is wrong with them, over files that many tasks read.

Spark reads a file in splits. A line's number is its place in its split, which the scan itself
gives, and the number of lines in the file's earlier splits, a row for each split. In the same way
whatever depends on the lines before (the last header, the row before) is taken inside a split
and carried over from the earlier ones, so no file is ever one task's.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.natkey import natural_key

_SPLIT = ("file", "split")


def _to(last: int, *keys: str, order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, last)


def numbered(spark: SparkSession, path) -> DataFrame:
    """(file, split, line, value): all lines, blank ones too; line counts from 1 in each file, split is where a split begins."""
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("_id"), "value"
    )
    # A split's lines follow each other in the scan, so their ids count up by one.
    splits = rows.groupBy(*_SPLIT).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(_to(-1, "file", order="split")), F.lit(0))
    splits = splits.select(*_SPLIT, "_first", before.alias("_before"))
    return rows.join(splits, list(_SPLIT)).select(*_SPLIT, (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line"), "value")


def running(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """rows (file, split, line, ...) with running sums of numbers along each file, a line's own among them."""
    inside = rows.withColumns({n: F.sum(x).over(_to(0, *_SPLIT, order="line")) for n, x in values.items()})
    splits = rows.groupBy(*_SPLIT).agg(*[F.sum(x).alias(n) for n, x in values.items()])
    carry = splits.select(*_SPLIT, *[F.coalesce(F.sum(n).over(_to(-1, "file", order="split")), F.lit(0)).alias(f"_{n}") for n in values])
    out = inside.join(carry, list(_SPLIT))
    return out.withColumns({n: F.col(n) + F.col(f"_{n}") for n in values}).drop(*[f"_{n}" for n in values])


def latest(rows: DataFrame, name: str, value: Column, own: bool = True) -> DataFrame:
    """rows with the last value that isn't null along its file: up to the line itself, or (own is false) before it."""
    v = F.struct(value.alias("v"))
    given = F.when(value.isNotNull(), v)
    inside = rows.withColumn("_in", F.last(given, ignorenulls=True).over(_to(0 if own else -1, *_SPLIT, order="line")))
    splits = rows.groupBy(*_SPLIT).agg(F.max_by(given, F.when(value.isNotNull(), F.col("line"))).alias("_v"))
    carry = splits.select(*_SPLIT, F.last("_v", ignorenulls=True).over(_to(-1, "file", order="split")).alias("_over"))
    out = inside.join(carry, list(_SPLIT))
    return out.withColumn(name, F.coalesce("_in", "_over")["v"]).drop("_in", "_over")


def data_lines(rows: DataFrame) -> DataFrame:
    return rows.filter((F.trim("value") != "") & ~F.startswith("value", F.lit("#")))


def sifted(rows: DataFrame, faults: list[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """(rows without a fault; file, line, reason and value of the others, by the first fault each has)."""
    reason = F.lit(None).cast("string")
    for test, text in reversed(faults):
        reason = F.when(F.coalesce(test, F.lit(True)), F.lit(text)).otherwise(reason)
    marked = rows.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL").select("file", "line", "reason", "value")


def _bed_fields(rows: DataFrame) -> DataFrame:
    f = F.split("value", "\t", -1)
    number = lambda i: F.get(f, F.lit(i)).try_cast("bigint")
    return rows.withColumns({"_fields": F.size(f), "chrom": F.get(f, F.lit(0)), "start": number(1), "stop": number(2)})


#: What can be wrong with a line of intervals, in the order in which it is looked for.
BED_FAULTS = ("no chromosome", "no start position", "no stop position", "stop before start", "not in order")


def checked_bed(spark: SparkSession, path, in_order: bool = False) -> tuple[DataFrame, DataFrame]:
    """(file, line, chrom, start, stop, value; bad lines as file, line, reason, value) of interval files.

    in_order: a line that lies wholly before the well-formed one before it in its file, by natural order of
    chromosomes, is bad too. Each split compares its own lines, and its first with the last one before the split.
    """
    rows = _bed_fields(data_lines(numbered(spark, path)))
    faults = [
        (F.col("chrom") == "", BED_FAULTS[0]), (F.col("start").isNull(), BED_FAULTS[1]), (F.col("stop").isNull(), BED_FAULTS[2]), (F.col("stop") < F.col("start"), BED_FAULTS[3]),
    ]
    good, bad = sifted(rows, faults)
    if in_order:
        key = natural_key(F.col("chrom"))
        seen = latest(good.withColumn("_key", key), "_last", F.struct(F.col("_key").alias("key"), "start"), own=False)
        late = (F.col("_key") < F.col("_last.key")) | ((F.col("_key") == F.col("_last.key")) & (F.col("start") < F.col("_last.start")) & (F.col("stop") <= F.col("_last.start")))
        good, more = sifted(seen, [(F.coalesce(late, F.lit(False)), BED_FAULTS[4])])
        bad = bad.unionByName(more)
    return good.select("file", "line", "chrom", "start", "stop", "value"), bad


#: The same for lines of variants.
VCF_FAULTS = ("fewer than 8 columns", "no position", "no quality", "no reference allele")


def checked_vcf(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(file, line, value; bad lines) of variant files: what their rows can't be read from."""
    f = F.split("value", "\t", -1)
    at = lambda i: F.get(f, F.lit(i))
    rows = data_lines(numbered(spark, path))
    good, bad = sifted(rows, [
        (F.size(f) < 8, VCF_FAULTS[0]), (at(1).try_cast("bigint").isNull(), VCF_FAULTS[1]), (~at(5).isin("", ".") & at(5).try_cast("double").isNull(), VCF_FAULTS[2]),
        (at(3).isin("", "."), VCF_FAULTS[3]),
    ])
    return good.select("file", "line", "value"), bad


def out_of_order(rows: DataFrame, key: Column) -> DataFrame:
    """rows (file, split, line, ...) whose key is less than that of the line before in its file."""
    return latest(rows.withColumn("_key", key), "_last", F.col("_key"), own=False).filter(F.col("_key") < F.col("_last")).drop("_key", "_last")
