"""Text sinks. A sink's folder holds parts whose names are in the order of their rows, each written by a task of its own.

The rows are dealt out by ranges of the order, so the parts one after another are the ordered file; a header
is the first rows of that order, and so stands once, at the beginning of the first part. Order is a matter of the sink,
never of operators.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.natkey import locus_order, natural_key
from .vcf import Header, rendered


def bed_lines(rows: DataFrame, columns: list[str] = ()) -> DataFrame:
    """The raw line where the row still has one, else its columns joined by tabs."""
    built = F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("stop").cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in columns])
    line = F.coalesce("line", built) if "line" in rows.columns else built
    return rows.orderBy(*locus_order()).select(line.alias("value"))


def write_bed(rows: DataFrame, path: str, columns: list[str] = ()) -> None:
    bed_lines(rows, columns).write.mode("overwrite").text(path)


def _body(rows: DataFrame, header: Header, *keep: str) -> DataFrame:
    return rendered(rows, header, keep).select(*keep, F.lit(1).alias("part"), natural_key(F.col("chrom")).alias("k"), "pos", F.lit(0).alias("n"), "line")


def vcf_lines(rows: DataFrame, header: Header) -> DataFrame:
    """Header lines, then rows in natural order."""
    spark = rows.sparkSession
    head = spark.createDataFrame([(i, line) for i, line in enumerate(header.render())], "n int, line string")
    top = head.select(F.lit(0).alias("part"), F.lit("").alias("k"), F.lit(0).cast("bigint").alias("pos"), "n", "line")
    return top.unionByName(_body(rows, header)).orderBy("part", "k", "pos", "n", "line").select(F.col("line").alias("value"))


def write_vcf(rows: DataFrame, header: Header, path: str) -> None:
    vcf_lines(rows, header).write.mode("overwrite").text(path)


def write_by_source(rows: DataFrame, header: Header, path: str) -> None:
    """A folder for each source, with its header and its rows in natural order. A source of many rows has several parts."""
    head = F.explode(F.array(*[F.struct(F.lit(i).alias("n"), F.lit(line).alias("line")) for i, line in enumerate(header.render())])).alias("h")
    top = rows.select("source").distinct().select("source", head).select("source", F.lit(0).alias("part"), F.lit("").alias("k"), F.lit(0).cast("bigint").alias("pos"), "h.n", "h.line")
    ordered = top.unionByName(_body(rows, header, "source")).orderBy("source", "part", "k", "pos", "n", "line")
    ordered.select("source", F.col("line").alias("value")).write.mode("overwrite").partitionBy("source").text(path)


def write_fasta(seqs: DataFrame, path: str, wrap: int = 60) -> None:
    body = F.regexp_replace("seq", f"(.{{{wrap}}})(?=.)", "$1\n")
    seqs.select(F.concat(F.lit(">"), "name", F.lit("\n"), body).alias("value")).write.mode("overwrite").text(path)


def write_report(rows: DataFrame, path: str) -> None:
    """Tab-separated tables with column names at the head of each part, as spark.read.csv takes them."""
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
