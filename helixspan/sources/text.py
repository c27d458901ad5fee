"""Readers of tab-separated interval, position, sequence, signal and alignment text.

All are lazy scans of spark.read.text with column expressions; compressed files are read as
Spark reads them. Lines that are blank or begin with # are skipped where the format says so.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alleles import plain
from . import lines


def _lines(spark: SparkSession, path, comments: bool = True) -> DataFrame:
    rows = spark.read.text(path).filter(F.trim("value") != "")
    return rows.filter(~F.startswith("value", F.lit("#"))) if comments else rows


def read_bed(spark: SparkSession, path, max_extra: int = -1) -> DataFrame:
    """chrom, start, stop, extra array<string>, line. The first extra column is upper-cased, its null alleles `*`."""
    f = F.split("value", "\t", -1)
    extra = F.slice(f, F.lit(4), F.greatest(F.size(f) - 3, F.lit(0)))
    extra = F.slice(extra, 1, max_extra) if max_extra >= 0 else extra
    allele = F.regexp_replace(F.regexp_replace(F.upper(F.get(extra, F.lit(0))), "^[0-](?=/)", "*"), "(?<=/)[0-]$", "*")
    fixed = F.when(F.size(extra) > 0, F.concat(F.array(allele), F.slice(extra, F.lit(2), F.size(extra)))).otherwise(extra)
    return _lines(spark, path).select(
        F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).cast("bigint").alias("start"), F.get(f, F.lit(2)).cast("bigint").alias("stop"),
        fixed.alias("extra"), F.col("value").alias("line"),
    )


def alleles_of(extra: Column) -> Column:
    """struct(ref, alt) of a row's extra columns; missing alleles are empty."""
    both = F.split(F.coalesce(F.try_element_at(extra, F.lit(1)), F.lit("*/*")), "/")
    one = lambda i: plain(F.coalesce(F.try_element_at(both, F.lit(i)), F.lit("*")))
    return F.struct(one(1).alias("ref"), one(2).alias("alt"))


def as_variants(bed: DataFrame) -> DataFrame:
    """Adds ref, alt, quality and depth from the extra columns; missing alleles are empty, missing numbers 0."""
    alleles = alleles_of(F.col("extra"))
    number = lambda i, t: F.coalesce(F.try_element_at("extra", F.lit(i)).try_cast(t), F.lit(0).cast(t))
    return bed.withColumns({
        "ref": alleles["ref"], "alt": alleles["alt"],
        "alleles": F.try_element_at("extra", F.lit(1)), "quality": number(2, "double"), "depth": number(3, "int"),
    })


def read_positions(spark: SparkSession, path) -> DataFrame:
    """Any tab file keyed by chromosome and position: chrom, start, stop (the same), line."""
    f = F.split("value", "\t", -1)
    at = F.get(f, F.lit(1)).cast("bigint")
    return _lines(spark, path).select(F.get(f, F.lit(0)).alias("chrom"), at.alias("start"), at.alias("stop"), F.col("value").alias("line"))


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """(name, seq, length): one row per record, line breaks removed."""
    rows = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    head = F.regexp_extract("value", r"^\s*([^\s]+)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return rows.select(head.alias("name"), body.alias("seq")).withColumn("length", F.length("seq").cast("bigint"))


def fasta_index(seqs: DataFrame) -> DataFrame:
    """(name, length); never written beside the input."""
    return seqs.select("name", "length")


def read_wiggle(spark: SparkSession, path) -> DataFrame:
    """Points (file, split, block, ord, chrom, start, step, span, value, at) of fixedStep tracks; variableStep is an error.

    at is the point's own place from 0. Files are read in splits: the header in force and the number of values
    since it are carried from one split to the next.
    """
    rows = lines.numbered(spark, path)
    mark = F.regexp_extract("value", "^(track|fixedStep|variableStep|browser|#)", 1)
    rows = rows.filter(F.trim("value") != "").withColumn("_mark", F.when(mark == "variableStep", F.raise_error(F.lit("variableStep tracks aren't supported")).cast("string")).otherwise(mark))
    rows = lines.running(rows, {"_number": (F.col("_mark") != "").cast("bigint"), "_values": (F.col("_mark") == "").cast("bigint")})
    head = F.when(F.col("_mark") == "fixedStep", F.struct(F.col("value").alias("text"), F.col("_values").alias("before")))
    rows = lines.latest(rows, "_head", head).filter(F.col("_mark") == "")
    get = lambda k, d: F.coalesce(F.nullif(F.regexp_extract("_head.text", rf"\b{k}=(\S+)", 1), F.lit("")), F.lit(d))
    out = rows.select(
        "file", "split", F.concat_ws("#", "file", F.col("_number").cast("string")).alias("block"), F.col("line").alias("ord"), get("chrom", "").alias("chrom"),
        get("start", "1").cast("bigint").alias("start"), get("step", "1").cast("bigint").alias("step"),
        get("span", "1").cast("bigint").alias("span"), F.trim("value").cast("double").alias("value"), (F.col("_values") - F.col("_head.before") - 1).alias("_n"),
    )
    return out.withColumn("at", F.col("start") - 1 + F.col("_n") * F.col("step")).drop("_n")


def read_sam(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def read_pairs(path: str, separator: str = "=") -> dict[str, str]:
    """A small key=value file; read on the driver."""
    out = {}
    with open(path) as f:
        for line in f:
            line = line.strip()
            if line and not line.startswith("#"):
                key, sep, value = line.partition(separator)
                if not sep:
                    raise ValueError(f"no {separator!r} in {line!r}")
                out[key.strip()] = value.strip()
    return out


def kind_of(spark: SparkSession, path) -> str:
    """vcf, bed, positions, empty or unknown, from the first lines; the VCF mark is looked for first."""
    rows = [r[0] for r in spark.read.text(path).limit(200).collect()]
    if any(r.startswith("##fileformat=VCF") for r in rows):
        return "vcf"
    data = [r for r in rows if r.strip() and not r.startswith("#")]
    if not data:
        return "empty"
    f = data[0].split("\t")
    number = lambda i: len(f) > i and f[i].lstrip("-").isdigit()
    return "bed" if number(1) and number(2) else "positions" if number(1) else "unknown"


def random_intervals(spark: SparkSession, n: int = 100, seed: int = 0, indels: float = 0.08, longest: int = 20, chroms: int = 21) -> DataFrame:
    """n random rows (chrom, start, stop, alleles); a share of them indels."""
    rows = spark.range(n).select(
        (F.floor(F.rand(seed) * chroms) + 1).cast("string").alias("chrom"), F.floor(F.rand(seed + 1) * 100_000_000).alias("start"),
        (F.rand(seed + 2) < indels).alias("indel"), (F.floor(F.rand(seed + 3) * longest) + 1).cast("int").alias("size"),
        F.rand(seed + 4).alias("r"), F.floor(F.rand(seed + 5) * 4).cast("int").alias("x"), F.floor(F.rand(seed + 6) * 3).cast("int").alias("y"),
        F.rand(seed + 7).alias("z"),
    )
    base = lambda i: F.substr(F.lit("ACGT"), i + 1, F.lit(1))
    bases = F.array_join(F.transform(F.sequence(F.lit(1), "size"), lambda i: base(F.pmod(F.xxhash64("z", i), F.lit(4)).cast("int"))), "")
    gone = F.col("indel") & (F.col("r") < 0.5)
    alleles = F.when(gone, F.concat(bases, F.lit("/*"))).when(F.col("indel"), F.concat(F.lit("*/"), bases)).otherwise(
        F.concat(base(F.col("x")), F.lit("/"), base(F.pmod(F.col("x") + F.col("y") + 1, F.lit(4))))
    )
    width = F.when(gone, F.col("size")).when(F.col("indel"), 0).otherwise(1)
    return rows.select("chrom", "start", (F.col("start") + width).alias("stop"), alleles.alias("alleles"))
