"""n-way comparison of calls by file bit masks.

calls: (bundle, source, record, sample, alleles array<string>, has_null boolean): a call's
alleles as trimmed variant texts; bundle groups records that overlap. source is a file number.
Masks are sums of 1 << source for fewer than 63 files, and for any number of files arrays of
words with 63 files each (words: how many; None for plain numbers).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DENSE = 20
WORD = 63


def words_for(n_files: int) -> int | None:
    """Words of a mask; None where a plain number holds it."""
    return None if n_files < WORD else -(-n_files // WORD)


def _bit(words: int | None = None, source="source") -> Column:
    left = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n)
    if words is None:
        return left(F.col(source))
    at = F.floor(F.col(source) / WORD)
    return F.array(*[F.when(at == w, left((F.col(source) % WORD).cast("int"))).otherwise(F.lit(0).cast("bigint")) for w in range(words)])


def _word(mask: Column, w: int) -> Column:
    return F.get(mask, F.lit(w))


def any_of(mask: Column, words: int | None = None) -> Column:
    """Aggregate: the files of any row's mask."""
    return F.bit_or(mask) if words is None else F.array(*[F.bit_or(_word(mask, w)) for w in range(words)])


def without(a: Column, b: Column, words: int | None = None) -> Column:
    """The files of a that b doesn't have."""
    one = lambda x, y: x.bitwiseAND(F.bitwise_not(y))
    return one(a, b) if words is None else F.array(*[one(_word(a, w), _word(b, w)) for w in range(words)])


def holds(a: Column, b: Column, words: int | None = None) -> Column:
    """Whether a has all files of b."""
    one = lambda x, y: x.bitwiseAND(y) == y
    if words is None:
        return one(a, b)
    out = F.lit(True)
    for w in range(words):
        out = out & one(_word(a, w), _word(b, w))
    return out


def flags(mask: Column, n_files: int) -> Column:
    """0 or 1 for each file, in their order."""
    words = words_for(n_files)
    word = (lambda i: mask) if words is None else (lambda i: F.get(mask, F.floor(i / WORD).cast("int")))
    return F.transform(F.sequence(F.lit(0), F.lit(n_files - 1)), lambda i: F.call_function("shiftright", word(i), (i % WORD).cast("int")).bitwiseAND(F.lit(1).cast("bigint")).cast("int"))


def partial_matches(calls: DataFrame, words: int | None = None) -> DataFrame:
    """(bundle, sample, allele, mask): the files that have the allele."""
    rows = calls.select("bundle", "sample", "source", "record", F.explode(F.array_distinct("alleles")).alias("allele"), _bit(words).alias("_bit"))
    return rows.groupBy("bundle", "sample", "allele").agg(any_of(F.col("_bit"), words).alias("mask"), F.count_distinct("source", "record").alias("rows"))


def exact_matches(calls: DataFrame, words: int | None = None) -> DataFrame:
    """(bundle, sample, alleles, mask): the files that have the same genotype; calls with a null allele have none."""
    rows = calls.filter(~F.col("has_null")).withColumns({"genotype": F.array_sort("alleles"), "_bit": _bit(words)})
    return rows.groupBy("bundle", "sample", "genotype").agg(any_of(F.col("_bit"), words).alias("mask"))


def misses(calls: DataFrame, words: int | None = None) -> DataFrame:
    """(bundle, sample, allele, mask, kind): alleles of a single record, partial_miss if that record matched otherwise."""
    alleles = calls.select("bundle", "sample", "source", "record", F.explode(F.array_distinct("alleles")).alias("allele"))
    n = alleles.groupBy("bundle", "sample", "allele").agg(F.count("*").alias("rows"))
    tagged = alleles.join(n, ["bundle", "sample", "allele"])
    matched = tagged.groupBy("bundle", "sample", "source", "record").agg(F.max((F.col("rows") > 1).cast("int")).alias("hit"))
    lone = tagged.filter("rows = 1").join(matched, ["bundle", "sample", "source", "record"])
    kind = F.when(F.col("hit") == 1, "partial_miss").otherwise("complete_miss")
    return lone.select("bundle", "sample", "allele", _bit(words).alias("mask"), kind.alias("kind"))


def mask_counts(calls: DataFrame, words: int | None = None) -> DataFrame:
    """(kind, mask, sample, n) for partial_match, exact_match, partial_miss and complete_miss; only masks that occur."""
    one = lambda df, kind: df.groupBy("mask", "sample").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "mask", "sample", "n")
    lost = misses(calls, words).groupBy("kind", "mask", "sample").agg(F.count("*").alias("n"))
    return one(partial_matches(calls, words), "partial_match").unionByName(one(exact_matches(calls, words), "exact_match")).unionByName(lost)


def dense_table(counts: DataFrame, n_files: int, samples: list[str]) -> DataFrame:
    """Every mask and kind, zeros included, with a column for each sample."""
    if n_files > MAX_DENSE:
        raise ValueError(f"a dense table has 2^n - 1 rows; at most {MAX_DENSE} files, or sparse_table for any number")
    spark = counts.sparkSession
    kinds = F.explode(F.array(*[F.lit(k) for k in ("exact_match", "partial_match", "partial_miss", "complete_miss")]))
    grid = spark.range(1, 1 << n_files).select(F.col("id").alias("mask"), kinds.alias("kind"))
    wide = counts.groupBy("kind", "mask").pivot("sample", samples).agg(F.sum("n"))
    bits = F.lpad(F.bin("mask"), n_files, "0")
    return grid.join(wide, ["kind", "mask"], "left").fillna(0, samples).withColumn("files", bits)


def sparse_table(counts: DataFrame, n_files: int, samples: list[str]) -> DataFrame:
    """The rows of the dense table whose mask occurs, for any number of files."""
    wide = counts.groupBy("kind", "mask").pivot("sample", samples).agg(F.sum("n")).fillna(0, samples)
    return wide.withColumn("files", F.array_join(F.reverse(flags(F.col("mask"), n_files)), ""))


def at_least(counts: DataFrame, n_files: int) -> DataFrame:
    """counts with n_at_least: what the masks that have at least a mask's files count together, for each kind and sample.

    A mask meets those that have the rarest of its own files, by the number of masks with it, and is compared with these alone.
    """
    words = words_for(n_files)
    files = F.filter(F.transform(flags(F.col("mask"), n_files), lambda x, i: F.when(x == 1, i)), lambda x: x.isNotNull())
    listed = counts.select("kind", "sample", "mask", "n", F.explode(files).alias("file"))
    often = listed.groupBy("kind", "sample", "file").agg(F.count("*").alias("masks"))
    rarest = listed.join(often, ["kind", "sample", "file"]).groupBy("kind", "sample", "mask", "n").agg(F.min_by("file", F.struct("masks", "file")).alias("file"))
    other = listed.select("kind", "sample", "file", F.col("mask").alias("_mask"), F.col("n").alias("_n"))
    met = rarest.join(other, ["kind", "sample", "file"]).filter(holds(F.col("_mask"), F.col("mask"), words))
    return met.groupBy("kind", "sample", "mask", "n").agg(F.sum("_n").alias("n_at_least"))


def match_vectors(calls: DataFrame, n_files: int) -> DataFrame:
    """Per record and sample: 0/1 by file for exact matches, and for partial ones that aren't exact."""
    words = words_for(n_files)
    none = F.lit(0).cast("bigint")
    none = none if words is None else F.array(*[none] * words)
    exact = exact_matches(calls, words).withColumnRenamed("mask", "exact_mask")
    partial = partial_matches(calls, words).select("bundle", "sample", "allele", F.col("mask").alias("partial_mask"))
    rows = calls.withColumn("genotype", F.when(~F.col("has_null"), F.array_sort("alleles")))
    rows = rows.join(exact, ["bundle", "sample", "genotype"], "left").withColumn("exact_mask", F.coalesce("exact_mask", none))
    rows = rows.select("*", F.explode("alleles").alias("allele")).join(partial, ["bundle", "sample", "allele"])
    # A record's exact mask is the same in all its rows.
    out = rows.groupBy("bundle", "sample", "source", "record").agg(any_of(F.col("exact_mask"), words).alias("e"), any_of(F.col("partial_mask"), words).alias("p"))
    return out.select(
        "bundle", "sample", "source", "record", flags(F.col("e"), n_files).alias("exact"), flags(without(F.col("p"), F.col("e"), words), n_files).alias("partial")
    )
