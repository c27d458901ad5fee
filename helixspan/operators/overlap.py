"""Interval joins. Intervals are (chrom, start, stop), 0-based and half-open.

The range condition becomes an equi-join on (chrom, tier, bin). A row goes into every bin it
covers at its own tier, where it covers 65 bins at most however long it is, and into those it
covers at the coarser tiers in use; a pair meets at the coarser of its two tiers and is kept in
the first bin both cover. So long intervals don't multiply, a hot chromosome is spread over its
bins, and no distinct is needed.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alleles as al
from ..functions import regions as rg

FAN = 64
TIERS = 5
WIDTH = 1024


def tiers_in_use(frames, width: int = WIDTH) -> int:
    sizes = [df.agg(F.max(F.col("stop") - F.col("start")).alias("n")) for df in frames]
    longest = sizes[0].unionByName(sizes[1]).agg(F.max("n")).first()[0] or 0
    tiers = 1
    while tiers < TIERS and longest > width * FAN**tiers:
        tiers += 1
    return tiers


def binned(df: DataFrame, width: int, tiers: int, pad: int, side: str) -> DataFrame:
    """A row for each bin, its columns but chrom as a_* or b_*; with tiers, `tier` is twice the tier, and one more where a's row is of a finer one.

    Rows that are both of finer tiers than a bin never share its key: they meet in bins of their own tiers.
    """
    lo, hi = F.col("start") - pad, F.greatest(F.col("stop") - 1, F.col("start")) + pad
    named = [F.col(c).alias(f"{side}_{c}") if c != "chrom" else F.col(c) for c in df.columns]
    if tiers == 1:
        return df.select(*named, F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))).alias("bin"))
    own = F.lit(0)
    for t in range(1, tiers):
        own = F.when(F.col("stop") - F.col("start") > width * FAN**t, t).otherwise(own)

    def level(t: int, finer_a: int) -> Column:
        size = width * FAN**t
        bins = F.sequence(F.floor(lo / size), F.floor(hi / size))
        keys = F.transform(bins, lambda b: F.struct(F.lit(2 * t + finer_a).alias("tier"), b.alias("bin")))
        here = (own == t if finer_a == 0 else own < t) if side == "a" else (own <= t if finer_a == 0 else own == t)
        return F.when(here, keys).otherwise(F.array().cast("array<struct<tier:int,bin:bigint>>"))

    keys = F.flatten(F.array(*[level(t, f) for t in range(tiers) for f in (0, 1) if t or not f]))
    return df.select(*named, F.explode(keys).alias("k")).select("*", F.col("k.tier").alias("tier"), F.col("k.bin").alias("bin")).drop("k")


def overlap_join(
    a: DataFrame, b: DataFrame, adjacent: bool = False, residual: Column | None = None, width: int = WIDTH, tiers: int | None = None
) -> DataFrame:
    """All pairs that overlap: chrom, then the other columns as a_* and b_*.

    adjacent: touching ends count too where either interval is empty (an insertion point).
    residual: a further condition on the a_* and b_* columns.
    """
    tiers = tiers or tiers_in_use((a, b), width)
    pad = 1 if adjacent else 0
    left, right = binned(a, width, tiers, pad, "a"), binned(b, width, tiers, pad, "b")
    ends = [F.col(c) for c in ("a_start", "a_stop", "b_start", "b_stop")]
    hit = (rg.overlaps_or_touches_insertion if adjacent else rg.overlaps)(*ends)
    size = F.lit(width) if tiers == 1 else F.element_at(F.array(*[F.lit(width * FAN**t) for t in range(tiers)]), F.shiftright("tier", 1) + 1)
    first = F.floor((F.greatest("a_start", "b_start") - pad) / size) == F.col("bin")
    keys = ["chrom", "bin"] if tiers == 1 else ["chrom", "tier", "bin"]
    out = left.join(right, keys).filter(hit & first)
    out = out if residual is None else out.filter(residual)
    return out.drop(*keys[1:])


def with_intersection(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"i_start": F.greatest("a_start", "b_start"), "i_stop": F.least("a_stop", "b_stop")})


def same_position() -> Column:
    return (F.col("a_start") == F.col("b_start")) & (F.col("a_stop") == F.col("b_stop"))


def equal_join(a: DataFrame, b: DataFrame, keys=("chrom", "start", "stop"), residual: Column | None = None) -> DataFrame:
    """Pairs that are equal in the keys; other columns as a_* and b_*."""
    side = lambda df, s: df.select(*[F.col(c) if c in keys else F.col(c).alias(f"{s}_{c}") for c in df.columns])
    out = side(a, "a").join(side(b, "b"), list(keys))
    return out if residual is None else out.filter(residual)


def equal_join_by(a: DataFrame, b: DataFrame, of: tuple[str, ...], residual: Column, keys=("chrom", "start", "stop")) -> DataFrame:
    """Pairs that are equal in the keys and meet a residual on the columns `of` of both sides, none of them null where it holds.

    The residual is looked at once for the values that occur at a place; rows of b then come with the values of a they
    meet, so that the join by these makes no pairs but those that are given.
    """
    keys = list(keys)
    named = lambda df, s: df.select(*[F.col(c) if c in keys else F.col(c).alias(f"{s}_{c}") for c in df.columns])
    of_a, of_b = ([f"{s}_{c}" for c in of] for s in "ab")
    left, right = named(a, "a"), named(b, "b")
    values = left.select(*keys, *of_a).distinct().join(right.select(*keys, *of_b).distinct(), keys).filter(residual)
    out = left.join(right.join(values, [*keys, *of_b]), [*keys, *of_a])
    return out.select(*left.columns, *[c for c in right.columns if c not in keys])


def partial_allele_match() -> Column:
    """References equal and the alternatives' IUPAC codes share a base; indels never match."""
    return (F.col("a_ref") == F.col("b_ref")) & al.masks_overlap(F.col("a_alt"), F.col("b_alt"))


def strand_agnostic_match(b_alleles: Column) -> Column:
    """Any allele of b as the reference, the others' bases joined, against a; on either strand."""

    def on(alleles: Column) -> Column:
        def as_ref(r, i):
            rest = F.filter(alleles, lambda x, j: i != j)
            return (F.col("a_ref") == r) & (al.combined_mask(rest).bitwiseAND(al.base_mask(F.col("a_alt"))) != 0)

        return F.exists(F.transform(alleles, as_ref), lambda x: x)

    return on(b_alleles) | on(F.transform(b_alleles, al.reverse_complement))


def hits(pairs: DataFrame, side: str, keys=("start", "stop")) -> DataFrame:
    """The distinct intervals of one side that stand in pairs."""
    return pairs.select("chrom", *[F.col(f"{side}_{k}").alias(k) for k in keys]).distinct()


def semi(df: DataFrame, pairs: DataFrame, side: str, keys=("start", "stop")) -> DataFrame:
    """Rows of df with a partner. A row's partners depend only on its keys, so rows need no ids."""
    return df.join(hits(pairs, side, keys), ["chrom", *keys], "left_semi")


def anti(df: DataFrame, pairs: DataFrame, side: str, keys=("start", "stop")) -> DataFrame:
    return df.join(hits(pairs, side, keys), ["chrom", *keys], "left_anti")
