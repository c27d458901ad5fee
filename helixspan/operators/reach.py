"""Semi and anti interval joins, and partner counts, without any pairs.

An interval [s, e) meets a row of b exactly if some row of b that starts before e ends after s,
that is, if the largest end among the rows that start before e is beyond s. That largest end is a
running maximum along the axis, as the numbers of starts and ends up to a place are running sums.
Both are taken over the distinct places of each block of the axis, a bounded number of rows however deep the
rows lie, and what the blocks before hold is carried to a block by one row. Each row of a then looks
up its own place; nothing is ever multiplied.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a block: the most rows that one window holds.
BLOCK = 1 << 16

_FROM_FIRST = (Window.unboundedPreceding, 0)
_BEFORE = (Window.unboundedPreceding, -1)


def _carried(places: DataFrame, columns: dict[str, tuple[str, Column, bool]], block: int) -> DataFrame:
    """places (chrom, pos, ...), a row for each place, with running aggregates along each chromosome.

    columns: name -> (max or sum, of what, whether the place itself counts).
    """
    put = {"max": (F.max, lambda a, b: F.greatest(a, b)), "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))}
    p = places.withColumn("_block", F.floor(F.col("pos") / block))
    inside = Window.partitionBy("chrom", "_block").orderBy("pos")
    p = p.withColumns({f"_{n}": put[how][0](x).over(inside.rowsBetween(*(_FROM_FIRST if own else _BEFORE))) for n, (how, x, own) in columns.items()})
    sums = places.withColumn("_block", F.floor(F.col("pos") / block)).groupBy("chrom", "_block").agg(*[put[how][0](x).alias(n) for n, (how, x, _) in columns.items()])
    along = Window.partitionBy("chrom").orderBy("_block").rowsBetween(*_BEFORE)  # a row for each block in use
    carry = sums.select("chrom", "_block", *[put[how][0](n).over(along).alias(f"{n}_c") for n, (how, _, _) in columns.items()])
    p = p.join(carry, ["chrom", "_block"])
    return p.select("chrom", "pos", *[put[how][1](F.col(f"_{n}"), F.col(f"{n}_c")).alias(n) for n, (how, _, _) in columns.items()])


def reach(a: DataFrame, b: DataFrame, block: int = BLOCK) -> DataFrame:
    """(chrom, pos, far, far_at, point): for each end of a, what b holds up to it.

    far: the largest end of rows of b that start before pos; far_at: of those that start at pos or before;
    point: the last place of an empty row of b at pos or before.
    """
    ends = a.select("chrom", F.col("stop").alias("pos"), F.lit(None).cast("bigint").alias("end"), F.lit(None).cast("bigint").alias("point"), F.lit(True).alias("asked"))
    starts = b.select("chrom", F.col("start").alias("pos"), F.col("stop").alias("end"), F.when(F.col("start") == F.col("stop"), F.col("start")).alias("point"), F.lit(False).alias("asked"))
    places = ends.unionByName(starts).filter(F.col("chrom").isNotNull() & F.col("pos").isNotNull()).groupBy("chrom", "pos").agg(
        F.max("end").alias("end"), F.max("point").alias("point"), F.max("asked").alias("asked"))
    found = _carried(places, {"far": ("max", F.col("end"), False), "far_at": ("max", F.col("end"), True), "point": ("max", F.col("point"), True), "asked": ("max", F.when(F.col("asked"), F.col("pos")), True)}, block)
    return found.filter(F.col("asked") == F.col("pos")).drop("asked")


def meeting(a: DataFrame, b: DataFrame, adjacent: bool = False, block: int = BLOCK) -> DataFrame:
    """a with `_met`, whether a row overlaps a row of b; adjacent: touching counts too where either is empty. Null places meet nothing."""
    found = reach(a, b, block).withColumnsRenamed({"chrom": "_chrom", "pos": "_pos", "far": "_far", "far_at": "_far_at", "point": "_point"})
    empty = F.col("start") == F.col("stop")
    if adjacent:
        met = F.when(empty, F.col("_far_at") >= F.col("start")).otherwise((F.col("_far") > F.col("start")) | F.coalesce(F.col("_point") >= F.col("start"), F.lit(False)))
    else:
        met = (F.col("_far") > F.col("start")) | (empty & F.coalesce(F.col("_point") == F.col("start"), F.lit(False)))
    out = a.join(found, (F.col("chrom") == F.col("_chrom")) & (F.col("stop") == F.col("_pos")), "left")
    return out.select(*a.columns, F.coalesce(met, F.lit(False)).alias("_met"))


def semi(a: DataFrame, b: DataFrame, adjacent: bool = False) -> DataFrame:
    """Rows of a that overlap a row of b; repeated rows stay."""
    return meeting(a, b, adjacent).filter("_met").drop("_met")


def anti(a: DataFrame, b: DataFrame, adjacent: bool = False) -> DataFrame:
    return meeting(a, b, adjacent).filter("not _met").drop("_met")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side without a partner, with their side."""
    cols = ["chrom", "start", "stop"]
    return anti(a.select(*cols), b).withColumn("side", F.lit("a")).unionByName(anti(b.select(*cols), a).withColumn("side", F.lit("b")))


def partner_counts(a: DataFrame, b: DataFrame, block: int = BLOCK) -> DataFrame:
    """a with n, the number of rows of b that overlap it: starts before its end less ends up to its start."""
    b = b.filter(F.col("start").isNotNull() & F.col("stop").isNotNull())
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    parts = [
        b.select("chrom", F.col("start").alias("pos"), one.alias("starts"), none.alias("ends"), (F.col("start") == F.col("stop")).cast("bigint").alias("points")),
        b.select("chrom", F.col("stop").alias("pos"), none.alias("starts"), one.alias("ends"), none.alias("points")),
        *[a.select("chrom", F.col(c).alias("pos"), none.alias("starts"), none.alias("ends"), none.alias("points")) for c in ("start", "stop")],
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    places = every.filter(F.col("chrom").isNotNull() & F.col("pos").isNotNull()).groupBy("chrom", "pos").agg(*[F.sum(c).alias(c) for c in ("starts", "ends", "points")])
    # points: empty rows at this very place
    found = _carried(places, {"starts": ("sum", F.col("starts"), False), "ends": ("sum", F.col("ends"), True)}, block).join(places.select("chrom", "pos", "points"), ["chrom", "pos"])
    at = lambda c: found.select(F.col("chrom").alias("_chrom"), F.col("pos").alias("_pos"), *[F.col(x).alias(f"_{x}") for x in c])
    upto, before = at(["ends", "points"]), at(["starts"]).withColumnsRenamed({"_chrom": "_chrom2", "_pos": "_pos2"})
    out = a.join(upto, (F.col("chrom") == F.col("_chrom")) & (F.col("start") == F.col("_pos")), "left")
    out = out.join(before, (F.col("chrom") == F.col("_chrom2")) & (F.col("stop") == F.col("_pos2")), "left")
    n = F.col("_starts") - F.col("_ends") + F.when(F.col("start") == F.col("stop"), 2 * F.col("_points")).otherwise(0)
    return out.select(*a.columns, F.coalesce(n, F.lit(0)).cast("bigint").alias("n"))
