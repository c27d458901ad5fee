"""Sample calls in long form: (site, ord, sample, gt, ft, dp, ...), and filters on them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import genotype as g


def blank_low_depth(calls: DataFrame, least: int = 0, depth: str = "dp") -> DataFrame:
    """Blanks calls whose depth is under the minimum or missing (even for a minimum of 0)."""
    low = F.coalesce(F.col(depth) < least, F.lit(True))
    return calls.withColumn("gt", F.when(~low, F.col("gt")))


def blank_filtered(calls: DataFrame, allowed: list[str] = ()) -> DataFrame:
    """Blanks calls whose whole filter text is neither missing, PASS nor in the list."""
    bad = g.is_filtered(F.col("ft")) & ~F.col("ft").isin(list(allowed)) if allowed else g.is_filtered(F.col("ft"))
    return calls.withColumn("gt", F.when(~bad, F.col("gt")))


def drop_empty_sites(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls of sites that have any call left."""
    some = calls.filter(F.col("gt").isNotNull()).select(*keys).distinct()
    return calls.join(some, keys, "left_semi")


def site_counters(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Per site: samples with data, with genotypes, evaluated (with a filter text) and failed."""
    seen = F.coalesce(~F.col("ft").isin("", "."), F.lit(False))
    return calls.groupBy(*keys).agg(
        F.count("*").alias("n_samples"),
        F.count_if(~g.is_empty(F.col("gt"))).alias("n_genotypes"),
        F.count_if(seen).alias("n_evaluated"),
        F.count_if(g.is_filtered(F.col("ft"))).alias("n_failed"),
    )


def site_filter_name(fraction: float) -> str:
    """Two significant digits of the percentage: 1.0 gives sf1e+02."""
    return "sf" + "%.2g" % (fraction * 100)


def site_filter_text(fraction: float) -> str:
    """What the header says of the site filter."""
    return f"More than {fraction * 100:g}% of the evaluated samples fail a filter"


def site_filter(calls: DataFrame, keys: list[str], fraction: float = 1.0) -> DataFrame:
    """Per site with any evaluated sample: the filter's name if failed / evaluated > fraction, else PASS."""
    n = site_counters(calls, keys).filter("n_evaluated > 0")
    bad = F.col("n_failed") / F.col("n_evaluated") > fraction
    return n.withColumn("filter", F.when(bad, site_filter_name(fraction)).otherwise("PASS"))


def add_filter(filters: Column, name: Column) -> Column:
    """The filters with one more, sorted; a PASS that was there before goes."""
    return F.array_sort(F.array_union(F.array_remove(filters, "PASS"), F.array(name)))


def valid_filter_name(name: str) -> str:
    if not name or any(c == ";" or c.isspace() for c in name):
        raise ValueError(f"bad filter name {name!r}")
    return name


def is_site_filtered(filters: Column, allowed: list[str] = ()) -> Column:
    return F.size(F.array_except(filters, F.array(*[F.lit(x) for x in ("PASS", ".", *allowed)]))) > 0


def filter_mode(ft: Column, mode: str) -> Column:
    """filtered, unfiltered or both."""
    if mode == "both":
        return F.lit(True)
    return g.is_filtered(ft) if mode == "filtered" else ~g.is_filtered(ft)


def priority_pick(calls: DataFrame, keys: list[str], how: str = "order", order: str = "source") -> DataFrame:
    """The primary call of each group: by order, unfiltered first, or filtered first."""
    bad = g.is_filtered(F.col("ft")).cast("int")
    rank = {"order": F.lit(0), "unfiltered": bad, "filtered": -bad}[how]
    best = F.min_by(F.struct(*[c for c in calls.columns if c not in keys]), F.struct(rank.alias("a"), F.col(order).alias("b")))
    return calls.groupBy(*keys).agg(best.alias("_c")).select(*keys, "_c.*")


def consensus(calls: DataFrame, keys: list[str], ratio: float, totals: DataFrame | None = None) -> DataFrame:
    """Per group: unfiltered calls that agree with the primary one, files that could call, and whether it passes.

    totals: (sample, total), the number of files declaring each sample; else the group's rows.
    """
    w = Window.partitionBy(*keys).orderBy("source")
    primary = F.first(g.canonical(F.col("gt")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    agree = (g.canonical(F.col("gt")) == primary) & ~g.is_filtered(F.col("ft"))
    out = calls.withColumn("_agree", F.coalesce(agree, F.lit(False))).groupBy(*keys).agg(F.count_if("_agree").alias("agreeing"), F.count("*").alias("rows"))
    out = out.join(totals, "sample", "left") if totals is not None else out.withColumn("total", F.col("rows"))
    return out.withColumn("passes", F.col("agreeing") / F.col("total") >= ratio).drop("rows")


def first_per_source(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds `kept`: whether the row is the first of its source within the group."""
    w = Window.partitionBy(*keys, "source").orderBy(*order)
    return rows.withColumn("kept", F.row_number().over(w) == 1)


def reheadered(samples: Column, names: list[str]) -> Column:
    """A map of samples as an array in the order of names; null where a sample is absent."""
    return F.array(*[F.try_element_at(samples, F.lit(n)) for n in names])


def mirrored(calls: DataFrame, source: int, tag: str) -> DataFrame:
    """The calls, with those of one source once more under their name and a suffix."""
    own = calls.filter(F.col("source") == source).withColumn("sample", F.concat("sample", F.lit(tag)))
    return calls.unionByName(own)


def renamed(calls: DataFrame, names: dict[str, str]) -> DataFrame:
    if not names:
        return calls
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return calls.withColumn("sample", F.coalesce(table[F.col("sample")], "sample"))
