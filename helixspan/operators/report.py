"""Call-set metrics per site and per sample, from calls (site, sample, gt, ft) and sites.

sites: (site, ref, alts[, info...]); calls: long form. Rarity classes and Ts:Tv follow the
minor allele frequency and the base change of single-base references.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as g

VERY_RARE, RARE = 0.01, 0.05


def usable_sites(sites: DataFrame) -> DataFrame:
    """Sites with an alternative, and without filters other than PASS."""
    fine = F.col("filters").isNull() | (F.size("filters") == 0) | F.array_contains("filters", "PASS")
    return sites.filter((F.size("alts") > 0) & fine)


def diploid_calls(calls: DataFrame) -> DataFrame:
    """Unfiltered calls of two known alleles."""
    known = g.is_diploid(F.col("gt")) & ~F.coalesce(F.exists(g.indices(F.col("gt")), lambda x: x.isNull()), F.lit(True))
    return calls.filter(known & ~g.is_filtered(F.col("ft")))


def genotype_distribution(calls: DataFrame) -> DataFrame:
    """(site, genotype, n): canonical genotypes of unfiltered diploid calls."""
    a = g.indices(F.col("gt"))
    name = F.when(g.is_phased(F.col("gt")), F.col("gt")).otherwise(F.concat_ws("/", F.array_sort(a).cast("array<string>")))
    return diploid_calls(calls).select("site", name.alias("genotype")).groupBy("site", "genotype").agg(F.count("*").alias("n"))


def allele_counts(calls: DataFrame) -> DataFrame:
    """(site, allele, copies, samples): copies over calls, and calls that have the allele at all."""
    rows = diploid_calls(calls).withColumn("ids", g.indices(F.col("gt")))
    rows = rows.select("site", F.explode(F.transform(F.array_distinct("ids"), lambda x: F.struct(x.alias("allele"), F.size(F.filter("ids", lambda y: y == x)).alias("k")))).alias("c"))
    return rows.groupBy("site", F.col("c.allele").alias("allele")).agg(F.sum("c.k").alias("copies"), F.count("*").alias("samples"))


def site_summary(calls: DataFrame) -> DataFrame:
    """Per site: allele total, minor allele frequency, singleton flag, rarity class.

    The frequency is the smallest non-zero count over the total, but 0 if the reference was never called.
    """
    n = allele_counts(calls)
    s = n.groupBy("site").agg(
        F.sum("copies").alias("total"), F.min("copies").alias("least"),
        F.max(F.when(F.col("allele") == 0, F.col("copies")).otherwise(0)).alias("ref_copies"),
        F.max((F.col("samples") == 1).cast("int")).alias("one"),
    )
    maf = F.when(F.col("ref_copies") == 0, 0.0).otherwise(F.col("least") / F.col("total"))
    s = s.withColumns({"maf": maf, "singleton": F.col("one") == 1})
    return s.select("site", "total", "maf", "singleton", rarity(F.col("singleton"), F.col("maf")).alias("rarity"))


def rarity(singleton: Column, maf: Column) -> Column:
    return F.when(singleton, "singleton").when(maf < VERY_RARE, "very_rare").when(maf < RARE, "rare").otherwise("common")


def spectrum(calls: DataFrame, sites: DataFrame, keys=("site",)) -> DataFrame:
    """Copies of each base change, G and T references complemented, over single-base references."""
    rows = diploid_calls(calls).join(sites.select("site", "ref", "alts"), "site").filter(F.length("ref") == 1)
    rows = rows.select(*keys, "ref", F.explode(F.transform(F.filter(g.indices(F.col("gt")), lambda i: i > 0), lambda i: F.try_element_at("alts", i))).alias("alt"))
    rows = rows.filter((F.length("alt") == 1) & F.upper("alt").isin("A", "C", "G", "T"))
    return rows.groupBy(*keys, g.transition(F.col("ref"), F.col("alt")).alias("change")).agg(F.count("*").alias("n"))


def transitions_ratio(changes: DataFrame, keys=("site",)) -> DataFrame:
    ts = F.sum(F.when(F.col("change").isin("A>G", "C>T"), F.col("n")).otherwise(0))
    s = changes.groupBy(*keys).agg(ts.alias("transitions"), (F.sum("n") - ts).alias("transversions"))
    return s.withColumn("ratio", F.when(F.col("transversions") > 0, F.col("transitions") / F.col("transversions")))


def novelty(sites: DataFrame, fields: list[str]) -> DataFrame:
    """Per alternative: novel if every listed field that has a value for each alternative has none for it."""
    alt = sites.select("*", F.posexplode("alts").alias("i", "alt"))
    novel = F.lit(True)
    for f in fields:
        v = F.col("info")[f]
        whole = F.coalesce(F.size(v) == F.size("alts"), F.lit(False))
        at = F.try_element_at(v, F.col("i") + 1)
        novel = novel & ~F.coalesce(whole & at.isNotNull() & (at != "."), F.lit(False))
    return alt.select("site", (F.col("i") + 1).alias("allele"), novel.alias("novel"))


def sample_summary(calls: DataFrame, n_sites: DataFrame | None = None) -> DataFrame:
    """Per sample: calls by kind, and variants by the rarity of their sites."""
    diploid = g.is_diploid(F.col("gt")) & ~g.is_partial(F.col("gt")) & ~g.is_null(F.col("gt"))
    filtered = g.is_filtered(F.col("ft"))
    live = diploid & ~filtered
    rare = site_summary(calls).select("site", "rarity")
    rows = calls.join(rare, "site", "left")
    non_ref = live & ~g.is_reference(F.col("gt"))
    total = calls.select("site").distinct().agg(F.count("*").alias("n_sites")) if n_sites is None else n_sites
    out = rows.groupBy("sample").agg(
        F.count_if(live).alias("n_calls"), F.count_if(filtered).alias("n_filtered"),
        F.count_if(~g.is_empty(F.col("gt")) & ~diploid & ~filtered).alias("n_non_diploid"),
        F.count_if(live & g.is_reference(F.col("gt"))).alias("n_ref"), F.count_if(live & g.is_het(F.col("gt"))).alias("n_het"),
        F.count_if(non_ref & g.is_hom(F.col("gt"))).alias("n_hom"),
        *[F.count_if(non_ref & (F.col("rarity") == r)).alias(f"n_{r}") for r in ("singleton", "very_rare", "rare", "common")],
    )
    return out.crossJoin(F.broadcast(total)).withColumn("n_missing", F.col("n_sites") - F.col("n_calls") - F.col("n_filtered")).drop("n_sites")


def set_metrics(samples: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and sample standard deviation of per-sample columns."""
    return samples.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])
