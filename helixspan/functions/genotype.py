"""Genotype texts (`0/1`, `1|1`, `./.`) as column expressions over arrays of allele numbers."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def indices(gt: Column) -> Column:
    """array<int>, null elements for missing alleles; null for a missing or empty call."""
    parts = F.split(gt, "[/|]", -1)
    ids = F.transform(parts, lambda x: F.when(x == ".", F.lit(None).cast("int")).otherwise(x.cast("int")))
    return F.when(~is_empty(gt), ids)


def is_empty(gt: Column) -> Column:
    return F.coalesce(gt.isNull() | gt.isin("", "."), F.lit(True))


def is_phased(gt: Column) -> Column:
    return F.coalesce(F.contains(gt, F.lit("|")), F.lit(False))


def is_partial(gt: Column) -> Column:
    ids = indices(gt)
    return F.coalesce(F.exists(ids, lambda x: x.isNull()) & F.exists(ids, lambda x: x.isNotNull()), F.lit(False))


def is_null(gt: Column) -> Column:
    return F.coalesce(F.forall(indices(gt), lambda x: x.isNull()), F.lit(True))


def called(gt: Column) -> Column:
    return F.filter(indices(gt), lambda x: x.isNotNull())


def distinct_alleles(gt: Column) -> Column:
    return F.array_sort(F.array_distinct(called(gt)))


def is_diploid(gt: Column) -> Column:
    return F.coalesce(F.size(indices(gt)) == 2, F.lit(False))


def is_het(gt: Column) -> Column:
    return F.coalesce(F.size(distinct_alleles(gt)) > 1, F.lit(False))


def is_hom(gt: Column) -> Column:
    return F.coalesce((F.size(distinct_alleles(gt)) == 1) & ~F.exists(indices(gt), lambda x: x.isNull()), F.lit(False))


def is_reference(gt: Column) -> Column:
    return F.coalesce(is_hom(gt) & (F.get(distinct_alleles(gt), F.lit(0)) == 0), F.lit(False))


def canonical(gt: Column) -> Column:
    """Unphased calls by their sorted allele set, phased ones by their text."""
    ids = F.array_join(distinct_alleles(gt).cast("array<string>"), "/")
    return F.when(is_phased(gt), gt).otherwise(ids)


def disjoint(a: Column, b: Column) -> Column:
    return ~F.coalesce(F.arrays_overlap(called(a), called(b)), F.lit(False))


def renumbered(gt: Column, numbers: Column) -> Column:
    """gt with each allele index i replaced by numbers[i]; separators stay; an unknown index is missing."""
    parts = F.regexp_extract_all(gt, F.lit("([0-9]+|[^0-9]+)"), 1)
    new = lambda x: F.coalesce(F.try_element_at(numbers, x.cast("int") + 1).cast("string"), F.lit("."))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), new(x)).otherwise(x)), "")


def unphased_name(low: int, high: int) -> str:
    return f"{low}/{high}"


def is_filtered(ft: Column) -> Column:
    """A sample filter that is neither missing nor PASS."""
    return F.coalesce(~ft.isin("", ".", "PASS"), F.lit(False))


def transition(ref: Column, alt: Column) -> Column:
    """Base change with G and T references complemented: A->G and C->T are transitions."""
    r, a = F.upper(ref), F.upper(alt)
    flip = r.isin("G", "T")
    r = F.when(flip, F.translate(r, "ACGT", "TGCA")).otherwise(r)
    a = F.when(flip, F.translate(a, "ACGT", "TGCA")).otherwise(a)
    return F.concat(r, F.lit(">"), a)
