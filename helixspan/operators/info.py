"""Named ways to merge a field's values over the rows of a group, as aggregate columns.

Each takes the value column (an array of texts, or null) and the columns that order the rows.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ordered(value: Column, order: list[Column]) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v"))))
    return F.filter(F.transform(rows, lambda r: r.v), lambda v: v.isNotNull())


def first(value: Column, order: list[Column]) -> Column:
    """The first row's value, even if missing."""
    return F.min_by(F.struct(value.alias("v")), F.struct(*order))["v"]


def earliest(value: Column, order: list[Column]) -> Column:
    """The first value that isn't missing."""
    return F.min_by(value, F.when(value.isNotNull(), F.struct(*order)))


def uniq_concat(value: Column, order: list[Column]) -> Column:
    """Elements of all rows in order of first appearance."""
    return F.array_distinct(F.flatten(_ordered(value, order)))


def enforce_equal(value: Column, order: list[Column]) -> Column:
    """The one value of all rows; an error if they differ."""
    return F.when(F.count_distinct(value) > 1, F.raise_error(F.lit("values to merge are not equal"))).otherwise(earliest(value, order))


def enforce_equal_unordered(value: Column, order: list[Column]) -> Column:
    """As enforce_equal on the sets of elements."""
    sets = F.array_sort(F.array_distinct(value))
    return F.when(F.count_distinct(sets) > 1, F.raise_error(F.lit("values to merge are not equal"))).otherwise(earliest(value, order))


def total(value: Column, order: list[Column]) -> Column:
    """Element-wise sum of numbers, a missing element as 0."""
    rows = F.transform(_ordered(value, order), lambda v: F.transform(v, lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0))))
    zero = F.lit(0.0)
    return F.aggregate(rows, F.array().cast("array<double>"), lambda acc, v: F.zip_with(acc, v, lambda a, b: F.coalesce(a, zero) + F.coalesce(b, zero)))


def ignore(value: Column, order: list[Column]) -> Column:
    return F.first(F.lit(None).cast("array<string>"))


def per_alt_delimited(value: Column, numbers: Column, n_alts: Column) -> Column:
    """For each merged alternative, the sorted union of its rows' `/`-separated texts.

    value: one text for each of the row's alternatives; numbers: their numbers (from 1) in the
    merged row; n_alts: how many alternatives that has.
    """
    pairs = F.flatten(F.collect_list(F.zip_with(numbers, value, lambda n, v: F.struct(n.alias("n"), v.alias("v")))))

    def of(i):
        own = F.filter(pairs, lambda p: (p.n == i) & p.v.isNotNull())
        words = F.flatten(F.transform(own, lambda p: F.split(p.v, "/")))
        return F.array_join(F.array_sort(F.array_distinct(words)), "/")

    return F.transform(F.sequence(F.lit(1), F.max(n_alts)), of)


MERGERS = {
    "first": first,
    "earliest": earliest,
    "uniq-concat": uniq_concat,
    "enforce-equal": enforce_equal,
    "enforce-equal-unordered": enforce_equal_unordered,
    "sum": total,
    "ignore": ignore,
}


def merger(name: str):
    if name not in MERGERS:
        raise KeyError(f"no merger {name!r}; there are {', '.join(sorted(MERGERS))}")
    return MERGERS[name]


def merged_fields(rows, keys: list[str], fields: dict[str, str], order: list[str]):
    """One row per group with each field merged by its named way; fields without a way are dropped."""
    by = [F.col(c) for c in order]
    return rows.groupBy(*keys).agg(*[merger(how)(F.col(f), by).alias(f) for f, how in fields.items()])
