"""INFO values as Spark variants, parsed once by the type that the header declares.

typed: map<string, variant>, each value an array of its field's type (a flag: true). Operators take values out by
their own type, so integers stay integers through sums and comparisons, and texts are only made again for a file.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import lines, vcf

# The types of the format and what their values are here.
_KINDS = {"Integer": "bigint", "Float": "double", "String": "string", "Character": "string"}
#: What is wrong with a value, in the order in which it is looked for.
FAULTS = ("undeclared field", "value of a wrong type", "wrong number of values")


def _declared(header: vcf.Header, of) -> Column:
    """of(field) for the declared field `key`; null for others."""
    if not header.info:
        return F.lit(None).cast("string")
    return F.create_map(*[F.lit(x) for k, f in header.info.items() for x in (k, of(f))])[F.col("key")]


def _entries(rows: DataFrame, header: vcf.Header, keys: list[str]) -> DataFrame:
    """A row for each INFO field of each record, with its declaration and its fault."""
    e = rows.select(*keys, F.size("alts").alias("n_alts"), F.explode("info").alias("key", "values"))
    e = e.withColumns({"type": _declared(header, lambda f: f.type), "number": _declared(header, lambda f: f.number)})
    fits = lambda kind: F.forall("values", lambda x: x.isNull() | x.try_cast(kind).isNotNull())
    right = F.when(F.col("type") == "Integer", fits("bigint")).when(F.col("type") == "Float", fits("double")).otherwise(True)
    size, number = F.size("values"), F.col("number")
    many = F.when(F.col("type") == "Flag", size == 0).when(number.rlike("^[0-9]+$"), size == number.try_cast("int")).when(number == "A", size == F.col("n_alts")).when(
        number == "R", size == F.col("n_alts") + 1).otherwise(True)
    fault = F.when(F.col("type").isNull(), FAULTS[0]).when(~right, FAULTS[1]).when(~many, FAULTS[2])
    return e.withColumn("fault", fault)


def with_typed(rows: DataFrame, header: vcf.Header) -> DataFrame:
    """rows with `typed`; fields that aren't declared are texts, values that don't fit are missing elements."""

    def value(k: Column, v: Column) -> Column:
        kind = F.element_at(F.create_map(*[F.lit(x) for n, f in header.info.items() for x in (n, f.type)]), k) if header.info else F.lit(None).cast("string")
        as_ = lambda t: F.transform(v, lambda x: x.try_cast(t)).cast("variant")
        return F.when(kind == "Integer", as_("bigint")).when(kind == "Float", as_("double")).when(kind == "Flag", F.lit(True).cast("variant")).otherwise(v.cast("variant"))

    return rows.withColumn("typed", F.transform_values("info", value))


def elements(name: str, kind: str) -> Column:
    """A typed field's values as an array of its kind (bigint, double or string); null where a record doesn't have it."""
    return F.try_variant_get(F.try_element_at("typed", F.lit(name)), "$", f"array<{kind}>")


def summed(rows: DataFrame, keys: list[str], header: vcf.Header, names: list[str]) -> DataFrame:
    """keys and the sums of the named fields, element by element, as arrays of the fields' own types.

    A missing element counts nothing; a sum of none is missing.
    """
    out = None
    for name in names:
        kind = _KINDS[header.info[name].type]
        if kind == "string":
            raise ValueError(f"{name} isn't a number")
        each = rows.select(*keys, F.posexplode(elements(name, kind)).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.sum("_x").alias("_x"))
        one = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_s")).select(*keys, F.transform("_s", lambda e: e["_x"]).alias(name))
        out = one if out is None else out.join(one, keys, "full")
    return out


def same_values(rows: DataFrame, keys: list[str], header: vcf.Header, names: list[str]) -> DataFrame:
    """keys, and for each named field whether the records that have it agree, by value and not by text (1.0 and 1 agree)."""
    aggs = []
    for name in names:
        kind = _KINDS[header.info[name].type]
        v = elements(name, kind)
        aggs.append((F.count_distinct(F.when(v.isNotNull(), F.to_json(F.struct(v.alias("v"))))) <= 1).alias(name))
    return rows.groupBy(*keys).agg(*aggs)


def checked(spark: SparkSession, path: str, header: vcf.Header | None = None) -> tuple[DataFrame, DataFrame]:
    """(records with file, line and typed values; file, line, reason and value of what is wrong) of a variant file.

    A line that can't be read as a record isn't one; a field that doesn't fit its declaration leaves its record there
    and comes out as well, as KEY=VALUES.
    """
    header = header or vcf.read_header(spark, path)
    good, bad = lines.checked_vcf(spark, path)
    rows = with_typed(vcf.rows_of(good, header, keep=("file", "line")), header)
    wrong = _entries(rows, header, ["file", "line"]).filter("fault IS NOT NULL")
    value = F.concat(F.col("key"), F.when(F.size("values") > 0, F.concat(F.lit("="), F.array_join("values", ",", "."))).otherwise(""))
    return rows, bad.unionByName(wrong.select("file", "line", F.col("fault").alias("reason"), value.alias("value")))
