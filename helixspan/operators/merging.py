"""Merging of variant records that edit the same regions, over any number of sources.

Records: (source, ord, chrom, pos, ids, ref, alts, qual, filters, info, format, samples), with
info map<string, array<string>> and samples map<string, map<string, string>>. Overlapping
records form islands; inside an island, records that edit an identical region form components
(a record without alternatives edits its whole span); components are merged record by record.
Islands, components and picks are DataFrame plans; a component's records, a handful, are put
together in Python.
"""
from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alleles as al
from ..sources.staging import staged
from . import contraction, islands

RECORD = (
    "source int, ord bigint, chrom string, pos bigint, ids array<string>, ref string, alts array<string>, qual double, "
    "filters array<string>, info map<string,array<string>>, format array<string>, samples map<string,map<string,string>>"
)


# --- components --------------------------------------------------------------------------------


def with_islands(records: DataFrame) -> DataFrame:
    spans = records.withColumns({"start": F.col("pos") - 1, "stop": F.col("pos") - 1 + F.length("ref")})
    return islands.island_ids(spans, None, ["chrom"], ["source", "ord"])


def regions_of(records: DataFrame) -> DataFrame:
    """(source, ord, chrom, island, start, stop): the regions each record edits."""
    whole = F.array(F.struct(F.col("start").alias("start"), F.col("stop").alias("stop")))
    edits = F.transform("alts", lambda a: al.edited_region(al.trimmed(F.col("pos"), F.upper("ref"), F.upper(a))))
    regions = F.when(F.size("alts") > 0, F.array_distinct(edits)).otherwise(whole)
    return records.select("source", "ord", "chrom", "island", F.explode(regions).alias("r")).select("source", "ord", "chrom", "island", "r.*")


#: Regions of an island whose components one row may hold; those of larger islands are found by contraction.
SMALL_ISLAND = 4096


def with_components(records: DataFrame, small: int = SMALL_ISLAND) -> DataFrame:
    """Adds `component`: the smallest ordinal of the records that hang together in the island.

    ordinals must be unique over all sources. Records alone in their island never leave the JVM; union-find
    sees the regions of one island of bounded size at a time. An island of more regions is never gathered: its
    records are linked to the least one of each region that they edit, and these links are contracted.
    """
    rows = with_islands(records)
    regions = staged(regions_of(rows), "regions")
    sizes = regions.groupBy("chrom", "island").agg(F.count("*").alias("n"), F.min("ord").alias("least"), F.max("ord").alias("most"))
    held = regions.join(sizes.filter((F.col("n") <= small) & (F.col("least") < F.col("most"))).select("chrom", "island"), ["chrom", "island"])
    groups = held.groupBy("chrom", "island").agg(F.collect_list(F.struct("ord", "start", "stop")).alias("regions"))
    ddl = "ord bigint, component bigint"
    target = _arrow(ddl, records.sparkSession)

    def run(batches):
        for batch in batches:
            found = [x for group in batch.column(0).to_pylist() for x in united(group).items()]
            cols = zip(*found) if found else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, target)], schema=target)

    found = groups.select("regions").mapInArrow(run, ddl)
    large = sizes.filter(F.col("n") > small).select("chrom", "island")
    if not large.isEmpty():
        place = ["chrom", "island", "start", "stop"]
        inside = regions.join(large, ["chrom", "island"])
        links = inside.join(inside.groupBy(*place).agg(F.min("ord").alias("first")), place).select(F.col("ord").alias("a"), F.col("first").alias("b"))
        found = found.unionByName(contraction.components(links).withColumnRenamed("node", "ord"))
    return rows.join(found, "ord", "left").withColumn("component", F.coalesce("component", "ord"))


def united(regions: list[dict]) -> dict[int, int]:
    """Component (smallest ordinal) of each ordinal; ordinals of one region hang together."""
    parent = {r["ord"]: r["ord"] for r in regions}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first: dict[tuple, int] = {}
    for r in regions:
        a, b = root(r["ord"]), root(first.setdefault((r["start"], r["stop"]), r["ord"]))
        parent[max(a, b)] = min(a, b)
    return {o: root(o) for o in parent}


def _arrow(ddl: str, spark):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


# --- alleles --------------------------------------------------------------------------------------


def merged_alleles(records: list[tuple[int, str, list[str]]]):
    """(ref, alts, numbers) of records (pos, ref, alts) in order; None if there is a gap between them.

    numbers[i][j] is the number, from 1, of record i's j-th alternative in the merged record.
    """
    if len(records) < 2:
        return None
    start, whole = records[0][0], records[0][1]
    for pos, ref, _ in records[1:]:
        covered = start + len(whole) - pos
        if covered < 0:
            return None
        whole += ref[covered:]
    alts: dict[str, int] = {}
    numbers = []
    for pos, ref, own in records:
        head, tail = whole[: pos - start], whole[pos - start + len(ref):]
        numbers.append([alts.setdefault(head + a + tail, len(alts) + 1) for a in own])
    return whole, list(alts), numbers


# --- strategy -----------------------------------------------------------------------------------


@dataclass
class Field:
    """A declared INFO or FORMAT field: number is a count, A, R, G or `.`."""

    number: str = "."
    type: str = "String"


@dataclass
class Strategy:
    mergers: dict[str, str] = field(default_factory=dict)
    default: str = "ignore"
    fields: dict[str, Field] = field(default_factory=dict)
    clear_filters: bool = False
    merge_samples: bool = False
    priority: str = "order"
    exact_position: bool = False
    allow_same_source: bool = False
    reject_filter: str = "MERGE_REJECT"
    consensus: float | None = None
    consensus_filter: str = "CNS"
    declared: dict[str, int] = field(default_factory=dict)  # sample -> files that declare it

    @classmethod
    def parse(cls, lines: Iterable[str], **more) -> "Strategy":
        """Lines `default=NAME` and `info.FIELD=NAME`."""
        out = cls(**more)
        for line in lines:
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            key, sep, how = (x.strip() for x in line.partition("="))
            if not sep or how not in WAYS:
                raise ValueError(f"bad merge strategy line {line!r}")
            if key == "default":
                out.default = how
            elif key.startswith("info."):
                out.mergers[key[5:]] = how
            else:
                raise ValueError(f"bad merge strategy line {line!r}")
        return out


def _first(vs, *_):
    return vs[0]


def _earliest(vs, *_):
    return next((v for v in vs if v), None)


def _uniq(vs, *_):
    return list(dict.fromkeys(x for v in vs if v for x in v)) or None


def _equal(vs, *_):
    found = [v for v in vs if v]
    if any(v != found[0] for v in found):
        raise ValueError("values to merge are not equal")
    return found[0] if found else None


def _equal_sets(vs, *_):
    found = [v for v in vs if v]
    if any(set(v) != set(found[0]) for v in found):
        raise ValueError("values to merge are not equal")
    return found[0] if found else None


def _sum(vs, spec, *_):
    if not spec.number.isdigit() or spec.type not in ("Integer", "Float"):
        raise ValueError("only numeric fields of fixed size can be summed")
    kind = int if spec.type == "Integer" else float
    rows = [[kind(x) if x not in (None, ".") else 0 for x in v] for v in vs if v]
    return [f"{sum(col):g}" if kind is float else str(sum(col)) for col in zip(*rows)] if rows else None


def _per_alt(vs, spec, numbers, n_alts):
    if spec.number != "A":
        raise ValueError("per-alt-delimited-list needs a field with a value for each alternative")
    found: list[set] = [set() for _ in range(n_alts)]
    for v, own in zip(vs, numbers):
        for x, i in zip(v or (), own):
            found[i - 1].update(w for w in (x or "").split("/") if w and w != ".")
    return ["/".join(sorted(s)) or None for s in found]


WAYS = {
    "first": _first, "earliest": _earliest, "uniq-concat": _uniq, "enforce-equal": _equal,
    "enforce-equal-unordered": _equal_sets, "sum": _sum, "ignore": lambda *_: None, "per-alt-delimited-list": _per_alt,
}


# --- one component -----------------------------------------------------------------------------


def _filtered(call: dict) -> bool:
    return (call.get("FT") or ".") not in (".", "PASS", "")


def _alleles(gt: str | None) -> set:
    return {x for x in re.split(r"[/|]", gt or "") if x not in ("", ".")}


def renumber(gt: str, numbers: list[int]) -> str:
    """Allele numbers by their place in the merged record; one that the record doesn't have is missing."""
    return re.sub(r"\d+", lambda m: "0" if int(m[0]) == 0 else str(numbers[int(m[0]) - 1]) if int(m[0]) <= len(numbers) else ".", gt)


def _padded(values, spec: Field, n_alts: int):
    want = n_alts if spec.number == "A" else n_alts + 1 if spec.number == "R" else None
    if values is None or want is None:
        return values
    if len(values) > want:
        raise ValueError("more values than alternatives")
    return list(values) + [None] * (want - len(values))


def merge_component(records: list[dict], s: Strategy) -> list[dict]:
    """The merged record, or the records as they are if their alleles can't be joined."""
    spans = {(r["pos"], len(r["ref"])) for r in records}
    if s.exact_position and len(spans) > 1:
        raise ValueError("records at different positions can't be merged by exact position")
    joined = merged_alleles([(r["pos"], r["ref"], r["alts"]) for r in records])
    if joined is None:
        return [_with_consensus(r, {n: 1 for n, c in r["samples"].items() if c}, s) for r in records]
    ref, alts, numbers = joined
    first = records[0]
    filters = sorted({f for r in records for f in r["filters"] or ()})
    if len(filters) > 1:
        filters = [f for f in filters if f != "PASS"]
    info = {}
    for name in dict.fromkeys(k for r in records for k in r["info"]):
        how, spec = WAYS[s.mergers.get(name, s.default)], s.fields.get(name, Field())
        value = _padded(how([r["info"].get(name) for r in records], spec, numbers, len(alts)), spec, len(alts))
        if value is not None:
            info[name] = value
    form = list(dict.fromkeys(f for r in records for f in r["format"] or ()))
    if "GT" in form:
        form = ["GT", *[f for f in form if f != "GT"]]
    samples, counts = _merged_samples(records, numbers, s)
    out = dict(
        source=first["source"], ord=first["ord"], chrom=first["chrom"], pos=first["pos"],
        ids=sorted({i for r in records for i in r["ids"] or ()}), ref=ref, alts=alts, qual=None,
        filters=[] if s.clear_filters else filters, info=info, format=form, samples=samples,
    )
    return [_with_consensus(out, counts, s)]


def _merged_samples(records, numbers, s: Strategy):
    held: dict[str, list[tuple[int, dict]]] = {}
    for i, r in enumerate(records):
        for name, call in r["samples"].items():
            if call and any(v not in (None, ".") for v in call.values()):
                call = dict(call)
                if call.get("GT"):
                    call["GT"] = renumber(call["GT"], numbers[i])
                held.setdefault(name, []).append((i, call))
    out, counts = {}, {}
    for name, calls in held.items():
        if len(calls) > 1 and not s.merge_samples:
            raise ValueError(f"sample {name} is in more than one record")
        rank = {"order": lambda c: 0, "unfiltered": _filtered, "filtered": lambda c: not _filtered(c)}[s.priority]
        primary = min(range(len(calls)), key=lambda j: (rank(calls[j][1]), j))
        whole = dict(calls[primary][1])
        n = int(not _filtered(whole))
        for j, (_, call) in enumerate(calls):
            if j == primary:
                continue
            mine, theirs = _alleles(whole.get("GT")), _alleles(call.get("GT"))
            if mine and theirs and not mine & theirs:
                continue  # a contradicting genotype adds nothing
            for k, v in call.items():
                if whole.get(k) in (None, ".", ""):
                    whole[k] = v
            n += int(not _filtered(call))
        out[name], counts[name] = whole, n
    return out, counts


def _with_consensus(r: dict, counts: dict[str, int], s: Strategy) -> dict:
    if s.consensus is None:
        return r
    for name, n in counts.items():
        if n / s.declared.get(name, 1) < s.consensus:
            call = dict(r["samples"][name])
            old = [x for x in (call.get("FT") or "").split(";") if x not in ("", ".", "PASS")]
            call["FT"] = ";".join([*old, s.consensus_filter])
            r["samples"][name] = call
            r["filters"] = sorted({*(f for f in r["filters"] or () if f != "PASS"), s.consensus_filter})
            if "FT" not in r["format"]:
                r["format"] = [*r["format"], "FT"]
    return r


# --- whole table ----------------------------------------------------------------------------------


def merge_records(records: DataFrame, strategy: Strategy) -> DataFrame:
    """All records merged by component; repeated records of a source are rejected beside the merged one.

    The records of one source and sample are small groups: a component holds at most one record
    of each source unless the strategy allows more.
    """
    from ..operators.calls import first_per_source

    rows = with_components(records)
    names = [f.split()[0] for f in re.split(r", (?=\w+ \w)", RECORD)]
    if strategy.allow_same_source:
        kept, rejected = rows, rows.limit(0)
    else:
        marked = first_per_source(rows, ["component"], ["pos", "ord"])
        kept, rejected = marked.filter("kept"), marked.filter("not kept")

    target = _arrow(RECORD, records.sparkSession)

    def merge(batches):
        for batch in batches:
            out = []
            for group in batch.column(0).to_pylist():
                for r in group:
                    r["info"], r["samples"] = dict(r["info"] or ()), {k: dict(v or ()) for k, v in r["samples"] or ()}
                    for c in ("ids", "alts", "filters", "format"):
                        r[c] = r[c] or []
                out += merge_component(sorted(group, key=lambda r: (r["pos"], r["source"], r["ord"])), strategy)
            for r in out:
                r["info"], r["samples"] = list(r["info"].items()), [(k, list(v.items())) for k, v in r["samples"].items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in out], f.type) for f in target], schema=target)

    out = kept.groupBy("component").agg(F.collect_list(F.struct(*names)).alias("records")).select("records").mapInArrow(merge, RECORD)
    bad = F.array_sort(F.array_union(F.array_remove(F.coalesce("filters", F.array().cast("array<string>")), "PASS"), F.array(F.lit(strategy.reject_filter))))
    return out.unionByName(rejected.withColumn("filters", bad).select(*names))

