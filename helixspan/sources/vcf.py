"""Variant call text: headers on the driver, rows as DataFrames.

Rows: source, ord, chrom, pos, ids, ref, alts, qual, filters, info map<string, array<string>>,
format, samples map<string, map<string, string>>. Missing values (`.`) are null.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: what a field's number and type may be.
NUMBERS = ("A", "R", "G", ".")
TYPES = ("Integer", "Float", "Character", "String", "Flag")


@dataclass(frozen=True)
class FieldType:
    id: str
    number: str
    type: str
    description: str = ""

    @classmethod
    def parse(cls, text: str) -> "FieldType":
        m = parse_map(text)
        number, kind = m.get("Number", "."), m.get("Type", "String")
        if not (number in NUMBERS or number.isdigit()) or kind not in TYPES or not m.get("ID"):
            raise ValueError(f"bad field declaration {text!r}")
        return cls(m["ID"], number, kind, m.get("Description", ""))

    def render(self) -> str:
        return f'<ID={self.id},Number={self.number},Type={self.type},Description="{self.description}">'


def parse_map(text: str) -> dict[str, str]:
    """The keys of `<A=1,B="x, y",C=<p,q>>`; quoted texts without quotes, nested lists as they are."""
    if not (text.startswith("<") and text.endswith(">")):
        raise ValueError(f"not a map: {text!r}")
    out, body, i = {}, text[1:-1], 0
    while i < len(body):
        m = re.compile(r"([^=,]+)=").match(body, i)
        if not m:
            raise ValueError(f"no key at {body[i:]!r}")
        i = m.end()
        if body[i : i + 1] == '"':
            end = re.compile(r'(?:[^"\\]|\\.)*"').match(body, i + 1)
            value, i = body[i + 1 : end.end() - 1], end.end()
        elif body[i : i + 1] == "<":
            end = body.index(">", i) + 1
            value, i = body[i:end], end
        else:
            end = body.find(",", i)
            end = len(body) if end < 0 else end
            value, i = body[i:end], end
        if m[1] in out:
            raise ValueError(f"key {m[1]} twice in {text!r}")
        out[m[1]] = value
        if body[i : i + 1] == ",":
            i += 1
        elif i < len(body):
            raise ValueError(f"unexpected {body[i:]!r}")
    return out


@dataclass
class Header:
    meta: list[str] = field(default_factory=list)  # other ## lines, in order
    info: dict[str, FieldType] = field(default_factory=dict)
    format: dict[str, FieldType] = field(default_factory=dict)
    filters: dict[str, str] = field(default_factory=dict)
    sample_tags: dict[str, str] = field(default_factory=dict)
    samples: list[str] = field(default_factory=list)
    sources: dict[str, int] = field(default_factory=dict)  # sample -> number of files that declare it

    @classmethod
    def parse(cls, lines: list[str]) -> "Header":
        h = cls()
        for line in lines:
            if line.startswith("##"):
                key, _, value = line[2:].partition("=")
                if key in ("INFO", "FORMAT"):
                    f = FieldType.parse(value)
                    (h.info if key == "INFO" else h.format)[f.id] = f
                elif key == "FILTER":
                    m = parse_map(value)
                    h.filters[m["ID"]] = m.get("Description", "")
                elif key == "SAMPLE":
                    h.sample_tags[parse_map(value)["ID"]] = value
                else:
                    h.meta.append(line)
            elif line.startswith("#CHROM"):
                h.samples = line.split("\t")[9:]
                if len(set(h.samples)) < len(h.samples):
                    raise ValueError("a sample is named twice")
                h.sources = dict.fromkeys(h.samples, 1)
        return h

    def merge(self, other: "Header", allow_shared: bool = True) -> "Header":
        """Both headers' declarations; equal ones once, contradicting ones are an error."""
        out = Header(list(dict.fromkeys([*self.meta, *other.meta])))
        for name in ("info", "format"):
            mine, theirs = getattr(self, name), getattr(other, name)
            for k in mine.keys() & theirs.keys():
                if (mine[k].number, mine[k].type) != (theirs[k].number, theirs[k].type):
                    raise ValueError(f"{name.upper()} {k} is declared in two ways")
            setattr(out, name, {**theirs, **mine})
        out.filters = {**other.filters, **self.filters}
        out.sample_tags = {**other.sample_tags, **self.sample_tags}
        shared = set(self.samples) & set(other.samples)
        if shared and not allow_shared:
            raise ValueError(f"samples in more than one file: {', '.join(sorted(shared))}")
        out.samples = list(dict.fromkeys([*self.samples, *other.samples]))
        out.sources = {s: self.sources.get(s, 0) + other.sources.get(s, 0) for s in out.samples}
        return out

    def mirror(self, tag: str) -> "Header":
        """Every sample once more under its name and a suffix, with its tag line if it has one."""
        names = [f"{s}{tag}" for s in self.samples]
        tags = {f"{s}{tag}": re.sub(r"\bID=[^,>]*", lambda m: f"ID={s}{tag}", v, count=1) for s, v in self.sample_tags.items() if s in self.samples}
        return Header(self.meta, self.info, self.format, self.filters, {**self.sample_tags, **tags}, [*self.samples, *names], {**self.sources, **dict.fromkeys(names, 1)})

    def rename(self, names: dict[str, str]) -> "Header":
        new = [names.get(s, s) for s in self.samples]
        if len(set(new)) < len(new):
            raise ValueError("renaming makes two samples the same")
        return Header(self.meta, self.info, self.format, self.filters, self.sample_tags, new, {names.get(s, s): n for s, n in self.sources.items()})

    def render(self) -> list[str]:
        out = [m for m in self.meta if m.startswith("##fileformat")] or ["##fileformat=VCFv4.1"]
        out += [m for m in self.meta if not m.startswith("##fileformat")]
        out += [f"##INFO={f.render()}" for f in self.info.values()]
        out += [f"##FORMAT={f.render()}" for f in self.format.values()]
        out += [f'##FILTER=<ID={k},Description="{d}">' for k, d in self.filters.items()]
        out += [f"##SAMPLE={v}" for v in self.sample_tags.values()]
        cols = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]
        return [*out, "\t".join([*cols, "FORMAT", *self.samples] if self.samples else cols)]


def read_header(spark: SparkSession, path: str) -> Header:
    return Header.parse([r[0] for r in spark.read.text(path).filter("value like '#%'").collect()])


def _list(text: Column, by: str) -> Column:
    parts = F.split(text, by, -1)
    return F.when(text.isNull() | text.isin("", "."), F.array().cast("array<string>")).otherwise(parts)


def _values(text: Column) -> Column:
    return F.transform(F.split(text, ",", -1), lambda x: F.when(x != ".", x))


def read_rows(spark: SparkSession, path: str, header: Header | None = None, source: int = 0) -> DataFrame:
    return rows_of(spark.read.text(path).filter("value <> '' and value not like '#%'"), header or read_header(spark, path), source)


def rows_of(rows: DataFrame, header: Header, source: int = 0, keep: tuple = ()) -> DataFrame:
    """Records of lines (value, ...) that aren't blank or comments; keep: further columns that stay."""
    f = F.split("value", "\t", -1)
    at = lambda i: F.get(f, F.lit(i))
    names = F.array(*[F.lit(s) for s in header.samples]) if header.samples else F.array().cast("array<string>")
    items = F.transform(_list(at(7), ";"), lambda x: F.struct(
        F.substring_index(x, "=", 1).alias("k"),
        F.when(F.contains(x, F.lit("=")), _values(F.substr(x, F.instr(x, "=") + 1))).otherwise(F.array().cast("array<string>")).alias("v"),
    ))
    form = _list(at(8), ":")

    def call(text):
        parts = F.split(text, ":", -1)
        kv = F.transform(form, lambda k, i: F.struct(k.alias("k"), F.nullif(F.try_element_at(parts, i + 1), F.lit(".")).alias("v")))
        return F.when(~text.isin("", "."), F.map_from_entries(kv))

    calls = F.transform(names, lambda n, i: F.struct(n.alias("k"), call(F.try_element_at(f, i + 10)).alias("v")))
    return rows.select(
        *keep, F.lit(source).alias("source"), F.monotonically_increasing_id().alias("ord"), at(0).alias("chrom"), at(1).cast("bigint").alias("pos"),
        F.array_sort(F.array_distinct(_list(at(2), ";"))).alias("ids"), at(3).alias("ref"), _list(at(4), ",").alias("alts"),
        at(5).try_cast("double").alias("qual"), F.array_sort(F.array_distinct(_list(at(6), ";"))).alias("filters"),
        F.map_from_entries(items).alias("info"), form.alias("format"), F.map_filter(F.map_from_entries(calls), lambda k, v: v.isNotNull()).alias("samples"),
    )


def undeclared(rows: DataFrame, header: Header) -> DataFrame:
    """INFO and FORMAT keys that the header doesn't declare (a validator)."""
    keys = F.concat(
        F.transform(F.map_keys("info"), lambda k: F.concat(F.lit("INFO/"), k)), F.transform("format", lambda k: F.concat(F.lit("FORMAT/"), k))
    )
    known = [f"INFO/{k}" for k in header.info] + [f"FORMAT/{k}" for k in header.format]
    found = rows.select(F.explode(keys).alias("key")).distinct()
    return found.filter(~F.col("key").isin(known)) if known else found


# Types of INFO and FORMAT fields and what they are here.
TYPES = {"Integer": "bigint", "Float": "double", "Flag": "boolean", "Character": "string", "String": "string"}


def typed(values: Column, kind: str) -> Column:
    """A field's values (array of texts) in its declared type; what doesn't fit is missing. A flag that is there is true."""
    if kind == "Flag":
        return F.when(values.isNotNull(), F.array(F.lit(True)))
    return F.transform(values, lambda x: x.try_cast(TYPES.get(kind, "string")))


def typed_info(rows: DataFrame, header: Header, names: list[str]) -> DataFrame:
    """rows with a column for each named INFO field, in its declared type: one value, or an array where several are declared."""
    out = {}
    for name in names:
        f = header.info[name]
        values = typed(F.try_element_at("info", F.lit(name)), f.type)
        out[name] = F.coalesce(F.get(values, F.lit(0)), F.lit(False)) if f.type == "Flag" else F.get(values, F.lit(0)) if f.number == "1" else values
    return rows.withColumns(out)


def ill_typed(rows: DataFrame, header: Header) -> DataFrame:
    """(chrom, pos, key, value): INFO values that don't have their field's declared type or number (a validator)."""
    if not header.info:
        return rows.select("chrom", "pos", F.lit("").alias("key"), F.lit("").alias("value")).filter("false")
    table = lambda of: F.create_map(*[F.lit(x) for k, f in header.info.items() for x in (k, of(f))])
    v = rows.select("chrom", "pos", F.size("alts").alias("n"), F.explode("info").alias("key", "values"))
    v = v.withColumns({"type": table(lambda f: f.type)[F.col("key")], "number": table(lambda f: f.number)[F.col("key")]})
    fits = lambda kind: F.forall("values", lambda x: x.isNull() | x.try_cast(kind).isNotNull())
    right = F.when(F.col("type") == "Integer", fits("bigint")).when(F.col("type") == "Float", fits("double")).otherwise(True)
    size, number = F.size("values"), F.col("number")
    many = F.when(F.col("type") == "Flag", size == 0).when(number.rlike("^[0-9]+$"), size == number.try_cast("int")).when(number == "A", size == F.col("n")).when(number == "R", size == F.col("n") + 1).otherwise(True)
    return v.filter(~(right & many)).select("chrom", "pos", "key", F.array_join("values", ",", ".").alias("value"))


def to_calls(rows: DataFrame) -> DataFrame:
    """Long form (source, ord, chrom, pos, sample, gt, ft, dp, fields)."""
    out = rows.select("source", "ord", "chrom", "pos", F.explode("samples").alias("sample", "fields"))
    get = lambda k: F.try_element_at("fields", F.lit(k))
    return out.withColumns({"gt": get("GT"), "ft": get("FT"), "dp": get("DP").try_cast("int")})


def _call_text(call: Column) -> Column:
    values = F.transform("format", lambda k: F.coalesce(F.try_element_at(call, k), F.lit(".")))
    return F.when(call.isNull(), ".").otherwise(F.array_join(values, ":"))


def rendered(rows: DataFrame, header: Header, keep=()) -> DataFrame:
    """(*keep, chrom, pos, line): rows as text, INFO sorted by key, numbers with six significant digits."""
    dot = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("."))
    joined = lambda a, by: dot(F.array_join(a, by, "."))
    entries = F.array_sort(F.map_entries("info"))
    info = F.array_join(F.transform(entries, lambda e: F.when(F.size(e.value) == 0, e.key).otherwise(F.concat(e.key, F.lit("="), F.array_join(e.value, ",", ".")))), ";")
    number = F.regexp_replace(F.regexp_replace(F.format_string("%.6g", "qual"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    qual = F.when(F.col("qual").isNull(), ".").otherwise(number)
    base = [F.col("chrom"), F.col("pos").cast("string"), joined(F.col("ids"), ";"), F.col("ref"), joined(F.col("alts"), ","), qual, joined(F.col("filters"), ";"), dot(info)]
    if header.samples:
        base.append(joined(F.col("format"), ":"))
        base += [_call_text(F.try_element_at("samples", F.lit(s))) for s in header.samples]
    return rows.select(*keep, "chrom", "pos", F.concat_ws("\t", *base).alias("line"))
