"""Allele strings as column expressions. A null allele is empty, `*`, `-` or `0`."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: IUPAC codes in order of their base masks 1 to 15 (A=1, C=2, G=4, T=8).
IUPAC = "ACMGRSVTWYHKDBN"
# IUPAC codes and their complements.
COMPLEMENT = ("ACGTUMRWSYKVHDBN", "TGCAAKYWSRMBDHVN")


def is_null_allele(a: Column) -> Column:
    return a.isin("", "*", "-", "0")


def plain(a: Column) -> Column:
    """Upper case, null alleles as the empty text."""
    a = F.upper(a)
    return F.when(is_null_allele(a), F.lit("")).otherwise(a)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix: the longest beginning of a that b repeats behind a mark no allele holds."""
    both = F.concat(a, F.lit("\x00"), b)
    return F.length(F.regexp_extract(both, r"(?s)^([^\x00]*)[^\x00]*+\x00\1", 1)).cast("bigint")


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))


def common_prefix_of_all(alleles: Column) -> Column:
    first = F.get(alleles, F.lit(0))
    return F.array_min(F.transform(alleles, lambda x: common_prefix(first, x)))


def common_suffix_of_all(alleles: Column) -> Column:
    first = F.get(alleles, F.lit(0))
    return F.array_min(F.transform(alleles, lambda x: common_suffix(first, x)))


def trimmed(pos: Column, ref: Column, alt: Column) -> Column:
    """struct(pos, ref, alt) without the shared prefix, then without the shared suffix of the rest."""
    p = common_prefix(ref, alt)
    r, a = F.substr(ref, p + 1, F.length(ref)), F.substr(alt, p + 1, F.length(alt))
    s = F.when((F.length(r) == 0) | (F.length(a) == 0), F.lit(0)).otherwise(common_suffix(r, a))
    return F.struct(
        (pos + p).cast("bigint").alias("pos"),
        F.substr(r, F.lit(1), F.length(r) - s).alias("ref"),
        F.substr(a, F.lit(1), F.length(a) - s).alias("alt"),
    )


def edited_region(raw: Column) -> Column:
    """Half-open region of the reference that a trimmed variant changes; empty for an insertion."""
    start = raw["pos"] - 1
    return F.struct(start.alias("start"), (start + F.length(raw["ref"])).alias("stop"))


def variant_type(ref: Column, alt: Column) -> Column:
    """SNP, INS, DEL or INVALID by widths of the alleles of an interval row."""
    r, a = plain(ref), plain(alt)
    return (
        F.when((F.length(r) == 1) & (F.length(a) == 1), "SNP")
        .when((r == "") & (a != ""), "INS")
        .when((a == "") & (r != ""), "DEL")
        .otherwise("INVALID")
    )


def length_type(ref: Column, alt: Column) -> Column:
    return (
        F.when(F.length(ref) == F.length(alt), "SUBSTITUTION")
        .when(F.length(ref) < F.length(alt), "INSERTION")
        .otherwise("DELETION")
    )


def reverse_complement(a: Column) -> Column:
    """IUPAC-aware; other characters become `-`."""
    known = F.regexp_replace(F.upper(a), f"[^{COMPLEMENT[0]}]", "-")
    return F.reverse(F.translate(known, *COMPLEMENT))


def base_mask(code: Column) -> Column:
    """Bit set of the bases a single code stands for; 0 for anything else."""
    return F.when(F.length(code) == 1, F.instr(F.lit(IUPAC), F.upper(code))).otherwise(0)


def masks_overlap(a: Column, b: Column) -> Column:
    return base_mask(a).bitwiseAND(base_mask(b)) != 0


def combined_mask(codes: Column) -> Column:
    return F.aggregate(codes, F.lit(0), lambda m, c: m.bitwiseOR(base_mask(c)))


def pure_indel(ref: Column, alt: Column) -> Column:
    """One side empty after trimming."""
    return (F.length(ref) != F.length(alt)) & ((F.length(ref) == 0) | (F.length(alt) == 0))


def variant(pos: Column, ref: Column, alt: Column) -> Column:
    return F.struct(pos.cast("bigint").alias("pos"), ref.alias("ref"), alt.alias("alt"))


def split_indel(raw: Column) -> Column:
    """struct(substitution, indel) of a trimmed variant that changes both bases and length.

    The shorter allele is matched at the left of the longer one: what differs there is the
    substitution, what is left over the pure indel. For other variants the indel is null.
    """
    pos, ref, alt = raw["pos"], raw["ref"], raw["alt"]
    n = F.least(F.length(ref), F.length(alt))
    differing = n - common_suffix(F.substr(ref, F.lit(1), n), F.substr(alt, F.lit(1), n))
    rest_ref, rest_alt = F.substr(ref, differing + 1, F.length(ref)), F.substr(alt, differing + 1, F.length(alt))
    at = differing + F.least(common_prefix(rest_ref, rest_alt), n - differing)
    both = F.struct(
        variant(pos, F.substr(ref, F.lit(1), differing), F.substr(alt, F.lit(1), differing)).alias("substitution"),
        variant(pos + at, F.substr(ref, at + 1, F.length(ref)), F.substr(alt, at + 1, F.length(alt))).alias("indel"),
    )
    none = F.lit(None).cast("struct<pos:bigint,ref:string,alt:string>")
    mixed = (F.length(ref) > 0) & (F.length(alt) > 0) & (F.length(ref) != F.length(alt))
    return F.when(mixed, both).otherwise(F.struct(variant(pos, ref, alt).alias("substitution"), none.alias("indel")))


def join_variants(first: Column, second: Column, bases: Column, start: Column) -> Column:
    """One variant for two that follow each other; bases: the reference from start on. Overlap gives null."""
    after = first["pos"] + F.length(first["ref"])
    gap = F.substr(bases, (after - start + 1).cast("int"), (second["pos"] - after).cast("int"))
    joined = variant(first["pos"], F.concat(first["ref"], gap, second["ref"]), F.concat(first["alt"], gap, second["alt"]))
    return F.when(second.isNull(), first).when(first.isNull(), second).when(second["pos"] >= after, joined)


def covered_reference(raws: Column) -> Column:
    """The reference over sorted variants (pos, ref, alt), with `.` where none of them has it."""
    first = F.get(raws, F.lit(0))["pos"]

    def add(text: Column, v: Column) -> Column:
        at = (v["pos"] - first).cast("int")
        padded = F.rpad(text, F.greatest(F.length(text), at), ".")
        return F.concat(padded, F.substr(v["ref"], F.length(padded) - at + 1, F.length(v["ref"])))

    return F.aggregate(raws, F.lit(""), add)


def indel_aware_span(pos: Column, ref: Column, alts: Column) -> Column:
    """Half-open span of a record in which padded indels count from behind their padding."""

    def span(alt: Column) -> Column:
        start = pos - 1 + common_prefix(ref, alt)
        longer = F.length(alt) > F.length(ref)
        stop = F.when(longer, start + 1).when(F.length(alt) < F.length(ref), start + F.length(ref)).otherwise(pos - 1 + F.length(ref))
        return F.struct(F.when(longer, start + 1).otherwise(start).alias("start"), stop.alias("stop"))

    spans = F.transform(alts, span)
    return F.struct(
        F.least(pos, F.array_min(F.transform(spans, lambda s: s.start))).cast("bigint").alias("start"),
        F.greatest(pos, F.array_max(F.transform(spans, lambda s: s.stop))).cast("bigint").alias("stop"),
    )


def bases_of(code: Column) -> Column:
    """The bases that an IUPAC code stands for."""
    mask = base_mask(code)
    return F.filter(F.array(*[F.lit(b) for b in "ACGT"]), lambda b: base_mask(b).bitwiseAND(mask) != 0)
