"""Operators over sequences: runs, token counts, reference checks, contigs, left alignment.

A sequences table is (name, seq), of ASCII letters, or already (name, chunk, offset, bases, length)
in pieces of PIECE bases, as sources.fasta.pieces reads them, so that no row ever holds a record.
chunked() cuts the former into pieces keyed by (name, chunk); alignment, runs, token counts,
reference checks and contigs meet these pieces, never a whole sequence.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alleles as al
from ..sources.staging import staged

PIECE = 1 << 14


def homopolymers(seqs: DataFrame, least: int = 5, ignored: str = "", names: list[str] | None = None, size: int = PIECE) -> DataFrame:
    """Maximal runs of one character, (name, start, stop, base), half-open from 0.

    ignored: characters to leave out; with a leading `-`, the only ones to keep. Runs inside a piece
    of the sequence come from one expression over the piece; those at its borders, two for a piece
    at most, are put together along the sequence.
    """
    if names is not None:
        seqs = seqs.filter(F.col("name").isin(names))
    p = pieces_of(seqs, size)
    shape = F.lit(rf"(?s)(.*?)((.)\3{{{max(least, 1) - 1},}})")
    gaps, runs = F.regexp_extract_all("bases", shape, 1), F.regexp_extract_all("bases", shape, 2)
    end = F.col("offset") + F.length("bases")
    found = p.select("name", "offset", end.alias("end"), F.posexplode(F.arrays_zip(gaps.alias("gap"), runs.alias("run"))).alias("i", "r"))
    upto = Window.partitionBy("name", "offset").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    n = F.length("r.run").cast("bigint")
    found = found.withColumn("stop", F.col("offset") + F.sum(F.length("r.gap") + n).over(upto)).withColumn("start", F.col("stop") - n)
    inner = found.filter((F.col("start") > F.col("offset")) & (F.col("stop") < F.col("end"))).select("name", "start", "stop", F.substring("r.run", 1, 1).alias("base"))
    head, tail = F.regexp_extract("bases", r"(?s)^((.)\2*)", 1), F.reverse(F.regexp_extract(F.reverse("bases"), r"(?s)^((.)\2*)", 1))
    sides = F.array(
        F.struct(F.col("offset").alias("start"), (F.col("offset") + F.length(head)).alias("stop"), F.substring(head, 1, 1).alias("base")),
        F.struct((end - F.length(tail)).alias("start"), end.alias("stop"), F.substring(tail, 1, 1).alias("base")),
    )
    sides = p.select("name", F.explode(F.array_distinct(sides)).alias("r")).select("name", "r.*")
    w = Window.partitionBy("name").orderBy("start")
    joins = (F.lag("stop").over(w) == F.col("start")) & (F.lag("base").over(w) == F.col("base"))
    sides = sides.withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sides = sides.groupBy("name", "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.first("base").alias("base"))
    out = inner.unionByName(sides.filter(F.col("stop") - F.col("start") >= least).select("name", "start", "stop", "base"))
    if ignored.startswith("-"):
        out = out.filter(F.col("base").isin(list(ignored[1:])))
    elif ignored:
        out = out.filter(~F.col("base").isin(list(ignored)))
    return out


def check_tokens(specs: list[str]) -> list[tuple[str, list[str]]]:
    """Token classes such as `a/t` or `cg`; letters and digits only, none twice."""
    seen: set[str] = set()
    out = []
    for spec in specs:
        words = [w.upper() for w in spec.split("/")]
        for w in words:
            if not re.fullmatch(r"[A-Z0-9]+", w):
                raise ValueError(f"bad token in {spec!r}")
            if w in seen:
                raise ValueError(f"token {w!r} is given twice")
            seen.add(w)
        out.append((spec, words))
    return out


DEFAULT_TOKENS = ("a/t", "c/g", "cg")


def token_counts(regions: DataFrame, seqs: DataFrame, tokens=DEFAULT_TOKENS, with_bases: bool = False) -> DataFrame:
    """Per region, the bases covered by each token class, one column for each class.

    Tokens are matched from left to right without overlap, longest first, in the region widened
    by the longest token less one; a match counts with its bases inside the region. The stop is
    that of the bases really there.
    """
    specs = check_tokens(list(tokens))
    words = sorted((w for _, ws in specs for w in ws), key=lambda w: -len(w))
    pad = len(words[0]) - 1
    lo = F.greatest(F.lit(0), F.col("start") - pad).cast("bigint")
    wide = regions.groupBy("chrom", "start", "stop").agg(F.count("*").alias("_copies")).withColumns({"_lo": lo, "_hi": (F.col("stop") + pad).cast("bigint")})
    r = bases_between(wide, seqs, "_lo", "_hi").withColumn("_w", F.upper("_text"))
    r = r.withColumn("stop", F.least(F.col("stop"), F.col("_length")))
    if pad == 0:  # single letters don't take bases from each other
        counts = {f"c{i}": F.length("_w") - F.length(F.translate("_w", "".join(ws), "")) for i, (_, ws) in enumerate(specs)}
        out = r.withColumn("_acc", F.struct(*[c.cast("bigint").alias(k) for k, c in counts.items()]))
    else:
        pieces = F.regexp_extract_all("_w", F.lit("(?s)(" + "|".join(words) + "|.)"), 1)
        acc = F.aggregate(
            pieces,
            F.struct(F.col("_lo").alias("at"), *[F.lit(0).cast("bigint").alias(f"c{i}") for i in range(len(specs))]),
            lambda s, x: F.struct(
                (s.at + F.length(x)).alias("at"),
                *[
                    (s[f"c{i}"] + F.when(x.isin(ws), F.greatest(F.lit(0), F.least(s.at + F.length(x), F.col("stop")) - F.greatest(s.at, F.col("start")))).otherwise(0)).alias(f"c{i}")
                    for i, (_, ws) in enumerate(specs)
                ],
            ),
        )
        out = r.withColumn("_acc", acc)
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies")))
    cols = ["chrom", "start", "stop", *[F.col(f"_acc.c{i}").alias(spec) for i, (spec, _) in enumerate(specs)]]
    if with_bases:
        cols.append(F.substr("_text", (F.col("start") - F.col("_lo") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int")).alias("bases"))
    return out.select(*cols)


def bases_between(regions: DataFrame, seqs: DataFrame, lo: str, hi: str, size: int = PIECE) -> DataFrame:
    """regions (chrom, ...; distinct rows) with _text, the bases from lo up to hi, and _length, the sequence's length.

    A region meets the pieces it covers alone, by (name, piece), and takes its own bases from each;
    regions on unknown sequences are left out.
    """
    r = regions.join(lengths_of(seqs).withColumnsRenamed({"name": "chrom", "length": "_length"}), "chrom")
    last = F.greatest(F.least(F.col(hi), F.col("_length")) - 1, F.col(lo))
    met = r.withColumn("chunk", F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(last / size))))
    p = pieces_of(seqs, size).withColumnRenamed("name", "chrom")
    met = met.join(p, ["chrom", "chunk"], "left")
    a = F.greatest(F.col(lo) - F.col("offset"), F.lit(0))
    part = F.substr("bases", (a + 1).cast("int"), F.greatest(F.least(F.col(hi) - F.col("offset"), F.lit(size)) - a, F.lit(0)).cast("int"))
    keys = [c for c in r.columns]
    g = met.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chunk", part.alias("part")))).alias("_parts"))
    return g.withColumn("_text", F.array_join(F.transform("_parts", lambda x: x.part), "")).drop("_parts")


def with_bases(rows: DataFrame, seqs: DataFrame, lo: str, hi: str) -> DataFrame:
    """rows (chrom, ...), repeated ones too, with _text and _length of bases_between; each distinct region is put together once."""
    keys = list(dict.fromkeys(["chrom", lo, hi]))
    return rows.join(bases_between(rows.select(*keys).distinct(), seqs, lo, hi), keys)


def part_of(lo: Column, start: Column, stop: Column) -> Column:
    """Bases [start, stop) out of _text, which begins at lo."""
    return F.substr("_text", (start - lo + 1).cast("int"), F.greatest(stop - start, F.lit(0)).cast("int"))


def reference_mismatches(variants: DataFrame, seqs: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Variants (chrom, start, stop, ref) whose reference allele isn't what the sequence has.

    An insertion's `*` never equals the empty bases, so insertions count as mismatches; so do
    soft-masked bases unless ignore_case. An unknown sequence or a region beyond its end is an
    error text, not a mismatch.
    """
    keys = ["chrom", "start", "stop"]
    there = bases_between(variants.select(*keys).distinct(), seqs, "start", "stop")
    r = variants.join(there, keys, "left")
    found = F.upper("_text") if ignore_case else F.col("_text")
    error = F.when(F.col("_length").isNull(), F.lit("unknown sequence")).when(F.col("stop") > F.col("_length"), F.lit("out of range"))
    r = r.withColumns({"found": found, "error": error})
    return r.filter(F.col("error").isNotNull() | (F.col("found") != F.upper("ref"))).drop("_text", "_length")


def repeated_left(ref: Column, alt: Column, left: Column) -> Column:
    """How many of the bases before a trimmed pure indel repeat it, read backwards; 0 for other variants."""
    x = F.when(F.length(ref) > 0, ref).otherwise(alt)
    n = F.length(x)
    cyclic = F.substr(F.repeat(F.reverse(x), (F.length(left) / F.greatest(n, F.lit(1)) + 1).cast("int")), F.lit(1), F.length(left))
    return F.when(al.pure_indel(ref, alt) & (F.length(left) > 0), al.common_prefix(F.reverse(left), cyclic)).otherwise(0).cast("bigint")


def moved_left(pos: Column, ref: Column, alt: Column, shift: Column) -> Column:
    """struct(pos, ref, alt, shift) of a trimmed variant moved to the left over repeats of itself."""
    indel = al.pure_indel(ref, alt)
    x = F.when(F.length(ref) > 0, ref).otherwise(alt)
    n = F.length(x)
    turn = F.when(indel, F.pmod(shift, n)).otherwise(0).cast("int")
    moved = F.concat(F.substr(x, n - turn + 1, turn), F.substr(x, F.lit(1), n - turn))
    return F.struct(
        (pos - shift).alias("pos"),
        F.when(indel & (F.length(ref) > 0), moved).otherwise(ref).alias("ref"),
        F.when(indel & (F.length(alt) > 0), moved).otherwise(alt).alias("alt"),
        shift.alias("shift"),
    )


def left_shift(pos: Column, ref: Column, alt: Column, left: Column) -> Column:
    """Leftmost form of a trimmed pure indel; left: the bases before pos, as many as are at hand.

    struct(pos, ref, alt, shift). Other variants stay. If shift reaches the length of left,
    more bases could shift it further: call again with a longer left.
    """
    return moved_left(pos, ref, alt, repeated_left(ref, alt, left))


def left_aligned(variants: DataFrame, seqs: DataFrame, windows=(64, 4096, 1 << 17), size: int = PIECE) -> DataFrame:
    """Trimmed variants (chrom, pos, ref, alt, ...) in leftmost form, with the shift.

    Every variant meets the piece of its sequence that holds its position, with as many bases before
    the piece as the first window has. Only where it repeats all of a window, the bases of the next
    one are put together from their pieces, and at last those before its position. Each step's rows are a
    table in the shared folder, so that the sequences are only read again while such rows are left. Rows on unknown
    sequences stay as they are.
    """
    first = windows[0]
    keep = [c for c in variants.columns if c not in ("pos", "ref", "alt")]
    p = pieces_of(seqs, size, first).select(F.col("name").alias("chrom"), "chunk", F.col("offset").alias("_offset"), F.col("bases").alias("_bases"))
    r = variants.withColumn("chunk", F.floor((F.col("pos") - 1) / size)).join(p, ["chrom", "chunk"], "left").drop("chunk")
    before = F.col("pos") - 1 - F.col("_offset")
    n = F.least(before, F.lit(first)).cast("int")
    left = F.coalesce(F.substr("_bases", (before - n + 1).cast("int"), n), F.lit(""))
    r = staged(r.withColumn("_shift", repeated_left(F.col("ref"), F.col("alt"), left)).drop("_bases", "_offset"), "aligned")
    out, rest = r.filter(F.col("_shift") < first), r.filter(F.col("_shift") >= first)
    for width in (*windows[1:], None):
        if rest.isEmpty():
            break
        lo = F.lit(0).cast("bigint") if width is None else F.greatest(F.col("pos") - 1 - width, F.lit(0))
        met = with_bases(rest.withColumns({"_lo": lo, "_hi": F.col("pos") - 1}), seqs, "_lo", "_hi")
        met = staged(met.withColumn("_shift", repeated_left(F.col("ref"), F.col("alt"), F.col("_text"))).select(*r.columns), "aligned")
        out = out.unionByName(met if width is None else met.filter(F.col("_shift") < width))
        rest = met.filter(F.lit(False)) if width is None else met.filter(F.col("_shift") >= width)
    return out.withColumn("_s", moved_left(F.col("pos"), F.col("ref"), F.col("alt"), F.col("_shift"))).select(*keep, "_s.pos", "_s.ref", "_s.alt", "_s.shift")


def variant_contigs(variants: DataFrame, seqs: DataFrame, flank: int = 99, least_qual: float = 0) -> DataFrame:
    """Flanked sequence of each alternative allele with its place and CIGAR.

    variants: (chrom, pos, id, ref, alts[, qual]); rows without an id have no contig.
    """
    v = variants.filter(F.col("id").isNotNull() & (F.col("id") != "."))
    if "qual" in variants.columns and least_qual > 0:
        v = v.filter(F.col("qual") >= least_qual)
    v = v.select("*", F.posexplode("alts").alias("alt_index", "alt_text"))
    raw = al.trimmed(F.col("pos"), F.upper("ref"), F.upper("alt_text"))
    v = v.withColumn("_r", raw).withColumns({"p": F.col("_r.pos"), "r": F.col("_r.ref"), "a": F.col("_r.alt")})
    pre = F.when(F.col("p") <= flank, F.col("p") - 1).otherwise(flank)
    v = v.withColumns({"pre": pre, "_lo": F.greatest(F.lit(1), F.col("p") - pre) - 1, "_hi": F.col("p") + F.length("r") - 1 + flank})
    v = with_bases(v, seqs, "_lo", "_hi")
    stop = F.least(F.col("_hi"), F.col("_length"))
    after = F.col("p") - 1 + F.length("r")
    v = v.withColumns({"c_start": F.col("_lo") + 1, "c_stop": stop, "post": F.greatest(stop - after, F.lit(0))})
    seq = F.concat(part_of(F.col("_lo"), F.col("_lo"), F.col("p") - 1), "a", part_of(F.col("_lo"), after, after + F.col("post")))
    both = F.least(F.length("r"), F.length("a"))
    extra = F.length("r") - F.length("a")
    first = F.col("pre") + both
    tail = F.col("post")
    cigar = (
        F.when(extra > 0, F.concat(_op(first, "M"), _op(extra, "D"), _op(tail, "M")))
        .when(extra < 0, F.concat(_op(first, "M"), _op(-extra, "I"), _op(tail, "M")))
        .otherwise(_op(first + tail, "M"))
    )
    name = F.concat_ws("_", "id", "pos", F.col("alt_index").cast("string"))
    return v.select("chrom", name.alias("name"), F.col("c_start").alias("start"), F.col("c_stop").alias("stop"), cigar.alias("cigar"), seq.alias("contig"))


def _op(n: Column, kind: str) -> Column:
    return F.when(n > 0, F.concat(n.cast("bigint").cast("string"), F.lit(kind))).otherwise("")


def transcripts(regions: DataFrame, seqs: DataFrame, pad: int = 0, wrap: int = 60) -> DataFrame:
    """Regions (transcript, chrom, start, stop) stitched in order: sequence in wrapped lines, and M/N CIGAR.

    pad widens the first region to the left and the last one to the right, within the sequence.
    """
    w = Window.partitionBy("transcript").orderBy("start", "stop")
    r = regions.withColumns({"_prev": F.lag("stop").over(w), "_next": F.lead("start").over(w)})
    lo = F.when(F.col("_prev").isNull(), F.greatest(F.lit(0), F.col("start") - pad)).otherwise(F.col("start"))
    hi = F.when(F.col("_next").isNull(), F.col("stop") + pad).otherwise(F.col("stop"))
    r = with_bases(r.withColumns({"_lo": lo, "_hi": hi}), seqs, "_lo", "_hi")
    r = r.withColumn("_hi", F.when(F.col("_next").isNull(), F.least("_hi", "_length")).otherwise(F.col("_hi")))
    part = F.struct(
        F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_text").alias("bases"),
        F.concat(_op(F.col("_lo") - F.col("_prev"), "N"), _op(F.col("_hi") - F.col("_lo"), "M")).alias("op"),
    )
    g = r.groupBy("transcript", "chrom").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    seq = F.array_join(F.transform("parts", lambda x: x.bases), "")
    lines = F.regexp_replace(seq, f"(.{{{wrap}}})(?=.)", "$1\n")
    return g.select(
        "transcript", "chrom", F.element_at("parts", 1)["lo"].alias("start"), F.element_at("parts", -1)["hi"].alias("stop"),
        F.array_join(F.transform("parts", lambda x: x.op), "").alias("cigar"), lines.alias("contig"),
    )


def chunked(seqs: DataFrame, size: int = PIECE, overlap: int = 1 << 10, before: int = 0) -> DataFrame:
    """(name, chunk, offset, bases): sequences in pieces for joins by (name, start div size).

    A piece goes on for overlap bases into the next one, and begins up to before bases ahead of its
    own place; offset is where its bases begin. Cut as bytes, which needs no walk along the text.
    """
    raw = F.col("seq").cast("binary")
    lo = lambda c: F.greatest(c * size - before, F.lit(0))
    piece = lambda c: F.struct(
        c.alias("chunk"), lo(c).cast("bigint").alias("offset"),
        F.substring(raw, (lo(c) + 1).cast("int"), (c * size - lo(c) + size + overlap).cast("int")).cast("string").alias("bases"),
    )
    pieces = F.transform(F.sequence(F.lit(0).cast("bigint"), F.floor((F.length("seq") - 1) / size)), piece)
    return seqs.filter(F.length("seq") > 0).select("name", F.explode(pieces).alias("p")).select("name", "p.*")


def pieces_of(seqs: DataFrame, size: int = PIECE, before: int = 0) -> DataFrame:
    """(name, chunk, offset, bases) of a sequences table in either form, each piece with the bases before it that are asked for."""
    if "seq" in seqs.columns:
        return chunked(seqs, size, 0, before)
    if size != PIECE:
        raise ValueError(f"pieces that are read as such have {PIECE} bases")
    p = seqs.select("name", "chunk", "offset", "bases")
    if before <= 0:
        return p
    if before > size:
        raise ValueError("a piece can begin within the piece before it, not further ahead")
    ends = p.select("name", (F.col("chunk") + 1).alias("chunk"), F.substr("bases", F.lit(size - before + 1), F.lit(before)).alias("_end"))
    head = F.coalesce("_end", F.lit(""))
    return p.join(ends, ["name", "chunk"], "left").select("name", "chunk", (F.col("offset") - F.length(head)).alias("offset"), F.concat(head, "bases").alias("bases"))


def lengths_of(seqs: DataFrame) -> DataFrame:
    """(name, length) of a sequences table in either form."""
    if "seq" in seqs.columns:
        return seqs.select("name", F.length("seq").cast("bigint").alias("length"))
    return seqs.groupBy("name").agg(F.max(F.col("offset") + F.length("bases")).cast("bigint").alias("length"))


def base_contigs(variants: DataFrame, seqs: DataFrame, flank: int = 99) -> DataFrame:
    """Contigs of interval variants (chrom, start, stop, ref, alt), one for each base an IUPAC code stands for.

    (name, seq); the name carries place, CIGAR with = and X, the variant's span in the contig,
    and its bases.
    """
    v = variants.withColumns({"_lo": F.greatest(F.col("start") - flank, F.lit(0)), "_end": F.col("stop") + flank})
    v = with_bases(v, seqs, "_lo", "_end")
    lo, hi = F.col("_lo"), F.col("_end")
    fits = hi <= F.col("_length")
    snp, gone = (F.length("ref") == 1) & (F.length("alt") == 1), F.length("alt") == 0
    options = F.when(snp, F.filter(al.bases_of(F.col("alt")), lambda b: b != F.upper("ref"))).when(gone, F.array("ref")).otherwise(F.array("alt"))
    v = v.withColumns({
        "_hi": F.when(fits, hi).otherwise(F.col("stop")), "_pre": part_of(lo, lo, F.col("start")),
        "_post": F.when(fits, part_of(lo, F.col("stop"), hi)).otherwise(""), "_gone": gone, "_snp": snp, "_bases": F.explode(options),
    })
    size = F.length("_bases")
    change = F.when(F.col("_snp"), "1X").when(F.col("_gone"), _op(size, "D")).otherwise(_op(size, "I"))
    cigar = F.concat(_op(F.length("_pre"), "="), change, _op(F.length("_post"), "="))
    end = F.length("_pre") + F.when(F.col("_gone"), 0).otherwise(size)
    parts = [F.concat(F.lit("REMAP-"), "chrom"), F.col("_lo"), F.col("_hi"), cigar, F.length("_pre"), end, F.col("_bases")]
    name = F.concat_ws("|", *[p.cast("string") for p in parts])
    return v.select(name.alias("name"), F.concat("_pre", F.when(F.col("_gone"), "").otherwise(F.col("_bases")), "_post").alias("seq"))
