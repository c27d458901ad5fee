"""One function for each command: options and DataFrames in, DataFrames out.

Results are unordered; the sinks order them. Options that change results have the defaults of
the command line.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alleles as al
from ..functions import genotype as g
from ..operators import annotate, calls, cigar, compare, islands, merging, overlap, reach, report, sequences, signal, sorting
from ..sources import text
from . import projection


def bed_merge(rows: DataFrame, distance: int = 0, names: bool = False, count: bool = False, unique_names: bool = False) -> DataFrame:
    """Merged intervals; names come from the first extra column."""
    rows = rows.withColumn("name", F.try_element_at("extra", F.lit(1))) if "extra" in rows.columns else rows
    return islands.merged(rows, distance, "name" if names else None, count, "name" if unique_names else None)


def check_ref(variants: DataFrame, seqs: DataFrame, ignore_case: bool = False) -> tuple[DataFrame, DataFrame]:
    """(misses with what the sequence has, their number)."""
    bad = sequences.reference_mismatches(variants, seqs, ignore_case)
    return bad, bad.filter("error is null").agg(F.count("*").alias("mismatches"))


def create_contigs(variants: DataFrame, seqs: DataFrame, flank: int = 99, quality: float = 0) -> tuple[DataFrame, DataFrame]:
    """(name, seq) of the contigs, and (name, place chrom|start|stop, cigar) to map them back."""
    c = sequences.variant_contigs(variants, seqs, flank, quality)
    place = F.concat_ws("|", "chrom", F.col("start").cast("string"), F.col("stop").cast("string"))
    return c.select("name", F.col("contig").alias("seq")), c.select("name", place.alias("place"), "cigar")


def find_homopolymers(seqs: DataFrame, least: int = 5, ignored: str = "", names: list[str] | None = None) -> DataFrame:
    return sequences.homopolymers(seqs, least, ignored, names)


def generate(spark: SparkSession, n: int = 100, seed: int | None = None) -> DataFrame:
    import time

    return text.random_intervals(spark, n, int(time.time()) if seed is None else seed)


@dataclass
class Intersect:
    """Options of intersect(); dbsnp implies exact alleles and IUPAC matching."""

    format: str = "A"
    output_both: bool = False
    full: bool = False
    exact_pos: bool = False
    exact_allele: bool = False
    iub_match: bool = False
    dbsnp_match: bool = False
    adjacent_insertions: bool = False
    first_only: bool = False

    def output(self) -> str:
        return "I A B" if self.full else "A B" if self.output_both else self.format


def _one_of_each(df: DataFrame, keys: list) -> DataFrame:
    """The first row for each value of the keys (expressions), by the columns `ord` and `line` where there are such, else by the rows' text."""
    order = [c for c in ("ord", "line", "extra") if c in df.columns]
    if not {"ord", "line"} & set(df.columns) and not any("map<" in kind for _, kind in df.dtypes):
        df = df.distinct()
    same = [k for k in keys if isinstance(k, str)]
    by = [*same, *[k.alias("_k") for k in keys if not isinstance(k, str)]]
    rest = [c for c in df.columns if c not in same]
    if not rest:
        return df
    first = F.min_by(F.struct(*rest), F.struct(*order)) if order else F.first(F.struct(*rest))
    return df.groupBy(*by).agg(first.alias("_row")).select(*same, "_row.*")


def intersect(a: DataFrame, b: DataFrame, o: Intersect = Intersect()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines of hits, rows of a without a partner, rows of b without one).

    Unless both sides are asked for by output_both or full, rows of a with the same place and alleles
    give one line, whatever the format shows: that of the first pair, by the column `ord` of a and of
    b where they have one, else by the partner's place and the rows' text. B rows without a partner
    are those that match no row of a under the whole predicate.

    What a row meets depends on its place and alleles alone, so but for output_both and full one row of
    each stands for those that share them: pairs don't grow with the depth of a place.
    """
    by_alleles = o.exact_allele or o.iub_match or o.dbsnp_match
    if by_alleles:
        a, b = (df if "ref" in df.columns else text.as_variants(df) for df in (a, b))
    keys_a = ("start", "stop", "ref", "alt") if by_alleles else ("start", "stop")
    keys_b = (*keys_a, "alleles") if o.dbsnp_match else keys_a

    tiers = None if by_alleles or o.exact_pos else overlap.tiers_in_use((a, b))

    def paired(a: DataFrame, b: DataFrame) -> DataFrame:
        if by_alleles:
            rule = (F.col("a_ref") == F.col("b_ref")) & (F.col("a_alt") == F.col("b_alt"))
            if o.iub_match or o.dbsnp_match:
                rule = overlap.partial_allele_match()
            if o.dbsnp_match:
                rule = overlap.strand_agnostic_match(F.split(F.col("b_alleles"), "/"))
            pairs = overlap.equal_join(a, b, ("chrom", "start", "stop"), None)
            pairs = pairs.withColumns({f"{s}_{k}": F.col(k) for s in "ab" for k in ("start", "stop")}).filter(rule)
        elif o.exact_pos:
            pairs = overlap.equal_join(a, b).withColumns({f"{s}_{k}": F.col(k) for s in "ab" for k in ("start", "stop")})
        else:
            pairs = overlap.overlap_join(a, b, o.adjacent_insertions, tiers=tiers)
        for side in "ab":
            if f"{side}_extra" not in pairs.columns:
                pairs = pairs.withColumn(f"{side}_extra", F.array().cast("array<string>"))
        return pairs

    if "ref" in a.columns:
        alleles = ["ref", "alt"]
    else:
        alleles = [text.alleles_of(F.col("extra"))] if "extra" in a.columns else []
    few = paired(_one_of_each(a, ["chrom", "start", "stop", *alleles]), _one_of_each(b, ["chrom", *keys_b]))
    if o.output_both or o.full:
        hits = paired(a, b)
    else:
        alleles = F.struct("a_ref", "a_alt") if "a_ref" in few.columns else text.alleles_of(F.col("a_extra"))
        order = [c for c in ("a_ord", "a_line", "b_start", "b_stop", "b_ord", "b_line", "a_extra", "b_extra") if c in few.columns]
        first = F.min_by(F.struct(*[c for c in few.columns if c not in ("chrom", "a_start", "a_stop")]), F.struct(*order))
        hits = few.groupBy("chrom", "a_start", "a_stop", alleles.alias("_alleles")).agg(first.alias("_row")).select("chrom", "a_start", "a_stop", "_row.*")
    lines = hits.select(projection.line(o.output()).alias("line"))
    if not by_alleles and not o.exact_pos:  # the predicate is the place alone
        return lines, reach.anti(a, b, o.adjacent_insertions), reach.anti(b, a, o.adjacent_insertions)
    return lines, overlap.anti(a, few, "a", keys_a), overlap.anti(b, few, "b", keys_b)


def ref_stats(regions: DataFrame, seqs: DataFrame, tokens=sequences.DEFAULT_TOKENS, bases: bool = False) -> DataFrame:
    return sequences.token_counts(regions, seqs, tokens, bases)


def remap_cigar(lines: DataFrame) -> DataFrame:
    return lines.select(cigar.remapped_lines(F.col("line")).alias("line"))


def sort(frames: list[DataFrame], unique: bool = False, ordinal: str | None = None, allele: str = "alleles") -> DataFrame:
    """Rows of all frames in natural order of locus, ties by source and ordinal."""
    return sorting.sorted_union(frames, ordinal, unique, allele)


def vcf_to_raw(rows: DataFrame, seqs: DataFrame) -> DataFrame:
    """(chrom, pos, alleles): alternatives trimmed and left-aligned, empty alleles as `*`."""
    raw = annotate.exploded(rows.withColumn("a_id", F.struct("source", "ord")), "a_id")
    out = sequences.left_aligned(raw, seqs)
    show = lambda c: F.when(F.col(c) == "", "*").otherwise(F.col(c))
    return out.select("chrom", "pos", F.concat_ws("/", show("ref"), show("alt")).alias("alleles"))


def vcf_annotate(rows: DataFrame, notes: DataFrame, specs: list[str] | None, numbers: dict[str, str], info: bool = True, ids: bool = True) -> DataFrame:
    a = rows.withColumn("a_id", F.col("ord"))
    b = notes.withColumn("b_id", F.col("ord"))
    fields = (specs if specs is not None else sorted(numbers)) if info else []
    return annotate.annotated(a, b, fields, numbers, ids).drop("a_id")


def vcf_annotate_homopolymers(rows: DataFrame, runs: DataFrame, longest: int = 2, name: str = "HOMP_FILTER") -> DataFrame:
    flags = annotate.homopolymer_flags(rows.withColumn("v_id", F.col("ord")), runs, longest)
    out = rows.join(flags.withColumnRenamed("v_id", "ord"), "ord", "left")
    entry = F.create_map(F.lit(name), F.col("flags").cast("array<string>"))
    base = F.map_filter("info", lambda k, v: k != name)
    return out.withColumn("info", F.when(F.col("flags").isNotNull(), F.map_concat(base, entry)).otherwise(F.col("info"))).select(*rows.columns)


def comparison_calls(rows: DataFrame, modes: dict[int, str] | None = None, include_ref: bool = False) -> DataFrame:
    """Calls of records as compare wants them: bundles of overlapping records, alleles as trimmed variants."""
    rows = merging.with_islands(rows)
    c = rows.select("source", F.col("ord").alias("record"), F.concat_ws(":", "chrom", F.col("island").cast("string")).alias("bundle"), "pos", "ref", "alts", F.explode("samples").alias("sample", "fields"))
    gt, ft = F.try_element_at("fields", F.lit("GT")), F.try_element_at("fields", F.lit("FT"))
    c = c.withColumns({"gt": gt, "ft": ft}).filter(~g.is_empty(F.col("gt")))
    rule = F.lit(False)
    for mode in ("filtered", "unfiltered", "both"):
        own = [s for s, m in (modes or {}).items() if m == mode]
        pick = F.col("source").isin(own) if own else F.lit(False)
        if mode == "unfiltered":
            pick = pick | ~F.col("source").isin([s for s in modes or {}] or [-1])
        rule = rule | (pick & calls.filter_mode(F.col("ft"), mode))
    c = c.filter(rule)
    if not include_ref:
        c = c.filter(~g.is_reference(F.col("gt")))

    def allele(i):
        raw = al.trimmed(F.col("pos"), F.upper("ref"), F.upper(F.try_element_at("alts", i)))
        text_of = F.concat_ws("|", raw["pos"].cast("string"), raw["ref"], raw["alt"])
        return F.when(i.isNull(), "none").when(i == 0, F.concat_ws("|", F.col("pos").cast("string"), F.lit(""), F.lit(""))).otherwise(text_of)

    ids = g.indices(F.col("gt"))
    ids = ids if include_ref else F.filter(ids, lambda x: x.isNull() | (x > 0))
    c = c.withColumn("alleles", F.array_sort(F.transform(ids, allele)))
    return c.select("bundle", "source", "record", "sample", "alleles", F.exists(g.indices(F.col("gt")), lambda x: x.isNull()).alias("has_null"))


def vcf_compare(rows: DataFrame, n_files: int, samples: list[str], modes: dict[int, str] | None = None, include_ref: bool = False) -> tuple[DataFrame, DataFrame]:
    """(counts by mask and kind, match vectors by record and sample); beyond MAX_DENSE files only masks that occur are listed."""
    c = comparison_calls(rows, modes, include_ref).filter(F.col("sample").isin(samples))
    counts = compare.mask_counts(c, compare.words_for(n_files))
    table = compare.dense_table if n_files <= compare.MAX_DENSE else compare.sparse_table
    return table(counts, n_files, samples), compare.match_vectors(c, n_files)


def with_match_fields(rows: DataFrame, vectors: DataFrame, exact: str = "EXSEC", partial: str = "PXSEC") -> DataFrame:
    """Records whose compared samples have the match vectors as two more fields."""
    entry = F.struct("sample", F.struct(F.array_join("exact", ",").alias("e"), F.array_join("partial", ",").alias("p")))
    found = vectors.groupBy("source", F.col("record").alias("ord")).agg(F.map_from_entries(F.collect_list(entry)).alias("_found"))
    out = rows.join(found, ["source", "ord"], "left")
    own = lambda k: F.try_element_at("_found", k)
    more = F.transform_values("samples", lambda k, c: F.when(own(k).isNull(), c).otherwise(F.map_concat(c, F.create_map(F.lit(exact), own(k)["e"], F.lit(partial), own(k)["p"]))))
    form = F.when(F.col("_found").isNull(), F.col("format")).otherwise(F.concat("format", F.array(F.lit(exact), F.lit(partial))))
    return out.withColumns({"samples": F.when(F.col("_found").isNull(), F.col("samples")).otherwise(more), "format": form}).select(*rows.columns)


def _with_samples(rows: DataFrame, keep) -> DataFrame:
    return rows.withColumn("samples", F.map_filter("samples", keep))


def vcf_filter(rows: DataFrame, min_depth: int = 0) -> DataFrame:
    """Blanks calls of low or missing depth, drops records without any data left."""
    out = _with_samples(rows, lambda k, v: F.coalesce(F.try_element_at(v, F.lit("DP")).try_cast("int") >= min_depth, F.lit(False)))
    return out.filter(F.size("samples") > 0)


def vcf_site_filter(rows: DataFrame, fraction: float = 1.0) -> DataFrame:
    """Adds the site filter, or PASS (also where no sample has a filter text); records without an FT field are dropped."""
    fts = F.filter(F.transform(F.map_values("samples"), lambda v: F.try_element_at(v, F.lit("FT"))), lambda x: x.isNotNull() & ~x.isin("", "."))
    failed = F.size(F.filter(fts, lambda x: x != "PASS"))
    bad = (F.size(fts) > 0) & (failed > fraction * F.size(fts))
    name = F.when(bad, calls.valid_filter_name(calls.site_filter_name(fraction))).otherwise("PASS")
    return rows.filter(F.array_contains("format", "FT")).withColumn("filters", calls.add_filter(F.col("filters"), name))


def vcf_remove_filtered_gt(rows: DataFrame, allowed: list[str] = ()) -> DataFrame:
    def fine(name, fields):
        ft = F.coalesce(F.try_element_at(fields, F.lit("FT")), F.lit("."))
        return ~g.is_filtered(ft) | ft.isin(list(allowed)) if allowed else ~g.is_filtered(ft)

    return _with_samples(rows, fine)


def vcf_merge(rows: DataFrame, strategy: merging.Strategy = merging.Strategy()) -> DataFrame:
    return merging.merge_records(rows, strategy)


def mirrored(rows: DataFrame, suffix: str) -> DataFrame:
    """Records with every sample once more under its name and a suffix."""
    again = F.transform_keys("samples", lambda k, v: F.concat(k, F.lit(suffix)))
    return rows.withColumn("samples", F.map_concat("samples", again))


def merge_stats(rows: DataFrame) -> DataFrame:
    """Sizes of the groups of overlapping records, and of those that edit one region."""
    c = merging.with_components(rows)
    kinds = (("overlapping", ["chrom", "island"]), ("one region", ["component"]))
    parts = [islands.bundle_stats(c.groupBy(*keys).agg(F.count("*").alias("n"))).select(F.lit(kind).alias("kind"), "*") for kind, keys in kinds]
    return parts[0].unionByName(parts[1])


def vcf_normalize_indels(rows: DataFrame, seqs: DataFrame) -> DataFrame:
    """Left-aligned records, padded again where an allele would be empty; others as they are."""
    key = rows.withColumn("a_id", F.struct("source", "ord"))
    raw = annotate.exploded(key, "a_id")
    moved = sequences.left_aligned(raw, seqs)
    g_ = moved.groupBy("a_id").agg(
        F.max("shift").alias("moved"), F.min("pos").alias("lo"), F.max(F.col("pos") + F.length("ref")).alias("hi"),
        F.array_sort(F.collect_list(F.struct("alt_index", "pos", "ref", "alt"))).alias("v"),
    )
    bare = F.exists("v", lambda x: (x.pos == F.col("lo")) & ((x.ref == "") | (x.alt == "")) & (x.pos + F.length(x.ref) >= F.col("hi")))
    left = F.when(bare & (F.col("lo") > 1), 1).otherwise(0)
    right = F.when(bare & (F.col("lo") == 1), 1).otherwise(0)
    # Only records that move need bases, those of their own span.
    moved = key.select("a_id", "chrom").join(g_.filter("moved > 0"), "a_id").withColumns({"_lo": F.col("lo") - left - 1, "_hi": F.col("hi") + right - 1})
    there = sequences.with_bases(moved, seqs, "_lo", "_hi").select("a_id", "v", (F.col("_lo") + 1).alias("_lo"), (F.col("_hi") + 1).alias("_hi"), "_text")
    r = key.join(there, "a_id", "left")
    shifted = F.col("_text").isNotNull()
    bases = lambda a, b: F.substr("_text", (a - F.col("_lo") + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    alts = F.transform("v", lambda x: F.concat(bases(F.col("_lo"), x.pos), x.alt, bases(x.pos + F.length(x.ref), F.col("_hi"))))
    return r.withColumns({
        "pos": F.when(shifted, F.col("_lo")).otherwise(F.col("pos")), "ref": F.when(shifted, bases(F.col("_lo"), F.col("_hi"))).otherwise(F.col("ref")),
        "alts": F.when(shifted, alts).otherwise(F.col("alts")),
    }).select(*rows.columns)


def vcf_report(rows: DataFrame, fields: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(per site, per sample) reports of the usable records whose first FORMAT key is GT."""
    sites = report.usable_sites(rows).filter(F.get("format", F.lit(0)) == "GT").withColumn("site", F.struct("source", "ord"))
    c = sites.select("site", F.explode("samples").alias("sample", "fields")).withColumns({
        "gt": F.try_element_at("fields", F.lit("GT")), "ft": F.try_element_at("fields", F.lit("FT")),
    })
    summary = report.site_summary(c).join(report.transitions_ratio(report.spectrum(c, sites)), "site", "left")
    if fields:
        novel = report.novelty(sites, list(fields)).groupBy("site").agg(F.count_if("novel").alias("n_novel"), F.count_if(~F.col("novel")).alias("n_known"))
        summary = summary.join(novel, "site", "left")
    per_site = sites.select("site", "chrom", "pos", "ref", "alts").join(summary, "site", "left")
    change = report.transitions_ratio(report.spectrum(c, sites, ("sample",)), ("sample",))
    return per_site, report.sample_summary(c).join(change, "sample", "left")


def wig_to_bed(points: DataFrame, strip_prefix: bool = False, nonzero: bool = False) -> DataFrame:
    return signal.track_intervals(points, strip_prefix, nonzero)


def make_contigs(regions: DataFrame, seqs: DataFrame, pad: int = 0) -> DataFrame:
    return sequences.transcripts(regions, seqs, pad)


def report_metrics(per_sample: DataFrame) -> DataFrame:
    """Mean and deviation of the per-sample report's counts."""
    counts = [c for c, t in per_sample.dtypes if t in ("bigint", "int", "double") and c != "sample"]
    return report.set_metrics(per_sample, counts)
