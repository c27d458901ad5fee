"""A thin command line: python -m helixspan.plans.cli COMMAND OPTIONS. Outputs are folders of text."""
from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import merging, sequences
from ..sources import fasta, sinks, text, vcf
from ..sources.staging import scratch
from . import commands


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="helixspan")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, *options):
        s = sub.add_parser(name)
        for flags, more in options:
            s.add_argument(*flags, **more)
        s.add_argument("-o", "--output", required=True)

    flag, many = dict(action="store_true"), dict(nargs="+", required=True)
    need = dict(required=True)
    add("bed-merge", (("-i", "--input"), many), (("-d", "--distance"), dict(type=int, default=0)), (("-n", "--names"), flag), (("-c", "--count"), flag), (("-u", "--unique-names"), flag))
    add("check-ref", (("-b", "--bed"), need), (("-f", "--fasta"), need), (("--ignore-case",), flag))
    add("create-contigs", (("-v", "--variants"), need), (("-r", "--fasta"), need), (("-f", "--flank"), dict(type=int, default=99)), (("-q", "--quality"), dict(type=float, default=0)))
    add("find-homopolymers", (("-f", "--fasta"), need), (("-m", "--min-length"), dict(type=int, default=5)), (("-I", "--ignore"), dict(default="")), (("-s", "--sequence"), dict(nargs="*")))
    add("generate", (("-n", "--number"), dict(type=int, default=100)), (("-s", "--seed"), dict(type=int)))
    add("intersect", (("-a",), need), (("-b",), need), (("-F", "--format"), dict(default="A")), *((((f"--{n}",), flag)) for n in ("output-both", "full", "exact-pos", "exact-allele", "iub-match", "dbsnp-match", "adjacent-insertions", "first-only")), (("--miss-a",), {}), (("--miss-b",), {}))
    add("ref-stats", (("-b", "--bed"), need), (("-f", "--fasta"), need), (("-t", "--token"), dict(nargs="*")), (("-r", "--bases"), flag))
    add("remap-cigar", (("-i", "--input"), need))
    add("sort", (("-i", "--input"), many), (("-u", "--unique"), flag))
    add("wig2bed", (("-w", "--wiggle"), need), (("-c", "--strip-chr"), flag), (("-Z", "--nonzero"), flag))
    add("vcf2raw", (("-v", "--vcf"), need), (("-f", "--fasta"), need))
    add("vcf-normalize-indels", (("-i", "--input"), need), (("-f", "--fasta"), need))
    add("vcf-annotate", (("-i", "--input"), need), (("-a", "--annotation"), need), (("-I", "--info"), dict(nargs="*")), (("--no-info",), flag), (("--no-identifiers",), flag))
    add("vcf-annotate-homopolymers", (("-v", "--vcf"), need), (("-b", "--bed"), need), (("-m", "--max-length"), dict(type=int, default=2)), (("-n", "--name"), dict(default="HOMP_FILTER")))
    add("vcf-filter", (("-i", "--input"), need), (("-d", "--min-depth"), dict(type=int, default=0)))
    add("vcf-site-filter", (("-i", "--input"), need), (("-f", "--fraction"), dict(type=float, default=1.0)))
    add("vcf-remove-filtered-gt", (("-i", "--input"), need), (("-w", "--whitelist"), dict(nargs="*", default=[])))
    add("vcf-merge", (("-i", "--input"), dict(nargs="*", default=[])), (("-M", "--strategy"), {}), (("-s", "--merge-samples"), flag), (("-c", "--clear-filters"), flag), (("-e", "--exact-pos"), flag), (("-P", "--priority"), dict(default="order")), (("-R", "--consensus"), {}), (("-D", "--duplicate-samples"), dict(action="append", default=[])), (("-N", "--normalize-indels"), {}), (("--print-stats",), flag), (("--allow-same-file",), flag), (("--reject-filter-name",), dict(default="MERGE_REJECT")))
    add("vcf-compare", (("-i", "--input"), many), (("-I", "--include-ref"), flag), (("-F", "--filter-mode"), dict(nargs="*", default=[])), (("-n", "--name"), dict(nargs="*", default=[])), (("-s", "--sample-name"), dict(nargs="*", default=[])), (("-d", "--result-dir"), {}), (("-r", "--sample-rename-file"), {}), (("-R", "--rename-sample"), dict(action="append", default=[])), (("-e", "--exact-format"), dict(default="EXSEC")), (("-p", "--partial-format"), dict(default="PXSEC")))
    add("make-contigs", (("-b", "--bed"), need), (("-f", "--fasta"), need), (("-p", "--pad"), dict(type=int, default=0)))
    add("vcf-report", (("-i", "--input"), need), (("-I", "--info"), dict(nargs="*", default=[])))
    return p


def _sequences(spark, path):
    """Pieces of an indexed file; compressed files have no ranges to read and come record by record."""
    if path.endswith((".gz", ".bz2", ".zst")):
        return text.read_fasta(spark, path)
    to = scratch(spark, "fasta-index")
    fasta.write_index(spark, path, to)
    return fasta.pieces(spark, to, sequences.PIECE).drop("length")


def _read_vcf(spark, paths, suffixes=None, names=None):
    """suffixes: by path, under which its samples appear once more; names: new names of samples."""
    header, rows = None, None
    for i, path in enumerate(paths):
        h = vcf.read_header(spark, path)
        if names:
            h = h.rename(names)
        r = vcf.read_rows(spark, path, h, i).withColumn("ord", F.col("ord") * len(paths) + i)
        if suffix := (suffixes or {}).get(path):
            h, r = h.mirror(suffix), commands.mirrored(r, suffix)
        header, rows = (h, r) if header is None else (header.merge(h), rows.unionByName(r))
    return header, rows


def main(argv: list[str] | None = None) -> None:
    o = _parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    c = o.command
    if c == "bed-merge":
        rows = text.read_bed(spark, o.input)
        merged = commands.bed_merge(rows, o.distance, o.names, o.count, o.unique_names)
        sinks.write_bed(merged, o.output, [x for x in merged.columns if x in ("names", "name", "n")])
    elif c == "check-ref":
        bad, _ = commands.check_ref(text.as_variants(text.read_bed(spark, o.bed)), _sequences(spark, o.fasta), o.ignore_case)
        sinks.write_bed(bad.select("chrom", "start", "stop", "ref", "found", "error"), o.output, ["ref", "found", "error"])
    elif c == "create-contigs":
        rows = vcf.read_rows(spark, o.variants).withColumn("id", F.try_element_at("ids", F.lit(1)))
        contigs, places = commands.create_contigs(rows, _sequences(spark, o.fasta), o.flank, o.quality)
        sinks.write_fasta(contigs, o.output)
        sinks.write_report(places, o.output + ".remap")
    elif c == "find-homopolymers":
        runs = commands.find_homopolymers(_sequences(spark, o.fasta), o.min_length, o.ignore, o.sequence)
        sinks.write_bed(runs.withColumnRenamed("name", "chrom"), o.output, ["base"])
    elif c == "generate":
        sinks.write_bed(commands.generate(spark, o.number, o.seed), o.output, ["alleles"])
    elif c == "intersect":
        opts = commands.Intersect(o.format, o.output_both, o.full, o.exact_pos, o.exact_allele, o.iub_match, o.dbsnp_match, o.adjacent_insertions, o.first_only)
        hits, miss_a, miss_b = commands.intersect(text.read_bed(spark, o.a), text.read_bed(spark, o.b), opts)
        hits.withColumnRenamed("line", "value").write.mode("overwrite").text(o.output)
        for path, rows in ((o.miss_a, miss_a), (o.miss_b, miss_b)):
            if path:
                sinks.write_bed(rows, path)
    elif c == "ref-stats":
        tokens = o.token or commands.sequences.DEFAULT_TOKENS
        sinks.write_report(commands.ref_stats(text.read_bed(spark, o.bed).select("chrom", "start", "stop"), _sequences(spark, o.fasta), tokens, o.bases), o.output)
    elif c == "remap-cigar":
        commands.remap_cigar(text.read_sam(spark, o.input)).write.mode("overwrite").text(o.output)
    elif c == "sort":
        if text.kind_of(spark, o.input[0]) == "vcf":
            header, rows = _read_vcf(spark, o.input)
            sinks.write_vcf(rows, header, o.output)
        else:
            # Tables keyed by a position are sorted as such; files of both kinds may stand together.
            frames = []
            for path in o.input:
                if text.kind_of(spark, path) == "positions":
                    rows = text.read_positions(spark, path).withColumn("alleles", F.lit(None).cast("string"))
                else:
                    rows = text.read_bed(spark, path).withColumn("alleles", F.try_element_at("extra", F.lit(1)))
                frames.append(rows.select("chrom", "start", "stop", "alleles", "line"))
            sinks.write_bed(commands.sort(frames, o.unique), o.output)
    elif c == "make-contigs":
        rows = text.read_bed(spark, o.bed)
        regions = rows.select(F.try_element_at("extra", F.lit(1)).alias("transcript"), "chrom", "start", "stop")
        contigs = commands.make_contigs(regions, _sequences(spark, o.fasta), o.pad)
        heading = F.concat_ws("|", F.concat(F.lit(">REMAP-"), "chrom"), F.col("start").cast("string"), F.col("stop").cast("string"), "cigar", "transcript")
        contigs.select(F.concat_ws("\n", heading, "contig").alias("value")).write.mode("overwrite").text(o.output)
    elif c == "wig2bed":
        sinks.write_bed(commands.wig_to_bed(text.read_wiggle(spark, o.wiggle), o.strip_chr, o.nonzero), o.output, ["value"])
    elif c == "vcf2raw":
        raw = commands.vcf_to_raw(vcf.read_rows(spark, o.vcf), _sequences(spark, o.fasta))
        sinks.write_report(raw, o.output)
    else:
        _variants(spark, o)


_PRIORITIES = {"o": "order", "u": "unfiltered", "f": "filtered"}


def _consensus(option: str | None) -> tuple[float | None, str, str]:
    """RATIO,FILTER,DESCRIPTION; a ratio alone has the default filter."""
    if not option:
        return None, "CNS", ""
    ratio, _, rest = option.partition(",")
    name, _, about = rest.partition(",")
    if not 0 <= float(ratio) <= 1 or (rest and not (name and about)):
        raise ValueError(f"-R takes RATIO,FILTER,DESCRIPTION with a ratio from 0 to 1, not {option!r}")
    return float(ratio), commands.calls.valid_filter_name(name or "CNS"), about or "Sample consensus filter"


def _variants(spark, o) -> None:
    c = o.command
    paths = [o.vcf] if c == "vcf-annotate-homopolymers" else o.input if isinstance(o.input, list) else [o.input]
    suffixes, names = {}, {}
    if c == "vcf-merge":
        for item in o.duplicate_samples:
            path, sep, suffix = item.rpartition("=")
            if not sep:
                raise ValueError(f"-D takes FILE=SUFFIX, not {item!r}")
            suffixes[path] = suffix
        paths = [*paths, *(p for p in suffixes if p not in paths)]
        if not paths:
            raise ValueError("no input files")
    elif c == "vcf-compare":
        names = text.read_pairs(o.sample_rename_file) if o.sample_rename_file else {}
        for item in o.rename_sample:
            old, sep, new = item.partition("=")
            if not old or not new:
                raise ValueError(f"-R takes OLD=NEW, not {item!r}")
            names[old] = new
        if len(paths) < 2:
            raise ValueError("at least two input files are needed")
    header, rows = _read_vcf(spark, paths, suffixes, names)
    if c == "vcf-normalize-indels":
        rows = commands.vcf_normalize_indels(rows, _sequences(spark, o.fasta))
    elif c == "vcf-annotate":
        notes_header, notes = _read_vcf(spark, [o.annotation])
        numbers = {k: f.number for k, f in notes_header.info.items()}
        rows = commands.vcf_annotate(rows, notes, o.info, numbers, not o.no_info, not o.no_identifiers)
        header.info.update({k: f for k, f in notes_header.info.items() if k not in header.info})
    elif c == "vcf-annotate-homopolymers":
        runs = text.read_bed(spark, o.bed).select("chrom", "start", "stop", F.try_element_at("extra", F.lit(1)).alias("base"))
        rows = commands.vcf_annotate_homopolymers(rows, runs, o.max_length, o.name)
        header.info[o.name] = vcf.FieldType(o.name, "A", "Integer", "Homopolymer indel")
    elif c == "vcf-filter":
        rows = commands.vcf_filter(rows, o.min_depth)
    elif c == "vcf-site-filter":
        rows = commands.vcf_site_filter(rows, o.fraction)
        header.filters[commands.calls.site_filter_name(o.fraction)] = commands.calls.site_filter_text(o.fraction)
    elif c == "vcf-remove-filtered-gt":
        rows = commands.vcf_remove_filtered_gt(rows, o.whitelist)
    elif c == "vcf-merge":
        lines = [f"{k}={v}" for k, v in text.read_pairs(o.strategy).items()] if o.strategy else []
        fields = {k: merging.Field(f.number, f.type) for k, f in header.info.items()}
        ratio, cns, about = _consensus(o.consensus)
        if unknown := [r.key for r in vcf.undeclared(rows, header).limit(5).collect()]:
            raise ValueError(f"fields that no header declares: {', '.join(sorted(unknown))}")
        s = merging.Strategy.parse(
            lines, fields=fields, merge_samples=o.merge_samples, clear_filters=o.clear_filters, exact_position=o.exact_pos, priority=_PRIORITIES.get(o.priority, o.priority),
            consensus=ratio, consensus_filter=cns, allow_same_source=o.allow_same_file, reject_filter=o.reject_filter_name, declared=header.sources,
        )
        header.filters[o.reject_filter_name] = "Rejected by the merge: its file has another record of this locus"
        if ratio:
            header.filters[cns] = about
            header.format.setdefault("FT", vcf.FieldType("FT", "1", "String", "Sample filter status"))
        if o.print_stats:
            for r in commands.merge_stats(rows).collect():
                print(*r, sep="\t", file=sys.stderr)
        rows = commands.vcf_merge(rows, s)
        if o.normalize_indels:
            rows = commands.vcf_normalize_indels(rows, _sequences(spark, o.normalize_indels))
    elif c == "vcf-compare":
        modes = dict(enumerate(o.filter_mode))
        if o.name and len(o.name) != len(paths):
            raise ValueError("as many names as input files are needed")
        if missing := [s for s in o.sample_name if s not in header.samples]:
            raise ValueError(f"no input file has {', '.join(missing)}")
        samples = o.sample_name or [s for s, n in header.sources.items() if n == len(paths)]
        if not samples:
            raise ValueError("the input files have no sample in common")
        labels = o.name or paths
        table, vectors = commands.vcf_compare(rows, len(paths), samples, modes, o.include_ref)
        bit = lambda i: F.call_function("shiftright", F.col("mask"), F.lit(i)).bitwiseAND(F.lit(1).cast("bigint")) == 1
        table = table.withColumn("names", F.array_join(F.array_compact(F.array(*[F.when(bit(i), F.lit(n)) for i, n in enumerate(labels)])), ","))
        if o.result_dir:
            for key, about in ((o.exact_format, "Exact match indicator"), (o.partial_format, "Partial match indicator")):
                header.format[key] = vcf.FieldType(key, str(len(paths)), "Integer", about)
            marked = commands.with_match_fields(rows, vectors, o.exact_format, o.partial_format)
            for i, name in enumerate(labels):
                sinks.write_vcf(marked.filter(F.col("source") == i), header, f"{o.result_dir}/{i}-{name.rsplit('/', 1)[-1]}")
        return sinks.write_report(table, o.output)
    elif c == "vcf-report":
        site, sample = commands.vcf_report(rows, o.info)
        sinks.write_report(site.drop("site").withColumn("alts", F.array_join("alts", ",")), o.output + "/per_site")
        return sinks.write_report(sample, o.output + "/per_sample")
    sinks.write_vcf(rows, header, o.output)


if __name__ == "__main__":
    main()
