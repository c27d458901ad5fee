import pytest
from pyspark.sql import functions as F

from helixspan.operators import islands, overlap, signal
from helixspan.plans import commands
from helixspan.sources import sinks, text, vcf

BED = "chrom string, start bigint, stop bigint"


def frame(spark, rows, schema=BED):
    return spark.createDataFrame(rows, schema)


def brute(a, b, adjacent):
    def hit(x, y):
        over = (x[1] < y[2] and y[1] < x[2]) or (x[1] == x[2] == y[1] == y[2])
        return x[0] == y[0] and (over or adjacent and (x[1] == x[2] or y[1] == y[2]) and x[1] <= y[2] and y[1] <= x[2])

    return sorted((x[0], x[1], x[2], y[1], y[2]) for x in a for y in b if hit(x, y))


@pytest.mark.parametrize("width", [4, 64])
@pytest.mark.parametrize("adjacent", [False, True])
def test_overlap_join(spark, width, adjacent):
    import random

    rng = random.Random(width)
    make = lambda n: [(rng.choice("xy"), s, s + rng.choice([0, 0, 1, 3, 9, 40, 700, 30000])) for s in (rng.randrange(0, 3000) for _ in range(n))]
    a, b = make(120), make(120)
    pairs = overlap.overlap_join(frame(spark, a), frame(spark, b), adjacent, width=width)
    got = sorted(tuple(r) for r in pairs.select("chrom", "a_start", "a_stop", "b_start", "b_stop").collect())
    assert got == brute(a, b, adjacent)


def test_islands(spark):
    rows = frame(spark, [("1", 0, 5), ("1", 5, 9), ("1", 8, 12), ("1", 20, 21), ("2", 3, 30), ("2", 4, 6), ("2", 29, 31)])
    plain = lambda df: sorted(map(tuple, df.select("chrom", "start", "stop").collect()))
    assert plain(islands.merged(rows)) == [("1", 0, 12), ("1", 20, 21), ("2", 3, 31)]
    assert plain(islands.merged(rows, 8)) == [("1", 0, 21), ("2", 3, 31)]
    ids = islands.island_ids(rows).groupBy("chrom", "island").count().orderBy("chrom", "island")
    assert [r["count"] for r in ids.collect()] == [1, 2, 1, 3]


@pytest.mark.parametrize("distance", [None, 0, 7])
@pytest.mark.parametrize("block", [8, 100, 1 << 20])
def test_islands_over_blocks(spark, distance, block):
    import random

    rng = random.Random(block)
    rows = sorted({(c, s, s + rng.choice([0, 1, 4, 20, 300])) for c in ("x", "y", None) for s in (rng.randrange(0, 2000) for _ in range(120))}, key=lambda r: (r[0] or "", r[1], r[2]))
    want, far, n = {}, {}, {}
    for c, s, e in rows:
        if c not in far or (s - far[c] > distance if distance is not None else s >= far[c]):
            n[c] = n.get(c, 0) + 1
        far[c] = max(far.get(c, e), e)
        want[c, s, e] = n[c]
    got = islands.island_ids(frame(spark, rows).repartition(3), distance, block=block)
    assert {(r.chrom, r.start, r.stop): r.island for r in got.collect()} == want


@pytest.mark.parametrize("block", [5, 64, 1 << 20])
def test_merging_of_equal_names_over_blocks(spark, block):
    import random

    rng = random.Random(7)
    rows = sorted(((c, s, s + rng.choice([1, 5, 40]), rng.choice("pq")) for c in "xy" for s in (rng.randrange(0, 600) for _ in range(90))))
    want = []
    for c, s, e, n in rows:
        if want and want[-1][0] == c and want[-1][3] == n and s - want[-1][2] <= 3:
            want[-1][2] = max(want[-1][2], e)
        else:
            want.append([c, s, e, n])
    df = spark.createDataFrame(rows, "chrom string, start bigint, stop bigint, name string").repartition(3)
    got = islands.merged(df, 3, same_name="name", block=block).select("chrom", "start", "stop", "name")
    assert sorted(map(list, got.collect())) == sorted(want)


def test_sequences_in_pieces(spark):
    import random
    import re

    from helixspan.operators import sequences

    rng = random.Random(1)
    seqs = [(f"s{i}", "".join(rng.choice("ACGT") * rng.choice([1, 1, 2, 3, 30]) for _ in range(n))) for i, n in enumerate((1, 7, 60))] + [("e", "")]
    df = spark.createDataFrame(seqs, "name string, seq string")
    for least in (1, 3):
        want = sorted((n, m.start(), m.end(), m[1]) for n, s in seqs for m in re.finditer(r"(.)\1*", s) if len(m[0]) >= least)
        for size in (1, 4, 16, 1 << 14):
            assert sorted(map(tuple, sequences.homopolymers(df, least, size=size).collect())) == want
    regions = spark.createDataFrame([("s2", a, b) for a in (0, 3, 50) for b in (a + 1, a + 20, a + 9999)] * 2 + [("no", 0, 5)], "chrom string, start bigint, stop bigint")
    text_of = dict(seqs)
    for size in (4, 1 << 14):
        found = sequences.bases_between(regions.distinct(), df, "start", "stop", size).collect()
        assert len(found) == 9 and all(r["_text"] == text_of[r.chrom][r.start : r.stop] for r in found)
    assert sequences.token_counts(regions, df).count() == 18
    repeats = spark.createDataFrame([("r", "TT" + "CG" * 300)], "name string, seq string")
    v = spark.createDataFrame([("r", 603, "", "CG"), ("r", 401, "CG", ""), ("u", 5, "A", "")], "chrom string, pos bigint, ref string, alt string")
    for size, windows in ((8, (4, 16)), (64, (16, 64)), (1 << 14, (64, 4096))):
        got = sorted(map(tuple, sequences.left_aligned(v, repeats, windows, size).collect()))
        assert got == [("r", 3, "", "CG", 600), ("r", 3, "CG", "", 398), ("u", 5, "A", "", 0)]


INTERSECT_A = "1\t0\t10\tA/C\n1\t0\t10\tA/G\n1\t0\t10\ta/c\tx\n2\t5\t6\tA/T\n"


def test_intersect_counts_rows_of_one_place_and_alleles_once(spark, tmp_path):
    (tmp_path / "a.bed").write_text(INTERSECT_A)
    (tmp_path / "b.bed").write_text("1\t2\t4\tn1\n1\t3\t9\tn2\n")
    a, b = (text.read_bed(spark, str(tmp_path / f"{x}.bed")) for x in "ab")
    lines = lambda o: sorted(r.line for r in commands.intersect(a, b, o)[0].collect())
    assert len(lines(commands.Intersect())) == 2 and len(lines(commands.Intersect(format="I A"))) == 2
    assert len(lines(commands.Intersect(format="A B"))) == 2 and len(lines(commands.Intersect(output_both=True))) == 6
    assert all("2\t4" in x for x in lines(commands.Intersect(format="I")))
    assert [r.chrom for r in commands.intersect(a, b)[1].collect()] == ["2"]


def test_site_filter_command(spark, tmp_path):
    from helixspan.plans import cli

    head = "##fileformat=VCFv4.1\n##FORMAT=<ID=GT,Number=1,Type=String,Description=\"g\">\n##FORMAT=<ID=FT,Number=1,Type=String,Description=\"f\">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\tc\n"
    rows = [(100, ".", "GT:FT", ("0/1:.", ".", "0/1")), (200, "PASS", "GT:FT", ("0/1:x", "0/1:y", "0/1:PASS")), (300, "q10", "GT:FT", ("0/1:x", "0/1:PASS", "0/1:PASS")), (400, ".", "GT", ("0/1", "0/1", "0/1")), (500, "q10", "GT:FT", ("0/1:x", "0/1:x", "."))]
    (tmp_path / "i.vcf").write_text(head + "".join(f"1\t{p}\t.\tA\tT\t67\t{f}\t.\t{k}\t" + "\t".join(s) + "\n" for p, f, k, s in rows))
    cli.main(["vcf-site-filter", "-i", str(tmp_path / "i.vcf"), "-f", "0.5", "-o", str(tmp_path / "o")])
    out = [r.value for r in spark.read.text(str(tmp_path / "o")).collect()]
    assert any(x.startswith("##FILTER=<ID=sf50,") for x in out)
    assert [tuple(x.split("\t")[i] for i in (1, 6)) for x in out if x[0] != "#"] == [("100", "PASS"), ("200", "sf50"), ("300", "PASS;q10"), ("500", "q10;sf50")]


def test_sort_of_positions(spark, tmp_path):
    from helixspan.plans import cli

    (tmp_path / "p.txt").write_text("chr10\t5\tx\nchr2\t7\ty\nchr2\t6\tz\n")
    cli.main(["sort", "-i", str(tmp_path / "p.txt"), "-o", str(tmp_path / "o")])
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).collect()] == ["chr2\t6\tz", "chr2\t7\ty", "chr10\t5\tx"]


def test_text_formats(spark, tmp_path):
    bed = tmp_path / "a.bed"
    bed.write_text("# c\nchr1\t1\t2\ta/0\t50\t-\n\nchr2\t5\t5\t0/acg\t7\t9\n")
    rows = text.as_variants(text.read_bed(spark, str(bed))).orderBy("chrom").collect()
    assert [(r.ref, r.alt, r.alleles, r.quality, r.depth) for r in rows] == [("A", "", "A/*", 50.0, 0), ("", "ACG", "*/ACG", 7.0, 9)]
    assert text.kind_of(spark, str(bed)) == "bed"
    fa = tmp_path / "a.fa"
    fa.write_text(">s1 more\nACGT\nAC\n>s2\nGG\n")
    assert {(r.name, r.seq) for r in text.read_fasta(spark, str(fa)).collect()} == {("s1", "ACGTAC"), ("s2", "GG")}
    wig = tmp_path / "a.wig"
    wig.write_text("track type=wiggle_0\nfixedStep chrom=chr1 start=11 step=1\n1\n1\n0\n2\nfixedStep chrom=chr2 start=1 step=5 span=2\n3\n3\n")
    points = text.read_wiggle(spark, str(wig))
    got = sorted(map(tuple, signal.track_intervals(points, strip_prefix=True, nonzero=True).collect()))
    assert got == [("1", 10, 12, 1.0), ("1", 13, 14, 2.0), ("2", 0, 2, 3.0), ("2", 5, 7, 3.0)]


HEAD = """##fileformat=VCFv4.1
##INFO=<ID=N,Number=A,Type=String,Description="n">
##FORMAT=<ID=GT,Number=1,Type=String,Description="g">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="d">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2
"""


def variants(spark, tmp_path, name, body):
    path = tmp_path / name
    path.write_text(HEAD + body)
    header = vcf.read_header(spark, str(path))
    return header, vcf.read_rows(spark, str(path), header)


def test_vcf_round_trip(spark, tmp_path):
    body = "2\t7\tb;a\tA\tC,G\t50.5\tPASS\tN=x,.\tGT:DP\t0/1:3\t.\n10\t3\t.\tT\t.\t.\tq;r\t.\tGT:DP\t./.:.\t1/1:9\n"
    header, rows = variants(spark, tmp_path, "a.vcf", body)
    lines = [r.value for r in sinks.vcf_lines(rows, header).collect() if not r.value.startswith("#")]
    assert lines == ["2\t7\ta;b\tA\tC,G\t50.5\tPASS\tN=x,.\tGT:DP\t0/1:3\t.", "10\t3\t.\tT\t.\t.\tq;r\t.\tGT:DP\t./.:.\t1/1:9"]
    assert vcf.undeclared(rows, header).count() == 0
    left = commands.vcf_filter(rows, 5)
    assert [(r.chrom, sorted(r.samples)) for r in left.collect()] == [("10", ["s2"])]
    assert commands.calls.site_filter_name(1.0) == "sf1e+02" and commands.calls.site_filter_name(0.3) == "sf30"


def test_commands_on_variants(spark, tmp_path):
    body = "1\t5\trs1\tG\tT\t.\tPASS\tN=k\tGT\t0/1\t1/1\n1\t11\trs2\tGCG\tGCGCG\t.\tPASS\tN=z\tGT\t0/1\t0/0\n"
    _, rows = variants(spark, tmp_path, "a.vcf", body)
    seqs = frame(spark, [("1", "TTTCGCGCGCGCG")], "name string, seq string")
    moved = {r.ids[0]: (r.pos, r.ref, r.alts) for r in commands.vcf_normalize_indels(rows, seqs).collect()}
    assert moved == {"rs1": (5, "G", ["T"]), "rs2": (3, "T", ["TCG"])}
    raw = sorted(map(tuple, commands.vcf_to_raw(rows, seqs).collect()))
    assert raw == [("1", 4, "*/CG"), ("1", 5, "G/T")]
    _, notes = variants(spark, tmp_path, "b.vcf", "1\t5\tdb9\tG\tC,T\t.\tPASS\tN=p,q\tGT\t.\t.\n")
    got = {r.pos: (r.ids, r.info) for r in commands.vcf_annotate(rows, notes, ["N=M"], {"N": "A"}).collect()}
    assert got[5] == (["db9", "rs1"], {"N": ["k"], "M": ["q"]}) and got[11][1] == {"N": ["z"]}
    site, sample = commands.vcf_report(rows)
    assert {r.sample: (r.n_het, r.n_hom, r.n_ref) for r in sample.collect()} == {"s1": (2, 0, 0), "s2": (0, 1, 1)}
    assert site.count() == 2
    table, vectors = commands.vcf_compare(rows.unionByName(rows.withColumns({"source": F.lit(1), "ord": F.col("ord") + 1_000})), 2, ["s1", "s2"])
    counts = {(r.kind, r.mask): (r.s1, r.s2) for r in table.collect()}
    assert counts["exact_match", 3] == (2, 1) and counts["partial_match", 3] == (2, 1) and counts["exact_match", 1] == (0, 0)
    contigs, places = commands.create_contigs(rows.withColumn("id", F.get("ids", F.lit(0))), seqs, flank=3)
    assert {r.name: r.seq for r in contigs.collect()}["rs1_5_0"] == "TTCTCGC" and places.filter("name = 'rs1_5_0'").first().cigar == "7M"
    runs = frame(spark, [("1", 0, 3, "T")], BED + ", base string")
    flagged = commands.vcf_annotate_homopolymers(rows.withColumns({"pos": F.lit(1).cast("bigint"), "ref": F.lit("TT"), "alts": F.array(F.lit("T"))}), runs)
    assert {tuple(r.info["HOMP_FILTER"]) for r in flagged.collect()} == {("1",)}


def test_intersect(spark, tmp_path):
    a = frame(spark, [("1", 0, 10, ["A/C"]), ("1", 0, 10, ["A/C"]), ("1", 50, 60, ["A/C"])], BED + ", extra array<string>")
    b = frame(spark, [("1", 5, 8, ["A/M"]), ("1", 9, 12, ["A/T"]), ("2", 1, 2, ["A/T"])], BED + ", extra array<string>")
    hits, miss_a, miss_b = commands.intersect(a, b)
    assert [r.line for r in hits.collect()] == ["1\t0\t10\tA/C"] and miss_a.count() == 1 and miss_b.count() == 1
    full, _, _ = commands.intersect(a, b, commands.Intersect(full=True))
    assert full.count() == 4
    c = frame(spark, [("1", 0, 10, ["A/M"])], BED + ", extra array<string>")
    assert commands.intersect(a, c, commands.Intersect(iub_match=True))[0].count() == 1
    assert commands.intersect(a, c, commands.Intersect(exact_allele=True))[0].count() == 0
    assert commands.intersect(a, c, commands.Intersect(dbsnp_match=True))[0].count() == 1


def test_streams(spark, tmp_path):
    from helixspan.streaming import intervals as st

    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 05:00:00"), (2, "2024-01-01 00:00:00")], "user_id int, t string")
    rows.selectExpr("user_id", "CAST(t AS TIMESTAMP) AS ts").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("user_id int, ts timestamp").parquet(str(tmp_path / "e"))
    q = st.sessions(stream).writeStream.outputMode("complete").format("memory").queryName("s").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("s").collect()) == [1, 1, 2]


def test_cli(spark, tmp_path):
    from helixspan.plans import cli

    (tmp_path / "a.bed").write_text("1\t0\t5\tx\n1\t4\t9\ty\n")
    cli.main(["bed-merge", "-i", str(tmp_path / "a.bed"), "-n", "-c", "-o", str(tmp_path / "out")])
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["1\t0\t9\tX;Y\t2"]


def write_vcf(path, samples, rows):
    head = '##fileformat=VCFv4.1\n##FORMAT=<ID=GT,Number=1,Type=String,Description="g">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t' + "\t".join(samples)
    path.write_text("\n".join([head, *(f"1\t{p}\t.\t{r}\t{a}\t.\t.\t.\tGT\t" + "\t".join(c) for p, r, a, c in rows)]) + "\n")
    return str(path)


def test_merge_and_compare_commands(spark, tmp_path, capsys):
    from helixspan.plans import cli

    a = write_vcf(tmp_path / "a.vcf", ["s", "t"], [(10, "A", "C", ("0/1", "1/1")), (20, "G", "T", ("0/1", "."))])
    b = write_vcf(tmp_path / "b.vcf", ["s", "u"], [(10, "A", "C", ("0/1", "0/0")), (30, "C", "T", ("1/1", "0/1"))])
    lines = lambda p: [r.value for r in spark.read.text(str(p)).collect()]
    out = str(tmp_path / "m")
    cli.main(["vcf-merge", "-i", b, "-D", f"{a}=-again", "-s", "-R", "0.9,CNS,agreement", "-P", "u", "--print-stats", "-o", out])
    got = lines(out)
    assert [x for x in got if x.startswith("##FILTER=<ID=CNS")] and [x for x in got if x.startswith("##FORMAT=<ID=FT")] and any("MERGE_REJECT" in x for x in got)
    head = next(x for x in got if x.startswith("#CHROM")).split("\t")[9:]
    assert sorted(head) == ["s", "s-again", "t", "t-again", "u"]
    rows = {x.split("\t")[1]: dict(zip(head, x.split("\t")[9:])) for x in got if x[0] != "#"}
    assert rows["10"]["s-again"].startswith("0/1") and rows["10"]["t-again"].startswith("1/1") and rows["30"]["u"].startswith("0/1")
    assert "one region" in capsys.readouterr().err
    with pytest.raises(ValueError):
        cli.main(["vcf-merge", "-i", a, b, "-R", "2,CNS,x", "-o", out])
    with pytest.raises(ValueError):
        cli.main(["vcf-merge", "-i", a, b, "-R", "0.5,CNS", "-o", out])
    res, rep = str(tmp_path / "d"), str(tmp_path / "r")
    cli.main(["vcf-compare", "-i", a, b, "-R", "t=v", "-n", "one", "two", "-d", res, "-e", "EX", "-o", rep])
    table = spark.read.option("sep", "\t").option("header", True).csv(rep).collect()
    assert "s" in table[0].asDict() and "v" not in table[0].asDict()
    counts = {(r.names, r.kind): int(r.s) for r in table}
    assert counts["one,two", "exact_match"] == 1 and counts["one", "exact_match"] == 1 and counts["two", "exact_match"] == 1
    row = next(x for x in lines(f"{res}/0-one") if x.startswith("1\t10"))
    assert row.split("\t")[8] == "GT:EX:PXSEC" and row.split("\t")[9].startswith("0/1:1,1")
    with pytest.raises(ValueError):
        cli.main(["vcf-compare", "-i", a, b, "-s", "nobody", "-o", rep])


def test_make_contigs_command(spark, tmp_path):
    from helixspan.plans import cli

    (tmp_path / "a.fa").write_text(">c\nACGTACGTACGTACGTACGT\n")
    (tmp_path / "a.bed").write_text("c\t2\t5\tt1\nc\t8\t12\tt1\n")
    cli.main(["make-contigs", "-b", str(tmp_path / "a.bed"), "-f", str(tmp_path / "a.fa"), "-o", str(tmp_path / "o")])
    got = [r.value for r in spark.read.text(str(tmp_path / "o")).collect()]
    assert got[0].startswith(">REMAP-c|2|12|3M3N4M|") and got[1] == "GTAACGT"


def test_intersect_of_deep_places_makes_few_pairs(spark):
    from pyspark.sql import functions as F

    n, b_alleles = 30_000, ("A/C", "A/M", "G/A", "T/C")
    a = spark.range(n).selectExpr("'c' AS chrom", "id % 5 AS start", "id % 5 + 2 AS stop", "array(concat('A/', substr('cCGt', CAST(id % 4 + 1 AS INT), 1)), CAST(id AS STRING)) AS extra")
    b = spark.range(n).selectExpr("'c' AS chrom", "id % 3 + 1 AS start", "id % 3 + 3 AS stop", f"array(element_at(array{b_alleles}, CAST(id % 4 + 1 AS INT)), CAST(id AS STRING)) AS extra")
    rows_a = [(i % 5, i % 5 + 2, "A", "cCGt"[i % 4].upper()) for i in range(20)]
    rows_b = [(i % 3 + 1, i % 3 + 3, *b_alleles[i % 4].split("/")) for i in range(12)]
    share = lambda x, y: "ACMGRSVTWYHKDBN".index(x) + 1 & "ACMGRSVTWYHKDBN".index(y) + 1
    turned = lambda x: x.translate(str.maketrans("ACGTM", "TGCAK"))
    either = lambda x, r, y: (x[2] == r and share(x[3], y)) or (x[2] == y and share(x[3], r))
    for option, rule in (
        ({}, lambda x, y: x[0] < y[1] and y[0] < x[1]), ({"iub_match": True}, lambda x, y: x[:2] == y[:2] and x[2] == y[2] and share(x[3], y[3])),
        ({"exact_allele": True}, lambda x, y: x == y), ({"dbsnp_match": True}, lambda x, y: x[:2] == y[:2] and (either(x, *y[2:]) or either(x, turned(y[2]), turned(y[3])))),
    ):
        met = [(x, y) for x in rows_a for y in rows_b if rule(x, y)]
        lines, miss_a, miss_b = commands.intersect(a, b, commands.Intersect(**option))
        want = len({x for x, _ in met}), sum(x not in {m for m, _ in met} for x in rows_a) * n // 20, sum(y not in {m for _, m in met} for y in rows_b) * n // 12
        assert (lines.count(), miss_a.count(), miss_b.count()) == want and met
    first = commands.intersect(a, b, commands.Intersect(format="A B"))[0].filter(F.col("line").startswith("c\t2\t4\tA/G")).collect()
    assert [r.line for r in first] == ["c\t2\t4\tA/G\t10002\tc\t1\t3\tA/C\t0"]
