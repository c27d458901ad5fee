import pytest
from pyspark.sql import functions as F

from helixspan.functions import alleles as al
from helixspan.functions import genotype as g
from helixspan.functions.natkey import natural_key
from helixspan.operators import cigar, merging, sequences
from helixspan.plans import projection
from helixspan.sources import vcf


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


@pytest.mark.parametrize("pos,ref,alt,want", [
    (10, "CCCC", "CCCCG", (14, "", "G")), (10, "CTA", "CA", (11, "T", "")), (5, "A", "A", (6, "", "")), (3, "ACGT", "AT", (4, "CG", "")), (7, "G", "T", (7, "G", "T")),
])
def test_trim(spark, pos, ref, alt, want):
    assert tuple(one(spark, al.trimmed(F.lit(pos), F.lit(ref), F.lit(alt)))[0]) == want


def test_natural_order(spark):
    names = ["chr10", "X", "chr2", "2", "10", "MT", "1", "chr1_random", "chr1", "9"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(natural_key(F.col("n"))).collect()
    assert [r.n for r in rows] == ["1", "2", "9", "10", "MT", "X", "chr1", "chr1_random", "chr2", "chr10"]


def test_iupac(spark):
    masks = one(spark, *[al.base_mask(F.lit(c)) for c in "ACGTMRWSYKVHDBN*"])
    assert masks == (1, 2, 4, 8, 3, 5, 9, 6, 10, 12, 7, 11, 13, 14, 15, 0)
    assert one(spark, al.reverse_complement(F.lit("acgRz")))[0] == "-YCGT"


def test_genotypes(spark):
    t = F.lit
    assert one(spark, g.canonical(t("1/0")), g.canonical(t("1|0")), g.disjoint(t("0/0"), t("1/1")), g.disjoint(t("0/1"), t("1/1"))) == ("0/1", "1|0", True, False)
    assert one(spark, g.renumbered(t("0/1|2"), F.array(t(0), t(2), t(1))))[0] == "0/2|1"
    assert one(spark, g.is_partial(t("0/.")), g.is_null(t("./.")), g.is_empty(t(".")), g.is_hom(t("1/1")), g.is_het(t("0/2"))) == (True,) * 5
    assert one(spark, g.transition(t("G"), t("A")), g.transition(t("a"), t("g"))) == ("C>T", "A>G")


@pytest.mark.parametrize("seq,pos,ref,alt,want", [
    ("TTTCGCGCGCGCG", 14, "", "CG", (4, "", "CG", 10)), ("AGAGAGAAAGAAAG", 3, "AG", "", (1, "AG", "", 2)), ("ACGT", 2, "C", "T", (2, "C", "T", 0)),
])
def test_left_shift(spark, seq, pos, ref, alt, want):
    v = spark.createDataFrame([("c", pos, ref, alt)], "chrom string, pos bigint, ref string, alt string")
    s = spark.createDataFrame([("c", seq)], "name string, seq string")
    for windows in ((64,), (2, 4)):
        assert tuple(sequences.left_aligned(v, s, windows).first())[1:] == want


def test_cigar():
    assert cigar.parse("3M2M1D") == [(5, "M"), (1, "D")]
    assert cigar.compose("10M2D10M", "8M", 6) == "5M2D3M"
    assert cigar.compose("10M3I10M", "20M", 1) == "10M3I7M"
    assert cigar.compose("20=", "3M1I4M1X2M", 2) == "3M1I4M1X2M"
    with pytest.raises(ValueError):
        cigar.compose("10M", "2S8M", 1)
    with pytest.raises(ValueError):
        cigar.parse("5Q")
    line = "\t".join(["r", "0", "c", "1", "60", "8M", "*", "0", "0", "*", "*", "MD:Z:8", "ZR:Z:REMAP-1|1|30-10M2D10M,6"])
    assert cigar.remap_line(line).split("\t")[5] == "5M2D3M" and "MD:Z" not in cigar.remap_line(line)


def test_merged_alleles():
    assert merging.merged_alleles([(10, "A", ["C"]), (10, "A", ["G", "C"])]) == ("A", ["C", "G"], [[1], [2, 1]])
    assert merging.merged_alleles([(10, "AC", ["A"]), (11, "CG", ["C"])]) == ("ACG", ["AG", "AC"], [[1], [2]])
    assert merging.merged_alleles([(10, "A", ["C"]), (12, "G", ["T"])]) is None
    assert merging.merged_alleles([(10, "A", ["C"])]) is None


def record(source, alts, samples, **more):
    return dict(source=source, ord=source, chrom="1", pos=5, ids=[f"i{source}"], ref="A", alts=alts, qual=9.0, filters=["PASS"], info={}, format=["DP", "GT"], samples=samples) | more


def test_merge_component():
    a = record(0, ["C"], {"x": {"GT": "0/1"}}, info={"N": ["1"], "P": ["u/v"], "S": ["2"]})
    b = record(1, ["G"], {"y": {"GT": "1/1"}}, info={"N": ["1"], "P": ["w"], "S": ["3"]}, filters=["q10"])
    s = merging.Strategy({"N": "uniq-concat", "P": "per-alt-delimited-list", "S": "sum"}, fields={"P": merging.Field("A"), "S": merging.Field("1", "Integer")})
    (m,) = merging.merge_component([a, b], s)
    assert m["alts"] == ["C", "G"] and m["ids"] == ["i0", "i1"] and m["filters"] == ["q10"] and m["qual"] is None and m["format"] == ["GT", "DP"]
    assert m["info"] == {"N": ["1"], "P": ["u/v", "w"], "S": ["5"]} and m["samples"]["y"]["GT"] == "2/2"
    c = record(2, ["C"], {"x": {"GT": "1/1", "DP": "7"}})
    with pytest.raises(ValueError):
        merging.merge_component([a, c], merging.Strategy())
    (m,) = merging.merge_component([a, c], merging.Strategy(merge_samples=True, consensus=0.6, consensus_filter="CNS", declared={"x": 4}))
    assert m["samples"]["x"] == {"GT": "0/1", "DP": "7", "FT": "CNS"} and m["filters"] == ["CNS"]
    with pytest.raises(ValueError):
        merging.merge_component([a, record(1, ["G"], {}, info={"N": ["2"]})], merging.Strategy({"N": "enforce-equal"}))


def test_strategy_file():
    s = merging.Strategy.parse(["# c", "default = first", "info.DP=sum"])
    assert s.default == "first" and s.mergers == {"DP": "sum"}
    for bad in ("info.X=what", "x", "y=first"):
        with pytest.raises(ValueError):
            merging.Strategy.parse([bad])


def test_headers():
    h = vcf.Header.parse(["##fileformat=VCFv4.1", '##INFO=<ID=DP,Number=1,Type=Integer,Description="a, b">', "##SAMPLE=<ID=s,Tags=<a,b>>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\tt"])
    assert h.samples == ["s", "t"] and h.info["DP"].description == "a, b"
    other = vcf.Header(samples=["t", "u"], sources={"t": 1, "u": 1}, info={"DP": vcf.FieldType("DP", "1", "Float")})
    with pytest.raises(ValueError):
        h.merge(other)
    m = h.merge(vcf.Header(samples=["t", "u"], sources={"t": 1, "u": 1}))
    assert m.samples == ["s", "t", "u"] and m.sources == {"s": 1, "t": 2, "u": 1}
    assert h.mirror("-x").samples == ["s", "t", "s-x", "t-x"] and h.rename({"s": "a"}).samples == ["a", "t"]
    with pytest.raises(ValueError):
        h.rename({"s": "t"})
    with pytest.raises(ValueError):
        vcf.parse_map("<A=1,A=2>")


def test_bad_formats():
    for bad in ("", "Q", "A3-1", "I3"):
        with pytest.raises(ValueError):
            projection.compile_format(bad)
    with pytest.raises(ValueError):
        sequences.check_tokens(["a/t", "t"])


def test_split_and_join(spark):
    v = lambda p, r, a: al.variant(F.lit(p), F.lit(r), F.lit(a))
    (got,) = one(spark, al.split_indel(v(10, "AC", "GCTT")))
    assert (tuple(got.substitution), tuple(got.indel)) == ((10, "A", "G"), (12, "", "TT"))
    (got,) = one(spark, al.split_indel(v(10, "GCTT", "AC")))
    assert (tuple(got.substitution), tuple(got.indel)) == ((10, "G", "A"), (12, "TT", ""))
    assert one(spark, al.split_indel(v(10, "A", "G")))[0].indel is None
    assert tuple(one(spark, al.join_variants(v(10, "A", "G"), v(12, "", "TT"), F.lit("ACGT"), F.lit(10)))[0]) == (10, "AC", "GCTT")
    assert one(spark, al.join_variants(v(10, "AC", "G"), v(11, "C", "T"), F.lit("ACGT"), F.lit(10)))[0] is None
    assert one(spark, al.covered_reference(F.array(v(5, "ACG", "A"), v(6, "CG", "C"), v(10, "TT", "T"))))[0] == "ACG..TT"
    assert tuple(one(spark, al.indel_aware_span(F.lit(5), F.lit("AC"), F.array(F.lit("A"))))[0]) == (5, 7)


def test_base_contigs(spark):
    v = spark.createDataFrame([("1", 4, 5, "A", "R"), ("1", 4, 4, "", "TT"), ("1", 2, 4, "GT", "")], "chrom string, start bigint, stop bigint, ref string, alt string")
    s = spark.createDataFrame([("1", "ACGTACGT")], "name string, seq string")
    got = dict(map(tuple, sequences.base_contigs(v, s, 2).collect()))
    assert got == {"REMAP-1|2|7|2=1X2=|2|3|G": "GTGCG", "REMAP-1|2|6|2=2I2=|2|4|TT": "GTTTAC", "REMAP-1|0|6|2=2D2=|2|2|GT": "ACAC"}
