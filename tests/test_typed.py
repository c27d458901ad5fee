"""INFO values as variants: types, missing values, sums, comparisons, and what doesn't fit."""
import pytest
from pyspark.sql import functions as F

from helixspan.operators import merging, typed
from helixspan.sources import vcf

HEADER = vcf.Header.parse([
    "##fileformat=VCFv4.1", '##INFO=<ID=N,Number=1,Type=Integer,Description="n">', '##INFO=<ID=X,Number=.,Type=Float,Description="x">', '##INFO=<ID=F,Number=0,Type=Flag,Description="f">',
    '##INFO=<ID=S,Number=1,Type=String,Description="s">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO",
])


def records(spark, infos):
    rows = [(0, i, f"c{i % 2}", i, [], "A", ["C"], None, [], info, [], {}) for i, info in enumerate(infos)]
    return spark.createDataFrame(rows, merging.RECORD)


def test_types(spark):
    rows = typed.with_typed(records(spark, [{"N": ["5"], "X": ["1.5", None, "2"], "F": [], "S": ["7"], "U": ["8"]}, {"N": ["five"]}, {}]), HEADER).orderBy("ord")
    kinds = rows.select(F.transform_values("typed", lambda k, v: F.schema_of_variant(v)).alias("k")).first().k
    assert kinds == {"N": "ARRAY<BIGINT>", "X": "ARRAY<DOUBLE>", "F": "BOOLEAN", "S": "ARRAY<STRING>", "U": "ARRAY<STRING>"}
    got = rows.select(typed.elements("N", "bigint"), typed.elements("X", "double"), typed.elements("S", "string")).collect()
    assert [tuple(r) for r in got] == [([5], [1.5, None, 2.0], ["7"]), ([None], None, None), (None, None, None)]


def test_sums_and_comparisons(spark):
    big = 9_007_199_254_740_993  # beyond a double's integers
    rows = typed.with_typed(records(spark, [{"N": [str(big)], "X": ["1", "2"]}, {"N": ["2"], "X": ["0.5"]}, {"N": ["1"], "X": ["1.0", "2.00"]}, {"N": [None], "X": ["3", None, "4"]}, {}]), HEADER)
    got = {r.chrom: (r.N, r.X) for r in typed.summed(rows, ["chrom"], HEADER, ["N", "X"]).collect()}
    assert got == {"c0": ([big + 1], [2.0, 4.0]), "c1": ([2], [3.5, None, 4.0])}
    assert {r.chrom: (r.N, r.X) for r in typed.same_values(rows, ["chrom"], HEADER, ["N", "X"]).collect()} == {"c0": (False, True), "c1": (False, False)}
    with pytest.raises(ValueError, match="isn't a number"):
        typed.summed(rows, ["chrom"], HEADER, ["S"])


def test_what_does_not_fit_is_located(spark, tmp_path):
    lines = [*HEADER.render(), "c\t1\t.\tA\tC\t.\t.\tN=1;F;X=1,2", "c\t2\t.\tA\tC\t.\t.\tN=a;F=1;U=2", "", "c\tx\t.\tA\tC\t.\t.\tN=1", "c\t3\t.\tA\tC\t.\t.\tN=1,2;S=.;X=."]
    (tmp_path / "a.vcf").write_text("\n".join(lines) + "\n")
    rows, bad = typed.checked(spark, str(tmp_path / "a.vcf"))
    at = len(HEADER.render())
    assert {(r.line, r.pos) for r in rows.collect()} == {(at + 1, 1), (at + 2, 2), (at + 5, 3)}
    assert {(r.line, r.reason, r.value) for r in bad.collect()} == {
        (at + 2, typed.FAULTS[1], "N=a"), (at + 2, typed.FAULTS[2], "F=1"), (at + 2, typed.FAULTS[0], "U=2"), (at + 4, "no position", "c\tx\t.\tA\tC\t.\t.\tN=1"), (at + 5, typed.FAULTS[2], "N=1,2"),
    }
