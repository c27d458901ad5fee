"""Line numbers, bad lines, tracks and ordered sinks over files that many tasks read or write."""
import random
import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from helixspan.functions.natkey import natural_key
from helixspan.operators import signal
from helixspan.sources import lines, sinks, text, vcf


@contextmanager
def splits(spark, size):
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in keys:
            spark.conf.unset(k)


@pytest.mark.parametrize("size", [50, 333, 100_000])
def test_numbers(spark, tmp_path, size):
    rng = random.Random(1)
    want = []
    for name, n in (("a", 300), ("b", 1), ("c", 77)):
        rows = ["" if rng.random() < 0.2 else f"{name}{i}" + "x" * rng.randrange(30) for i in range(n)]
        (tmp_path / f"{name}.txt").write_text("\n".join(rows) + "\n")
        want += [(name, i + 1, r) for i, r in enumerate(rows)]
    with splits(spark, size):
        rows = lines.numbered(spark, str(tmp_path))
        got = rows.withColumn("name", F.regexp_extract("file", r"(\w)\.txt", 1))
        assert sorted((r["name"], r["line"], r["value"]) for r in got.collect()) == sorted(want)
        assert size > 1000 or rows.select("file", "split").distinct().count() > 5
        sums = lines.running(rows.withColumn("n", F.length("value")), {"far": F.col("n")})
        total = {}
        expect = set()
        for name, i, r in want:
            total[name] = total.get(name, 0) + len(r)
            expect.add((name, i, total[name]))
        assert {(re.search(r"(\w)\.txt", r["file"])[1], r["line"], r["far"]) for r in sums.collect()} == expect


@pytest.mark.parametrize("size", [40, 100_000])
def test_bad_lines(spark, tmp_path, size):
    rng = random.Random(2)
    rows, bad, late, last = [], set(), set(), None
    for i in range(1, 400):
        kind = rng.randrange(12)
        c, s = f"chr{rng.choice([1, 2, 10])}", rng.randrange(100)
        e = s + rng.randrange(4)
        if kind == 0:
            rows.append(rng.choice(["", "# note", "   "]))
        elif kind == 1:
            line, reason = rng.choice([(f"\t{s}\t{e}", 0), (c, 1), (f"{c}\tx\t{e}", 1), (f"{c}\t{s}", 2), (f"{c}\t{s}\t1.5", 2), (f"{c}\t{s + 9}\t{s}", 3)])
            rows.append(line)
            bad.add((i, lines.BED_FAULTS[reason], line))
        else:
            rows.append(f"{c}\t{s}\t{e}\textra")
            key = (int(c[3:]), s)
            if last and (key[0] < last[0] or (key[0] == last[0] and s < last[1] and e <= last[1])):
                late.add((i, lines.BED_FAULTS[4], rows[-1]))
            last = key
    (tmp_path / "a.bed").write_text("\n".join(rows))
    with splits(spark, size):
        good, found = lines.checked_bed(spark, str(tmp_path / "a.bed"), in_order=True)
        assert {(r["line"], r["reason"], r["value"]) for r in found.collect()} == bad | late
        skip = {i for i, *_ in bad | late}
        assert {r["line"] for r in good.collect()} == {i for i, r in enumerate(rows, 1) if r.strip() and r[0] != "#" and i not in skip}


def test_bad_variant_lines(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\n1\t5\t.\tA\tC\t.\tPASS\t.\n1\tq\t.\tA\tC\t.\t.\t.\n1\t5\t.\tA\tC\t9x\t.\t.\n1\t5\n1\t7\t.\t.\tC\t3\t.\t.\n")
    good, bad = lines.checked_vcf(spark, str(tmp_path / "a.vcf"))
    assert [r["line"] for r in good.collect()] == [3]
    assert {(r["line"], r["reason"]) for r in bad.collect()} == {(4, lines.VCF_FAULTS[1]), (5, lines.VCF_FAULTS[2]), (6, lines.VCF_FAULTS[0]), (7, lines.VCF_FAULTS[3])}


@pytest.mark.parametrize("size", [60, 100_000])
def test_tracks_go_on_over_splits(spark, tmp_path, size):
    rng = random.Random(3)
    out, want, prev = ["track type=wiggle_0"], [], None
    for b in range(6):
        start, step, span = rng.randrange(1, 1000), *rng.choice([(1, 1), (5, 5), (5, 2)])
        out.append(f"fixedStep chrom=chr{b} start={start} step={step} span={span}")
        runs = []
        for i in range(rng.choice([1, 3, 120])):
            v = rng.randrange(3)
            out.append(f" {v}")
            lo = start - 1 + i * step
            if runs and step == span and runs[-1][3] == v:
                runs[-1][2] = lo + span
            else:
                runs.append([f"chr{b}", lo, lo + span, float(v)])
            if rng.random() < 0.05:
                out.append("")
        want += map(tuple, runs)
    (tmp_path / "a.wig").write_text("\n".join(out) + "\n")
    with splits(spark, size):
        points = text.read_wiggle(spark, str(tmp_path / "a.wig"))
        assert sorted(map(tuple, signal.track_intervals(points).collect())) == sorted(want)
        assert sorted(map(tuple, signal.track_intervals(points.drop("at", "file", "split")).collect())) == sorted(want)


def test_sinks_write_ordered_parts(spark, tmp_path):
    header = vcf.Header.parse(["##fileformat=VCFv4.1", '##INFO=<ID=DP,Number=1,Type=Integer,Description="d">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"])
    rows = spark.range(3000).selectExpr(
        "CAST(id % 10 = 0 AS int) AS source", "concat('chr', CAST(id * 7 % 12 AS STRING)) AS chrom", "id * 31 % 997 AS pos", "array('r') AS ids", "'A' AS ref", "array('C') AS alts", "1.0D AS qual",
        "array('PASS') AS filters", "map('DP', array(CAST(id AS STRING))) AS info", "CAST(array() AS array<string>) AS format", "CAST(map() AS map<string,map<string,string>>) AS samples")

    def read(folder):
        parts = sorted(p for p in folder.iterdir() if p.name.startswith("part-"))
        return parts, [x for p in parts for x in p.read_text().splitlines()]

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_by_source(rows, header, str(tmp_path / "s"))
        sinks.write_vcf(rows, header, str(tmp_path / "v"))
        sinks.write_bed(rows.selectExpr("chrom", "pos AS start", "pos + 1 AS stop"), str(tmp_path / "b"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for folder, n in ((tmp_path / "s" / "source=0", 2700), (tmp_path / "s" / "source=1", 300), (tmp_path / "v", 3000)):
        parts, got = read(folder)
        assert got[:3] == header.render() and len(got) == n + 3 and not any(x.startswith("#") for x in got[3:])
        keys = [(int(x.split("\t")[0][3:]), int(x.split("\t")[1])) for x in got[3:]]
        assert keys == sorted(keys)
        assert n < 1000 or len(parts) > 1
    parts, got = read(tmp_path / "b")
    keys = [(int(x.split("\t")[0][3:]), int(x.split("\t")[1])) for x in got]
    assert len(got) == 3000 and keys == sorted(keys) and len(parts) > 1


def test_natural_order_of_long_numbers(spark):
    names = ["x2", "x10", "x" + "9" * 20, "x1" + "0" * 20, "x2" + "0" * 20, "x1" + "0" * 24, "x10y", "x" + "0" * 30 + "7", "x" + "0" * 30 + "11z", "x3" + "0" * 20 + "a1", "x3" + "0" * 20 + "a" + "5" * 25]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(natural_key(F.col("n")), "n").collect()]
    parts = lambda n: [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.findall(r"\d+|\D+", n)]
    assert got == sorted(names, key=lambda n: (parts(n), n))
