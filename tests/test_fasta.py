"""Indexed sequence files against the text itself, for ranges of bytes that cut records and lines anywhere."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from helixspan.sources import bytes as ranges
from helixspan.sources import fasta


def write(path, records, wrap, end="\n", tail="\n"):
    body = [f">{n}{end}" + end.join(s[i : i + wrap] for i in range(0, len(s), wrap)) for n, s in records]
    path.write_bytes((end.join(body) + tail).encode())


@pytest.fixture(scope="module")
def records():
    rng = np.random.default_rng(0)
    return [(f"c{i} comment {i}", "".join(rng.choice(list("ACGTacgtN"), n))) for i, n in enumerate((1, 7, 10, 11, 300, 2000, 20))]


@pytest.mark.parametrize("span", [3, 17, 64, 1000, 1 << 20])
@pytest.mark.parametrize("end, tail", [("\n", "\n"), ("\r\n", ""), ("\n", "\n\n\n")])
def test_index_and_ranges(spark, tmp_path, records, span, end, tail):
    write(tmp_path / "a.fa", records[:5], 10, end, tail)
    write(tmp_path / "b.fa", records[5:], 7, end, tail)
    to = str(tmp_path / "index")
    fasta.write_index(spark, [str(tmp_path / "a.fa"), str(tmp_path / "b.fa")], to, span)
    want = {n.split()[0]: s for n, s in records}
    rows = spark.read.parquet(to).collect()
    assert {(r["name"], r["length"]) for r in rows} == {(n, len(s)) for n, s in want.items()}
    if span != 64:
        return
    got = fasta.read_ranges(spark, to, 16, 100).collect()
    assert sorted((r["name"], r["start"], r["stop"], r["bases"]) for r in got) == sorted((n, i, min(i + 16, len(s)), s[i : i + 16]) for n, s in want.items() for i in range(0, len(s), 16))
    asked = spark.createDataFrame([("c4", 5, 25, 1), ("c4", 290, 900, 2), ("c5", 0, 2000, 3), ("c0", 0, 0, 4), ("none", 0, 5, 5), ("c4", 400, 500, 6)], "name string, start bigint, stop bigint, id int")
    got = {r["id"]: r["bases"] for r in fasta.fetch(asked, spark.read.parquet(to)).collect()}
    assert got == {1: want["c4"][5:25], 2: want["c4"][290:], 3: want["c5"], 4: "", 6: ""}


def test_filters_choose_what_is_read(spark, tmp_path, records):
    write(tmp_path / "a.fa", records, 10)
    to = str(tmp_path / "index")
    fasta.write_index(spark, str(tmp_path / "a.fa"), to)
    rows = fasta.read_ranges(spark, to, 16)
    some = rows.filter((F.col("name") == "c5") & (F.col("start") >= 100) & (F.col("stop") <= 164))
    assert [(r["start"], r["bases"]) for r in some.orderBy("start").collect()] == [(i, records[5][1][i : i + 16]) for i in range(112, 148, 16)]
    assert rows.filter(F.col("name").isin("c0", "c1") & F.col("bases").contains("A")).count() == sum("A" in s for _, s in records[:2])
    assert rows.filter("start < 0").count() == 0
    reader = fasta.RangesReader({"index": to, "piece": "16"})
    assert list(reader.pushFilters([fasta.EqualTo(("name",), "c5"), fasta.GreaterThan(("start",), 1900)])) == []
    assert {r[5] for p in reader.partitions() for r in p.rows} == {i for i in range(1904, 2000, 16)}


@pytest.mark.parametrize("text, fault", [(">a\nACGT\nAC\nACGT\n", "uneven"), (">a\nACGT\n\nACGT\n", "uneven"), ("ACGT\n>a\nAC\n", "before the first"), (">a\n>b\nAC\n", "empty"), (">a\nAC\nACGT\n", "uneven")])
@pytest.mark.parametrize("span", [2, 5, 100])
def test_files_that_cannot_be_indexed(spark, tmp_path, text, fault, span):
    (tmp_path / "a.fa").write_text(text)
    with pytest.raises(Exception, match=fault):
        fasta.index(spark, str(tmp_path / "a.fa"), span).collect()


def test_lines_of_ranges(tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "BLOCK", 4)
    data = b"a\n\nbcdefghijklm\nno\n" + b"x" * 30 + b"\nend"
    (tmp_path / "f").write_bytes(data)
    want, at = [], 0
    for line in data.split(b"\n"):
        want.append((at, line))
        at += len(line) + 1
    for span in (1, 2, 3, 7, 100):
        got: dict = {}
        for start in range(0, len(data), span):
            with open(tmp_path / "f", "rb") as f:
                for o, part, ended in ranges.lines_from(f, start, min(start + span, len(data))):
                    got[o] = got.get(o, b"") + part
        assert sorted(got.items()) == want
