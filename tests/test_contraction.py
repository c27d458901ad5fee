"""Components by contraction, islands of any size, and masks of any width."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from helixspan.operators import compare, contraction, merging


def plainly(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(5, 3)], [(i, i + 1) for i in range(150)], [(0, i) for i in range(1, 300)], [(i * 7919 % 1009, i * 104729 % 1009) for i in range(900)], [(9, 4), (4, 9), (9, 7), (20, 7), (20, 21), (30, 31)],
])
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in contraction.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: c for n, c in plainly(edges).items() if n != c}


def record(i, pos, ref, alts, chrom="c"):
    return (0, i, chrom, pos, [], ref, alts, None, [], {}, [], {})


def test_islands_small_and_large(spark):
    rng = np.random.default_rng(1)
    rows = [record(i, int(p), "ACGTACGT"[: int(rng.integers(1, 6))], ["T" * int(rng.integers(1, 4))]) for i, p in enumerate(rng.integers(1, 120, 400))]
    df = spark.createDataFrame(rows, merging.RECORD)
    want = sorted(map(tuple, merging.with_components(df, 10**6).select("ord", "component").collect()))
    for small in (0, 3, 40):
        assert sorted(map(tuple, merging.with_components(df, small).select("ord", "component").collect())) == want


def test_one_island_of_many_records(spark):
    """Each record overlaps the next ones, and every two neighbours of a thousand edit one region."""
    n = 200_000
    rows = spark.range(n).selectExpr(
        "0 AS source", "id AS ord", "'c' AS chrom", "id DIV 2 * 3 + 1 AS pos", "CAST(array() AS array<string>) AS ids", "'ACGTA' AS ref", "array('ACGTT') AS alts", "CAST(NULL AS double) AS qual",
        "CAST(array() AS array<string>) AS filters", "CAST(map() AS map<string,array<string>>) AS info", "CAST(array() AS array<string>) AS format", "CAST(map() AS map<string,map<string,string>>) AS samples")
    out = merging.with_components(rows)
    got = out.agg(F.count_distinct("component"), F.sum("component"), F.count_distinct("island"), F.count("*")).first()
    assert tuple(got) == (n // 2, sum(2 * (i // 2) for i in range(n)), 1, n)


@pytest.mark.parametrize("n_files", [5, 62, 63, 130])
def test_masks(spark, n_files):
    rng = np.random.default_rng(n_files)
    calls = [(b, int(f), b * 1000 + i, "s", sorted(rng.choice(["x", "y", "z"], rng.integers(1, 3)).tolist()), False) for b in range(30) for i, f in enumerate(rng.choice(n_files, 4))]
    df = spark.createDataFrame(calls, "bundle bigint, source int, record bigint, sample string, alleles array<string>, has_null boolean")
    words = compare.words_for(n_files)
    assert (words is None) == (n_files < 63)
    partial, exact = {}, {}
    for b, f, _, _, al, _ in calls:
        for a in set(al):
            partial.setdefault((b, a), set()).add(f)
        exact.setdefault((b, tuple(al)), set()).add(f)
    count = {}
    for kind, groups in (("partial_match", partial), ("exact_match", exact)):
        for fs in groups.values():
            key = (kind, "".join("1" if n_files - 1 - i in fs else "0" for i in range(n_files)))
            count[key] = count.get(key, 0) + 1
    counts = compare.mask_counts(df, words)
    got = {(r["kind"], r["files"]): r["s"] for r in compare.sparse_table(counts, n_files, ["s"]).filter("kind IN ('partial_match', 'exact_match')").collect()}
    assert got == count
    more = compare.at_least(counts, n_files).withColumn("files", F.array_join(F.reverse(compare.flags(F.col("mask"), n_files)), "")).filter("kind IN ('partial_match', 'exact_match')").collect()
    inside = lambda a, b: all(y == "1" for x, y in zip(a, b) if x == "1")
    assert {(r["kind"], r["files"]): r["n_at_least"] for r in more} == {(k, m): sum(n for (k2, m2), n in count.items() if k2 == k and inside(m, m2)) for k, m in count}
    for r in compare.match_vectors(df, n_files).collect():
        al = next(c[4] for c in calls if c[2] == r["record"] and c[1] == r["source"])
        e = exact[r["bundle"], tuple(al)]
        p = set().union(*[partial[r["bundle"], a] for a in al])
        if sum(c[1] == r["source"] and c[2] == r["record"] for c in calls) == 1:
            assert r["exact"] == [int(i in e) for i in range(n_files)]
            assert r["partial"] == [int(i in p - e) for i in range(n_files)]


def test_renumbering():
    assert merging.renumber("0/1|2", [5, 130]) == "0/5|130" and merging.renumber("3/.", [5, 130]) == "./."
