"""Joins of deep tables against all pairs."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from helixspan.operators import overlap, reach, sweep

SCHEMA = "chrom string, start bigint, stop bigint, id int"


def table(rng, n, far, longest, empty):
    start = rng.integers(0, far, n)
    size = np.where(rng.random(n) < empty, 0, rng.integers(1, longest + 1, n))
    rows = [(f"c{int(c)}", int(s), int(s + z), i) for i, (c, s, z) in enumerate(zip(rng.integers(0, 3, n), start, size))]
    return [*rows, rows[0], (None, 1, 5, -1), ("c0", None, 5, -2), ("c0", 3, None, -3)]


def meets(a, b, adjacent):
    if a[0] != b[0] or None in (*a[:3], *b[:3]):
        return False
    if (a[1] < b[2] and b[1] < a[2]) or (a[1] == a[2] == b[1] == b[2]):
        return True
    return adjacent and (a[1] == a[2] or b[1] == b[2]) and a[1] <= b[2] and b[1] <= a[2]


CASES = [(0, 40, 6, 0.4, 5), (1, 300, 200, 0.1, 64), (2, 1000, 30, 0.0, 128), (3, 12, 3, 0.8, 4), (4, 2000, 2000, 0.2, 300)]


@pytest.mark.parametrize("adjacent", [False, True])
@pytest.mark.parametrize("seed, far, longest, empty, width", CASES)
def test_semi_anti_and_sweep(spark, seed, far, longest, empty, width, adjacent):
    rng = np.random.default_rng(seed)
    a, b = table(rng, 90, far, longest, empty), table(rng, 70, far, longest, empty)
    da, db = (spark.createDataFrame(x, SCHEMA).repartition(3) for x in (a, b))
    pairs = sorted((x, y) for x in a for y in b if meets(x, y, adjacent))
    has = {x for x, _ in pairs}
    show = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert show(reach.meeting(da, db, adjacent, width).filter("_met").drop("_met")) == sorted((x for x in a if x in has), key=str)
    assert show(reach.anti(da, db, adjacent)) == sorted((x for x in a if x not in has), key=str)
    for room in (4096, 7):
        got = sweep.sweep_join(da, db, adjacent, width=width, room=room).collect()
        assert sorted(((r.chrom, r.a_start, r.a_stop, r.a_id), (r.chrom, r.b_start, r.b_stop, r.b_id)) for r in got) == pairs
    if not adjacent:
        n = {x: sum(meets(x, y, False) for y in b) for x in a}
        assert show(reach.partner_counts(da, db, width)) == sorted(((*x, n[x]) for x in a), key=str)


def test_pile_up_is_split_over_tasks(spark):
    a = spark.range(10_000).selectExpr("'c' AS chrom", "500 + id % 3 AS start", "510 + id % 5 AS stop", "id AS a")
    b = spark.range(300).selectExpr("'c' AS chrom", "505 + id % 4 AS start", "508 + id % 40 AS stop", "id AS b")
    pairs = sweep.sweep_join(a, b, room=500)
    got = pairs.withColumn("task", F.spark_partition_id()).agg(F.count("*"), F.sum("a_a"), F.sum("b_b"), F.count_distinct("task"), F.count_distinct("a_a", "b_b")).first()
    want = overlap.overlap_join(a, b, tiers=1).agg(F.count("*"), F.sum("a_a"), F.sum("b_b")).first()
    assert tuple(got)[:3] == tuple(want) and got[4] == got[0] and got[3] > 1


def test_semi_of_deep_rows_makes_no_pairs(spark):
    a = spark.range(50_000).selectExpr("'c' AS chrom", "id % 5 AS start", "id % 5 + 3 AS stop")
    b = spark.range(50_000).selectExpr("'c' AS chrom", "id % 4 + 2 AS start", "id % 4 + 9 AS stop")
    assert reach.semi(a, b).count() == 50_000
    assert reach.partner_counts(a, b).agg(F.sum("n")).first()[0] == sum(
        10_000 * 12_500 * (s < e2 and s2 < e) for s, e in ((i, i + 3) for i in range(5)) for s2, e2 in ((i + 2, i + 9) for i in range(4)))


def test_empty_sides_and_residual(spark):
    a = spark.createDataFrame([("c", 1, 5, 1), ("c", 2, 6, 2)], SCHEMA)
    none = a.limit(0)
    assert sweep.sweep_join(a, none).collect() == [] and sweep.sweep_join(none, a).collect() == []
    assert reach.semi(a, none).count() == 0 and reach.anti(a, none).count() == 2 and reach.anti(none, a).count() == 0
    assert [(r.a_id, r.b_id) for r in sweep.sweep_join(a, a, residual=F.col("a_id") < F.col("b_id")).collect()] == [(1, 2)]


def test_short_rows_make_no_pairs_in_bins_of_long_ones(spark):
    short = lambda n: spark.range(n).selectExpr("'c' AS chrom", "id * 7 AS start", "id * 7 + 5 AS stop", "CAST(id AS INT) AS id")
    long = spark.createDataFrame([("c", 3, 150_000, -1), ("c", 70_000, 9_000_000, -2)], SCHEMA)
    a, b = short(9000).unionByName(long), short(9100).unionByName(long)
    keys = ["chrom", "tier", "bin"]
    met = overlap.binned(a, 1024, 3, 0, "a").join(overlap.binned(b, 1024, 3, 0, "b"), keys)
    pairs = overlap.overlap_join(a, b, tiers=3)
    assert met.count() < 200 * 9100  # all pairs of short rows in two bins of 65,536 places would be 80 million
    assert pairs.count() == 9000 + 4 + sum(s < e2 and s2 < e for s2, e2 in ((3, 150_000), (70_000, 9_000_000)) for n in (9000, 9100) for s, e in ((i * 7, i * 7 + 5) for i in range(n)))
    assert pairs.count() == pairs.distinct().count()


def test_deep_rows_go_through_the_sweep_by_place(spark, tmp_path, monkeypatch):
    from helixspan.plans import queries

    spark.range(40_000).selectExpr("id % 5 AS l_orderkey", "id AS l_suppkey", "CAST(id % 4 + 1 AS INT) AS l_linenumber", "CAST(id % 7 AS DOUBLE) AS l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(9000).selectExpr("id % 3 AS s_suppkey", "CAST(id % 10 AS INT) AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    swept, plain = [], sweep.sweep_join
    monkeypatch.setattr(queries.sweep, "sweep_join", lambda a, b, **more: swept.append((a.count(), b.count())) or plain(a, b, **more))
    got = {(r.chrom, r.b_start): (r.n, r["keys"], r.shared) for r in queries.sweep_join_of_deep_rows(spark, str(tmp_path)).collect()}
    assert swept[0][0] <= 3 * 5 * 8 and swept[0][1] <= 3 * 10
    a, b = {}, {}
    for i in range(40_000):
        s, size = i % 5 * 53 % 3000, 0 if (i % 4 + 1) % 2 == 0 else i % 7
        n, k = a.get((i % 3, s, s + size), (0, 0))
        a[i % 3, s, s + size] = n + 1, k + i % 5 * 10 + i % 4 + 1
    for i in range(9000):
        p = (i % 3, i % 3 * 37, i % 3 * 37 + i % 10)
        b[p] = b.get(p, 0) + 1
    want = {}
    for x, (n, k) in a.items():
        for y, m in b.items():
            if meets(x, y, False):
                w = want.setdefault((f"chr{x[0] + 1}", y[1]), [0, 0, 0])
                w[0], w[1], w[2] = w[0] + n * m, w[1] + k * m, w[2] + n * m * (min(x[2], y[2]) - max(x[1], y[1]))
    assert got == {k: tuple(w) for k, w in want.items()} and want


@pytest.mark.parametrize("rule", ["partial", "strand"])
def test_allele_matches_are_looked_at_once_for_values(spark, rule):
    residual = lambda: overlap.partial_allele_match() if rule == "partial" else overlap.strand_agnostic_match(F.array("b_ref", "b_alt"))
    rng = np.random.default_rng(6)
    pick = lambda n, of: [None if x == "-" else str(x) for x in rng.choice(list(of), n)]
    schema = "chrom string, start bigint, stop bigint, ref string, alt string, id int"
    da, db = (spark.createDataFrame([(c, int(s), int(s) + 1, r, x, i) for i, (c, s, r, x) in enumerate(zip(pick(n, "xy-"), rng.integers(0, 4, n), pick(n, "ACGT-"), pick(n, of)))], schema).repartition(3) for n, of in ((90, "ACGT-"), (80, "ACMRNT-")))
    want = overlap.equal_join(da, db, residual=residual())
    pairs = overlap.equal_join_by(da, db, ("ref", "alt"), residual())
    assert pairs.columns == want.columns and sorted(map(str, pairs.collect())) == sorted(map(str, want.collect())) and want.count() > 5
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2
