"""The divergence audit against plain dictionaries, and its tournament's schedule."""
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("helixspan.llm")
from helixspan.llm import divergence  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, LANG2 string, value bigint, block bigint, n bigint"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plainly(rows, least_docs=3, ranks=200):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(lower))
        groups[lang].add(source)
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if d >= least_docs]
        v = len(kept)
        total = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        all_n = {t: sum(count[lang, s][t] for s in sources) for t in kept}
        share = lambda c, n: 1 + 1_000_000_000 * (c + 1) // (n + v)
        p = {s: {t: share(count[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(all_n[t], sum(all_n.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
                out |= {(lang, s, part, i.decode(), -x, k + 1) for k, (x, i) in enumerate(items)}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(120)] + ["été", "漢字", "ÄÖ", "naïve"]
    out = []
    for i in range(260):
        s = int(rng.integers(0, 13)) if i % 3 else 0  # one source has over a third
        some = rng.choice(words, rng.integers(0, 30), p=np.roll(np.arange(1, len(words) + 1), 5 * s) / (len(words) * (len(words) + 1) / 2))
        out.append((" ".join(some).upper() if i % 7 == 0 else "-".join(some), ["en", "de", None][i % 3] if i % 5 else "en", None if i % 41 == 0 else f"s{s}"))
    out += [out[0]] * 4 + [(None, "en", "silent"), ("", "xx", "a"), ("once only", "xx", "b"), ("123 ...", "xx", ""), ("big " * 20_000 + "x" * 4000, "en", "s1"), ("a lonely lang", "yy", "z")]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "c", 1, 2, 3) for i, r in enumerate(rows)], SCHEMA).repartition(5)


@pytest.mark.parametrize("options", [{}, {"block_entries": (40, 90)}, {"block_entries": (7, 7), "seats": 3}, {"seats": 1, "ranks": 5}, {"seats": 4, "least_docs": 1, "block_entries": (100, 100)}])
def test_audit(spark, rows, options):
    got = divergence.audit(frame(spark, rows), **options).collect()
    want = plainly(rows, options.get("least_docs", 3), options.get("ranks", 200))
    assert len(got) == len(want)
    assert set(map(tuple, got)) == want


def test_counts_are_passed_on_in_parts(spark, rows, monkeypatch):
    whole = sorted(map(tuple, divergence.term_counts(frame(spark, rows)).collect()))
    assert sum(r[3] for r in whole) == sum(len(TERM.findall(t or "")) for t, *_ in rows)
    counted = divergence.term_counts(frame(spark, rows).coalesce(1))
    assert sorted(map(tuple, counted.collect())) == whole


def test_empty_table(spark, rows):
    assert divergence.audit(frame(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("seats", [1, 2, 3, 4, 5, 8, 11, 64])
def test_every_two_seats_meet_once_and_a_seat_meets_one_in_a_round(seats):
    rounds = defaultdict(list)
    hosts = Counter()
    for i in range(seats):
        for j in range(i + 1, seats):
            rounds[divergence.round_of(i, j, seats)] += [i, j]
            assert divergence.host(i, j) == divergence.host(j, i)
            hosts[divergence.host(i, j)] += 1
    assert len(rounds) <= seats - 1 + seats % 2
    assert all(len(set(r)) == len(r) for r in rounds.values())
    assert not hosts or max(hosts.values()) - min(hosts[i] for i in range(seats)) <= 1


@pytest.mark.parametrize("seats", [1, 2, 5, 8])
def test_journeys_follow_the_schedule(spark, seats):
    df = spark.range(seats).selectExpr("id AS seat").selectExpr("seat", f"CAST({seats} AS bigint) AS seats")
    got = {(r["seat"], s["host"], s["round"]) for r in df.select("seat", divergence._journeys().alias("s")).collect() for s in r["s"]}
    want = {(i, i, -1) for i in range(seats)}
    for i in range(seats):
        for j in range(seats):
            if i != j and divergence.host(i, j) == j:
                want.add((i, j, divergence.round_of(i, j, seats)))
    assert got == want


def test_vectors_and_large_counts():
    for ids, counts in (([], []), ([0], [1]), ([3, 4, 900, 70_000], [1, 300, 70_000, 1 << 40])):
        a, b = divergence.unpacked(divergence.packed(np.array(ids, np.int64), np.array(counts, np.int64)))
        assert a.tolist() == ids and b.tolist() == counts
    big = np.array([0, 5, 10**13], np.int64)
    assert divergence.scaled(big, 10**14).tolist() == [1 + 10**9 * (c + 1) // 10**14 for c in big.tolist()]
