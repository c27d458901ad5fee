"""Fill-in-middle against a plain version that walks over characters."""
import hashlib

import pytest

pytest.importorskip("helixspan.llm")
from helixspan.llm import fim  # noqa: E402

SCHEMA = "doc_id bigint, text string, Text string, n bigint, form string, e string"
TEXTS = [None, "", "a", "ab cd", "  ", "é漢b\n\t12ab", "has <P> inside", "<S>", "x<M", "<<<S", "end <", "S>", "a" * 70_000, "word, " * 20_000, "A\x00B", "😀😀 smile"]


def units(text):
    out = []
    for c in text:
        letter = c.isascii() and c.isalpha()
        if letter and out and out[-1][0].isascii() and out[-1][0].isalpha():
            out[-1] += c
        else:
            out.append(c)
    return out


def plainly(doc_id, text):
    text = text or ""
    u = units(text)
    digest = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(u), "plain", None, None, sha(text), sha(text)
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    spm = h[3] % 100 < 20
    return doc_id, len(u), "spm" if spm else "psm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"), sha(text)


def rows():
    return [(i * 1_000_003 - 7, t, "other", 1, "f", "e") for i, t in enumerate(TEXTS * 6)]


def test_digests(spark):
    some = [*rows(), rows()[3], (None, "no id here", None, None, None, None), (5, "one id", None, None, None, None), (5, "two texts", None, None, None, None)]
    df = spark.createDataFrame([(r[0], r[1], *r[3:]) for r in some], "doc_id bigint, text string, n bigint, form string, e string").repartition(3)
    got = sorted(map(tuple, fim.digests(df).collect()), key=str)
    assert got == sorted((plainly(r[0], r[1]) for r in some), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_names_that_differ_by_case(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = spark.createDataFrame(rows()[:6], SCHEMA)
        assert [r["n"] for r in fim.digests(df).orderBy("doc_id").collect()] == [len(units(t or "")) for t in TEXTS[:6]]
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_examples_give_the_text_back(spark):
    df = spark.createDataFrame([(r[0], r[1]) for r in rows()], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in fim.examples(df).collect()}
    for doc_id, text, *_ in rows():
        e = got[doc_id]
        assert fim.restore(e["output"], e["form"]) == (text or "")
        if e["form"] != "plain":
            assert e["prefix"] + e["middle"] + e["suffix"] == text


def test_shares_and_empty_table(spark):
    df = spark.createDataFrame([(i, "some words here") for i in range(300)], "doc_id bigint, text string")
    assert {r["form"] for r in fim.examples(df, fim_share=0).collect()} == {"plain"}
    assert {r["form"] for r in fim.examples(df, fim_share=100, spm_share=100).collect()} == {"spm"}
    assert fim.digests(df.limit(0)).collect() == []


@pytest.mark.parametrize("text", ["<", "<P", "a<S", "<M<", ">S>"])
def test_slices_that_end_like_a_marker(text):
    for i in range(200):
        _, form, *_, output = fim.example(i, text * 3 if "<P>" not in text * 3 else text)
        assert fim.restore(output, form) in (text * 3, text)
