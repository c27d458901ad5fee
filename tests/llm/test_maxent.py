"""The language model: exact base scores, probabilities that add up to 1, scores against a plain version."""
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("helixspan.llm")
from pyspark.sql import functions as F  # noqa: E402

from helixspan.llm import maxent  # noqa: E402

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id bigint, text string, TEXT2 string, lang string, score double, row bigint, c bigint, word string"


def tokens(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [*WORD.findall((text or "").translate(lower)), "\n"]


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    names = [f"w{i}" for i in range(150)]
    out = []
    for i in range(160):
        at, words = int(rng.integers(150)), []
        for _ in range(int(rng.integers(0, 60))):
            at = (at * 3 + int(rng.integers(4))) % 150  # few words may follow a word
            words.append(names[at])
        out.append((i, " ".join(words)))
    out += [(500, None), (501, ""), (502, " \t\n\x0b"), (503, "Only-Here É\x85é x　y"), (504, "w1 " * 9000 + "seldom"), (505, "ÀÉ W1 w1"), (505, "twice"), (505, "twice"), (None, "no id"), (506, "x" * 5000)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "o", "l", 1.0, 2, 3, "w") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def scored(spark, rows):
    kept = {}
    train = maxent.train

    def noted(*args):
        kept["model"] = train(*args)
        return kept["model"]

    maxent.train = noted
    try:
        got = maxent.score(frame(spark, rows), 60, 2).collect()
    finally:
        maxent.train = train
    return got, kept["model"]


def test_base_scores(rows, scored):
    train = [t for i, x in rows if not is_held_out(i) for t in tokens(x)]
    c, n = Counter(train), len(train)
    want = []
    for i, x in rows:
        t = tokens(x)
        base = math.fsum(math.log10((c[w] + 0.5) / (n + 0.5 * (len(c) + 1))) for w in t)
        want.append((str(i), is_held_out(i), len(t), sum(c[w] > 0 for w in t), n, round(base, 6)))
    got, model = scored
    assert sorted((str(r[0]), *r[1:5], round(r["base_score"], 6)) for r in got) == sorted(want)
    assert {w.decode(): int(k) for w, k in zip(model.words, model.counts)} == {w: k for w, k in c.items() if k >= min(model.counts)}
    assert len(model.words) <= 60 and min(model.counts) >= maxent.COMMON_FROM
    assert (model.total, model.distinct) == (n, len(c))


def plain_probability(model, counts, before, word):
    """log10 of P(word | before) with one loop for each step of the definition; before holds two words, None for none."""
    ids = {w: i for i, w in enumerate(model.words)}
    pad = len(ids) + (1 << maxent.OTHER_BITS)
    number = lambda w: pad if w is None else ids.get(w, len(ids) + (zlib.crc32(w) & ((1 << maxent.OTHER_BITS) - 1)))
    history = np.array([*map(number, before), 0])
    hashes = maxent.history(history, np.array([2]))
    leaf = int(model.leaf[ids[word]]) if word in ids else model.last
    group = leaf // maxent.CLASSES
    out = 0.0
    for k, (bias, pick) in enumerate(((0, group), (group, leaf % maxent.CLASSES))):
        z = [float(x) for x in model.tables[k][bias]]
        for r in maxent.feature_rows(hashes, k, np.array([group])):
            z = [a + float(b) for a, b in zip(z, model.tables[k][maxent.BIASES[k] + int(r[0])])]
        top = max(z)
        out += z[pick] - top - math.log(math.fsum(math.exp(a - top) for a in z))
    out /= math.log(10)
    if word in ids:
        return out + math.log10(model.counts[ids[word]] / model.mass[leaf])
    return out + math.log10((counts[word.decode()] + 0.5) / model.rare_total)


def test_scores(rows, scored):
    got, model = scored
    c = Counter(t for i, x in rows if not is_held_out(i) for t in tokens(x))
    by_text = {(str(i), x) for i, x in rows}
    want = []
    for i, x in by_text:
        t = [None, None, *(w.encode() for w in tokens(x))]
        if len(t) < 500:
            want.append((i, math.fsum(plain_probability(model, c, t[k - 2 : k], t[k]) for k in range(2, len(t)))))
    have = {(str(r["doc_id"]), round(r["score"], 2)) for r in got if r["n_tokens"] < 498}
    assert all(any(i == j and abs(a - b) < 0.02 + 1e-4 * abs(a) for j, b in have) for i, a in want)


def test_probabilities_add_up_to_one(rows, scored):
    _, model = scored
    c = Counter(t for i, x in rows if not is_held_out(i) for t in tokens(x))
    words = [*(w.encode() for w in c), b"never-seen"]
    for before in ([None] * 2, [b"w3", b"w9"], [None, b"never"], [b"w1", b"w1"]):
        assert abs(math.fsum(10 ** plain_probability(model, c, before, w) for w in words) - 1) < 1e-4


def test_training_lowers_the_loss_of_texts_it_has_not_seen(spark):
    rng = np.random.default_rng(2)
    texts = []
    for i in range(1500):
        at, words = int(rng.integers(150)), []
        for _ in range(40):
            at = (at * 3 + int(rng.integers(3))) % 150
            words.append(f"w{at}")
        texts.append((i, " ".join(words)))
    got = maxent.score(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(2)).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] / got[2] > got[1] / got[2] + 0.5  # three of 150 words may follow: the bound is log10(50) = 1.7


def test_only_held_out_rows_and_empty_table(spark, rows):
    some = [(i, "a b a") for i in range(60) if is_held_out(i)]
    got = maxent.score(frame(spark, some)).collect()
    assert len(got) == len(some) and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["n_tokens"] == 4 for r in got)
    assert all(abs(r["base_score"]) < 1e-9 and math.isfinite(r["score"]) and r["score"] <= 1e-6 for r in got)
    assert maxent.score(frame(spark, rows).limit(0)).collect() == []


def test_classes_have_about_equal_mass():
    rng = np.random.default_rng(4)
    counts = np.sort(rng.zipf(1.3, 5000).clip(max=10**6))[::-1].astype(np.int64)
    leaf = maxent.classes_of(counts, rng.integers(0, 9, 5000), int(counts.sum()), 255)
    mass = np.bincount(leaf, counts, 255)
    assert leaf.max() == 254 and (mass > 0).all()
    alone = np.bincount(leaf)[leaf[counts > counts.sum() / 100]]
    assert (alone <= 2).all()
    assert maxent.classes_of(np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 255).tolist() == []


def test_histories_of_texts_in_one_batch_and_in_many(scored):
    """A text's positions see the text's own words only, wherever batches begin."""
    _, model = scored
    reader = maxent.Reader(model)
    for size in (1, 3, 1000):
        seen = []
        for ids, at, leaf in maxent.batches_of(reader, model.last, ["w1 w2 w3", None, "w4 unknown w1"], size):
            assert (reader.classes(ids[at], model.last) == leaf).all()
            seen += [tuple(ids[k - 2 : k + 1]) for k in at.tolist()]
        alone = []
        for text in ("w1 w2 w3", None, "w4 unknown w1"):
            ids, _ = reader.read(text)
            alone += [tuple(ids[k - 2 : k + 1]) for k in range(2, len(ids))]
        assert seen == alone


@pytest.fixture(scope="module")
def crowded(spark):
    """Far more words than classes; the next word is a function of the one before, but for noise."""
    rng = np.random.default_rng(5)
    texts = []
    for i in range(1200):
        at, words = int(rng.integers(1500)), []
        for _ in range(60):
            at = (at * 7 + int(rng.integers(2))) % 1500
            words.append(f"w{at}")
        texts.append((i, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(2)
    training = docs.where(~maxent.held_out())
    return texts, maxent.train(training, maxent.word_counts(training).cache()), docs


def plain_way(model, i, before):
    """log10 of P(word i | its class, before): the softmaxes on its way, one loop for each step; None stands before a text."""
    ids = {w: k for k, w in enumerate(model.words)}
    hashes = maxent.history(np.array([*(len(ids) + (1 << maxent.OTHER_BITS) if w is None else ids[w] for w in before), 0]), np.array([2]))
    out, table = 0.0, model.tables[2]
    for s in range(int(model.first[i]), int(model.first[i + 1])):
        cut = int(model.cuts[s])
        z = [float(a) for a in table[cut]]
        for r in maxent.feature_rows(hashes, 2, np.array([cut])):
            z = [a + float(b) for a, b in zip(z, table[model.biases[2] + int(r[0])])]
        top = max(z)
        out += z[int(model.turns[s])] - top - math.log(math.fsum(math.exp(a - top) for a in z))
    return out / math.log(10)


def test_words_of_a_class_depend_on_the_history(crowded):
    texts, model, docs = crowded
    sizes = np.bincount(model.leaf)
    assert sizes.max() > 3
    for leaf in np.argsort(sizes)[-3:]:
        own = np.flatnonzero(model.leaf == leaf)
        a, b = own[:2].tolist()
        # The word that stands before a: times 7, it is a.
        before_a, before_b = ([b"w1", f"w{int(model.words[i][1:]) * pow(7, -1, 1500) % 1500}".encode()] for i in (a, b))
        after_a, after_b = ([10 ** plain_way(model, int(i), before) for i in own] for before in (before_a, before_b))
        assert abs(math.fsum(after_a) - 1) < 1e-4 and abs(math.fsum(after_b) - 1) < 1e-4
        assert after_a[0] > 2 * after_b[0] and after_b[1] > 2 * after_a[1]


def test_scores_hold_the_word_given_its_class_and_history(crowded):
    texts, model, docs = crowded
    got = {r["doc_id"]: r["path"] for r in maxent.score_rows(docs.withColumn("held_out", maxent.held_out()), model).where("doc_id < 12").collect()}
    ids = {w: k for k, w in enumerate(model.words)}
    for i, x in texts[:12]:
        t = [None, None, *(w.encode() for w in tokens(x))]
        assert all(w in ids for w in t[2:])
        plain = 0.0
        for k in range(2, len(t)):
            j = ids[t[k]]
            share = math.log10(model.counts[j] / model.mass[model.leaf[j]])  # what plain_probability takes for a word in its class
            plain += plain_probability(model, {}, t[k - 2 : k], t[k]) - share + plain_way(model, j, t[k - 2 : k])
        assert abs(got[i] - plain) < 0.02 + 1e-4 * abs(plain)


def test_ways_lead_to_single_words_by_their_shares():
    rng = np.random.default_rng(6)
    counts = rng.zipf(1.3, 4000).clip(max=10**6).astype(np.int64)
    leaf = rng.integers(0, 40, 4000)
    leaf[:5] = 50 + np.arange(5)  # classes of one word
    first, cuts, turns, bias = maxent.ways_of(counts, leaf)
    ways = [tuple(zip(cuts[a:b].tolist(), turns[a:b].tolist())) for a, b in zip(first[:-2], first[1:-1])]
    assert all(w == () for w in ways[:5]) and len(set(ways[5:])) == len(ways) - 5 and max(map(len, ways)) <= 8
    share = np.array([math.exp(math.fsum(bias[c, t] for c, t in w)) for w in ways])
    assert np.allclose(share, counts / np.bincount(leaf, counts)[leaf])
    assert [len(x) for x in maxent.ways_of(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [2, 0, 0, 0]


def test_a_step_sums_the_slopes_of_each_row(crowded):
    """Rows of one position and of many, against one loop for each of them."""
    _, model, _ = crowded
    rng = np.random.default_rng(7)
    trainer = maxent.Trainer(model)
    for k, width in enumerate(maxent.WIDTHS):
        base = model.biases[k]
        for rows in (np.append(rng.integers(0, 90, 300), [7] * 200), np.arange(50), np.array([3]), np.full(20, 4)):
            rows, slopes = rows.astype(np.uint16), rng.normal(size=(len(rows), width)).astype(np.float32)
            table, square, touched = trainer.tables[k].copy(), trainer.squares[k].copy(), trainer.touched[k].copy()
            for r in set(rows.tolist()):
                slope = slopes[rows == r].astype(np.float64).sum(0)
                square[base + r] += (slope**2).sum()
                touched[base + r] += (rows == r).sum()
                table[base + r] = np.clip(table[base + r] - maxent.RATE / math.sqrt(square[base + r]) * slope, -maxent.MOST, maxent.MOST)
            trainer._down(k, base, rows, slopes)
            assert np.allclose(trainer.tables[k], table, atol=1e-4) and np.allclose(trainer.squares[k], square, rtol=1e-4) and (trainer.touched[k] == touched).all()


def test_steps_take_no_fresh_memory_for_their_slopes(crowded):
    """Blocks of a line for each position are used again: fresh ones in each step took longer than its sums."""
    _, model, _ = crowded
    trainer, rng = maxent.Trainer(model), np.random.default_rng(8)
    rows, slopes = rng.integers(0, 1 << 15, maxent.BATCH).astype(np.uint16), rng.normal(size=(maxent.BATCH, maxent.GROUPS)).astype(np.float32)
    trainer._down(0, 1, rows, slopes)
    tracemalloc.start()
    try:
        trainer._down(0, 1, rows, slopes)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 1.5 * slopes.nbytes


def test_steps_are_full_over_the_borders_of_texts(scored):
    _, model = scored
    sizes = [len(at) for _, at, _ in maxent.batches_of(maxent.Reader(model), model.last, [" ".join(["w1"] * (i % 7)) for i in range(100)], 10)]
    assert sizes[:-1] == [10] * (len(sizes) - 1) and sum(sizes) == sum(i % 7 + 1 for i in range(100))


@pytest.mark.parametrize("most", [1, 1 << 20])
def test_texts_read_together_are_as_read_alone(scored, rows, most, monkeypatch):
    _, model = scored
    monkeypatch.setattr(maxent, "READ_BYTES", most)
    kind = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))
    texts = [x for _, x in rows] + ["", " a  b\x0b\x0c\r\n\tÀÉ A ", "\x1cx\x85 y　z\x00\x1f q", "\x00 W\x00 ", None]
    for known in (model.words, []):  # without common words the end is none either
        ids, pad = {w: i for i, w in enumerate(known)}, len(known) + (1 << maxent.OTHER_BITS)
        reader, at = maxent.Reader(maxent.replace(model, words=known, leaf=model.leaf[: len(known)])), 0
        for piece in maxent.pieces(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])):
            got, sizes, own, others = reader.read_all(piece["text"])
            here = [[w.encode() for w in tokens(x)] for x in piece["text"].to_pylist()]
            assert here == [[w.encode() for w in tokens(x)] for x in texts[at : at + len(here)]]
            want = [[pad, pad, *(ids.get(w, len(known) + (zlib.crc32(w) & ((1 << maxent.OTHER_BITS) - 1))) for w in t)] for t in here]
            assert got.tolist() == [i for t in want for i in t] and sizes.tolist() == [len(t) for t in want]
            listed = maxent._listed(own, others, len(here), kind).to_pylist()
            assert [{p["word"].encode(): p["n"] for p in x} for x in listed] == [dict(Counter(w for w in t if w not in ids)) for t in here]
            at += len(here)
        assert at == len(texts)
