"""Language spans and license scans against plain versions that follow the definitions word by word."""
import re

import numpy as np
import pytest

pytest.importorskip("helixspan.llm")
from helixspan.llm import langid, licenses  # noqa: E402


def plain_viterbi(scores, penalty):
    """The best path by trying every language before each word; ties stay, then go to the first language."""
    n, langs = scores.shape
    best, came = scores[0].copy(), []
    for t in range(1, n):
        now, back = np.empty(langs, np.float32), []
        for k in range(langs):
            options = [best[j] - (0 if j == k else np.float32(penalty)) for j in range(langs)]
            top = max(options)
            j = k if options[k] == top else options.index(top)
            now[k] = options[j] + scores[t][k]
            back.append(j)
        came.append(back)
        best = now
    k = int(best.argmax())
    path = [k]
    for back in reversed(came):
        path.append(k := back[k])
    return path[::-1], float(best.max())


def total(scores, path, penalty):
    return sum(float(scores[t][k]) for t, k in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


@pytest.mark.parametrize("seed", range(6))
def test_viterbi(seed):
    rng = np.random.default_rng(seed)
    model = langid.Model(["a", "b", "c"][: 1 + seed % 3], np.ones((1 + seed % 3, langid.BUCKETS)), [{"latin": 9}] * (1 + seed % 3))
    texts = [(rng.normal(size=(int(n), len(model.langs))) * 4).astype(np.float32) for n in rng.integers(1, 40, 25)]
    for penalty in (0.0, 1.5, 6.0):
        for s, path in zip(texts, model.label(texts, penalty)):
            want, most = plain_viterbi(s, penalty)
            assert abs(total(s, path.tolist(), penalty) - most) < 1e-3 and abs(total(s, want, penalty) - most) < 1e-3


def test_scores_scripts_and_prediction():
    """A word's scores by loops over its grams; scripts leave only languages that use them; the prediction by its definition."""
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 50, (3, langid.BUCKETS)).astype(float)
    model = langid.Model(["de", "en", "el"], counts, [{"latin": 90}, {"latin": 80, "greek": 0}, {"greek": 70, "latin": 30}])
    words = ["the", "straße", "λόγος", "a", "naïve", "zzz"]
    logs = np.log((counts + 0.3) / (counts.sum(1, keepdims=True) + 0.3 * langid.BUCKETS))
    for w, got in zip(words, model.word_scores(words)):
        ids, owner = langid.gram_ids([w])
        assert len(ids) == sum(max(0, len(w) + 2 - n + 1) for n in (1, 2, 3)) + 1 and set(owner.tolist()) == {0}
        want = [min(6.0, 1 + 0.5 * len(w)) * float(np.mean([logs[k, i] for i in ids])) for k in range(3)]
        if langid.script_of(w[0]) == "greek":
            want[0] -= 50
            want[1] -= 50
        assert np.allclose(got, want, atol=1e-3)
    text = "the naïve λόγος, the the straße λόγος a"
    s = model.lookup([langid.words_in(text)])[0]
    path, _ = plain_viterbi(s, langid.PENALTY)
    letters = [len(w) for w in langid.words_in(text)]
    mass = [sum(n for n, k in zip(letters, path) if k == lang) for lang in range(3)]
    top = mass.index(max(mass))
    share = [float(np.exp(x[top]) / np.exp(x).sum()) for x in (row - row.max() for row, k in zip(s.astype(float), path) if k == top)]
    ((lang, score),) = model.predict([text])
    assert lang == model.langs[top] and abs(score - mass[top] / sum(mass) * np.mean(share)) < 1e-3


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_scan(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = []
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_license_scan_against_all_places():
    rng = np.random.default_rng(7)
    bits = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "x", "CC", "By", "ÀLL", "gnu", "7", "é", "license1", "mit"]
    gaps = [" ", "  ", "-", ".\n", "\t", "/", "", "_", "\x00", "ß"]
    machine = licenses.build_automaton(dict(licenses.BASE_PHRASES), dict(licenses.NOTICE_PHRASES))
    found = 0
    for i in range(3000):
        text = "".join(str(rng.choice(bits)) + str(rng.choice(gaps, p=[0.6] + [0.4 / 9] * 9)) for _ in range(int(rng.integers(0, 40))))
        got = licenses.scan_text(machine, text)
        assert got[:5] == plain_scan(text), text
        labels = set(got[5].split(",")) - {""}
        assert set(got[4].split(",")) - {""} <= labels and 0 <= got[7] <= 1
        assert ("mit" in labels) == (" mit license " in f" {' '.join(WORD.findall(text.translate(LOWER)))} ")
        found += got[1]
    assert found > 500


def truth(expression, allowed):
    """A licence expression's value by Python's own grammar, for expressions without with."""
    code = re.sub(r"[A-Za-z0-9.\-]+", lambda m: m[0] if m[0] in ("and", "or") else str(m[0].lower() in allowed), expression)
    return eval(code)  # noqa: S307 - made of True, False, and, or and brackets alone


def test_license_expressions():
    rng = np.random.default_rng(5)
    names = ["mit", "isc", "gpl-3.0", "zlib", "agpl-3.0"]

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            return str(rng.choice(names))
        inner = f"{made(depth - 1)} {rng.choice(['and', 'or'])} {made(depth - 1)}"
        return f"({inner})" if rng.random() < 0.5 else inner

    for _ in range(500):
        text = made(4)
        postfix = licenses.parse_expression(text)
        assert licenses.evaluate(postfix, {"mit", "isc"}) == truth(text, {"mit", "isc"})
        assert licenses.identifiers(postfix) == set(re.findall(r"[a-z][a-z0-9.\-]+", text)) - {"and", "or"}
