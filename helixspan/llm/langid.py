"""Language of mixed texts: script ranges narrow candidates, Viterbi labels spans of words.

Training: character n-grams (1 to 3, with word borders) and whole words of a bounded sample of
labelled documents are hashed into a table of log likelihoods by language; a script counts as a
language's own if it makes up at least SCRIPT_SHARE of its letters. The sample has about
SAMPLE_PER_LANG documents of each language (all of them where there are fewer), picked by a
hash of doc_id; the bound is the parameter per_lang.

Prediction: a word's script leaves only the languages that use it; each gets the mean log
likelihood of the word's n-grams, times a weight that grows with the word's length. Viterbi
with a switching penalty then finds the best sequence of languages over the words of the text;
runs of one language are the spans. The text's language is that with most letters in its spans,
ties to the smaller name; the score is its share of the letters of all words, times its mean
posterior over those words.

A word is a run of letters (of Unicode's categories L) with the combining marks that follow them;
numerals, superscripts and the like are no letters.

Defined cases: null text, or text without letters, is `und` with score 0. With no labelled rows
at all, every text is `und`; an empty table has no rows. Very long texts take time and memory in
proportion to their words. Columns of other names, or names that differ only by case, fall away. lang, source and doc_id are never inputs of a prediction. Repeated
rows give repeated results.
"""
from __future__ import annotations

import math
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, by_place, column_place, doc_columns, map_rows, released

BUCKETS = 1 << 16
SAMPLE_PER_LANG = 1500
PENALTY = 6.0
SCRIPT_SHARE = 0.01
CACHE_WORDS = 120_000
PIECE = 512
UNKNOWN = "und"

# First and last code point of the main blocks of scripts.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF),
    ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF),
    ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)


def script_of(ch: str) -> str:
    c = ord(ch)
    for name, lo, hi in SCRIPTS:
        if lo <= c <= hi:
            return name
    return "other"


# Runs of letters; scripts that are written without spaces go by letter runs too.
_ASCII = re.compile(r"[A-Za-z]+")


@cache
def _letters():
    import regex

    return regex.compile(r"\p{L}[\p{L}\p{M}]*")


def word_pattern(text: str):
    return _ASCII if text.isascii() else _letters()


def words_in(text: str) -> list[str]:
    return word_pattern(text).findall(text.lower())


def gram_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and word number of every feature of the words: 1- to 3-grams with borders, and the words themselves."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    code = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    ids, owners, h = [], [], np.zeros(len(code), np.uint64)
    for n in (1, 2, 3):
        m = len(code) - n + 1
        if m <= 0:
            break
        h = (h[:m] + code[n - 1 :]) * _ODD
        whole = owner[:m] == owner[n - 1 :]
        ids.append(h[whole] >> _SHIFT)
        owners.append(owner[:m][whole])
    ids.append(np.fromiter((zlib.crc32(w.encode()) % BUCKETS for w in words), np.uint64, len(words)))
    owners.append(np.arange(len(words)))
    return np.concatenate(ids).astype(np.int64), np.concatenate(owners)


_ODD, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(48)  # the top 16 bits: BUCKETS


class _Rows(dict):
    """Row number by word; new words get the next number and are noted."""

    def __init__(self):
        super().__init__()
        self.todo: list[str] = []

    def __missing__(self, word: str) -> int:
        self.todo.append(word)
        i = self[word] = len(self)
        return i


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, scripts: list[dict[str, int]]):
        """counts: [language, bucket]; scripts: letters by script for each language."""
        self.langs = langs
        totals = counts.sum(1, keepdims=True)
        self.table = np.log((counts + 0.3) / (totals + 0.3 * BUCKETS)).T.astype(np.float32).copy()  # [bucket, language]
        self.scripts = [
            {s for s, n in own.items() if n >= SCRIPT_SHARE * max(1, sum(own.values()))} for own in scripts
        ]
        self.reset()

    def __getstate__(self):
        return {"langs": self.langs, "table": self.table, "scripts": self.scripts}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.reset()

    def reset(self) -> None:
        self.rows = _Rows()
        self.scores = np.zeros((1024, len(self.langs)), np.float32)

    def word_scores(self, words: list[str]) -> np.ndarray:
        ids, owner = gram_ids(words)
        number = np.bincount(owner, minlength=len(words))
        weight = np.minimum(6.0, 1.0 + 0.5 * np.fromiter(map(len, words), np.int64, len(words))) / number
        columns = [np.bincount(owner, weights=self.table[ids, k], minlength=len(words)) for k in range(len(self.langs))]
        out = np.stack(columns, 1) * weight[:, None]
        kinds = [script_of(w[0]) for w in words]
        for kind in set(kinds):
            own = np.array([kind in s for s in self.scripts])
            if own.any() and not own.all():
                out[np.ix_(np.array([k == kind for k in kinds]), ~own)] -= 50.0
        return out

    def lookup(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Scores [word, language] of each text's words."""
        get = self.rows.__getitem__
        rows = [np.fromiter(map(get, words), np.int64, len(words)) for words in texts]
        if new := self.rows.todo:
            while len(self.rows) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[len(self.rows) - len(new) : len(self.rows)] = self.word_scores(new)
            new.clear()
        return [self.scores[r] for r in rows]

    def label(self, scores: list[np.ndarray], penalty: float = PENALTY) -> list[np.ndarray]:
        """Viterbi paths for many texts at once: step t handles the t-th word of every text that has one."""
        sizes = np.array([len(s) for s in scores])
        order = np.argsort(-sizes, kind="stable")
        langs, n = len(self.langs), int(sizes.max(initial=0))
        live = np.searchsorted(-sizes[order], -np.arange(n), side="left")  # texts longer than t
        starts = np.concatenate([[0], np.cumsum(live)])
        flat = np.empty((starts[-1], langs), np.float32)
        for k, i in enumerate(order):
            if sizes[i]:
                flat[starts[: sizes[i]] + k] = scores[i]
        stay = np.empty((starts[-1], langs), bool)
        came = np.empty(starts[-1], np.int16)
        best = np.zeros((len(scores), langs), np.float32)
        ends = np.zeros(len(scores), np.int16)
        for t in range(n):
            a, b = starts[t], starts[t + 1]
            m = b - a
            prev = best[:m]
            if t:
                top = prev.argmax(1)
                most = prev.max(1)[:, None] - penalty
                stay[a:b] = prev >= most
                came[a:b] = top
                np.maximum(prev, most, out=prev)
            prev += flat[a:b]
        at = best.argmax(1).astype(np.int16)
        out = [np.empty(s, np.int16) for s in sizes[order]]
        labels = np.empty(starts[-1], np.int16)
        for t in range(n - 1, -1, -1):
            a, b = starts[t], starts[t + 1]
            m = b - a
            labels[a:b] = at[:m]
            if t:
                kept = stay[a:b][np.arange(m), at[:m]]
                at[:m] = np.where(kept, at[:m], came[a:b])
        result: list = [None] * len(scores)
        for k, i in enumerate(order):
            result[i] = labels[starts[: sizes[i]] + k]
        return result

    def spans(self, text: str, penalty: float = PENALTY) -> list[tuple[int, int, str]]:
        """(first character, end, language) of each run of words with one language."""
        found = list(word_pattern(text).finditer(text))
        if not found or not self.langs:
            return []
        (path,) = self.label(self.lookup([[m[0].lower() for m in found]]), penalty)
        out: list[list] = []
        for m, k in zip(found, path.tolist()):
            if out and out[-1][2] == k:
                out[-1][1] = m.end()
            else:
                out.append([m.start(), m.end(), k])
        return [(a, b, self.langs[k]) for a, b, k in out]

    def predict(self, texts: list[str | None], penalty: float = PENALTY) -> list[tuple[str, float]]:
        if len(self.rows) > CACHE_WORDS:
            self.reset()
        words = [words_in(t) if t else [] for t in texts]
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        scores = self.lookup(words)
        out = []
        for w, s, path in zip(words, scores, self.label(scores, penalty)):
            if not w:
                out.append((UNKNOWN, 0.0))
                continue
            letters = np.fromiter(map(len, w), np.int64, len(w))
            mass = np.bincount(path, weights=letters, minlength=len(self.langs))
            k = int(mass.argmax())
            own = s[path == k]
            shifted = np.exp(own - own.max(1, keepdims=True))
            posterior = float((shifted[:, k] / shifted.sum(1)).mean())
            out.append((self.langs[k], float(mass[k] / mass.sum()) * posterior))
        return out


def held_out(doc_id="doc_id"):
    """Documents that training never sees: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Fits the model on a bounded sample of the labelled documents that aren't held out."""
    spark = docs.sparkSession
    rows = doc_columns(docs, "doc_id", "text", "lang").filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, BUCKETS)), [])
    million = 1_000_000
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(math.ceil(min(1.0, per_lang / sizes[k]) * million)))])
    picked = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(million)) < share[F.col("lang")])
    ddl = "lang string, counts binary, scripts map<string,bigint>"
    target = arrow_schema(spark, ddl)

    def count(batches):
        counts: dict = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table, scripts, known = counts.setdefault(lang, (np.zeros(BUCKETS, np.int64), {}, {}))
                for w in words_in(text):
                    known[w] = known.get(w, 0) + 1
        for lang, (table, scripts, known) in counts.items():
            if known:
                ids, owner = gram_ids(list(known))
                table += np.bincount(ids, weights=np.fromiter(known.values(), float)[owner], minlength=BUCKETS).astype(np.int64)
            for w, n in known.items():
                s = script_of(w[0])
                scripts[s] = scripts.get(s, 0) + n * len(w)
            cols = [[lang], [table.tobytes()], [list(scripts.items())]]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, target)], schema=target)

    parts = picked.select("text", "lang").repartition(12).mapInArrow(count, ddl).collect()  # 12 tables a language at most
    counts, scripts = np.zeros((len(langs), BUCKETS), np.int64), [{} for _ in langs]
    for r in parts:
        i = langs.index(r["lang"])
        counts[i] += np.frombuffer(r["counts"], np.int64)
        for s, n in r["scripts"].items():
            scripts[i][s] = scripts[i].get(s, 0) + n
    return Model(langs, counts, scripts)


SCHEMA = "doc_id bigint, lang_pred string, score double"



def predict(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(c):
        done = shared.value.predict(c["text"].to_pylist(), penalty)
        return {"doc_id": c["doc_id"], "lang_pred": [a for a, _ in done], "score": [b for _, b in done]}

    return map_rows(doc_columns(docs, "doc_id", "text"), run, SCHEMA, PIECE)


def keep_known(docs: DataFrame, model: Model, least: float = 0.05, penalty: float = PENALTY) -> DataFrame:
    """The rows of docs whose text has a language with at least the given score; all columns as they are.

    Null texts, texts without letters and, where nothing was learnt, all texts go; repeated rows
    stay or go together; columns may differ from `text` only by case; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, own = column_place(docs, "text"), by_place(docs)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, PIECE):
                piece = batch.slice(i, PIECE)
                done = shared.value.predict(piece.column(at).to_pylist(), penalty)
                yield piece.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in done], pa.bool_()))
        shared.value.reset()  # the next stage has other uses for the words' room

    return own.mapInArrow(released(run), own.schema).toDF(*docs.columns)
