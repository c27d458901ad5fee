"""Language model scores: a hashed maximum-entropy model with a class-factored softmax.

Words are the runs of non-white characters of a text, with A-Z lower-cased, then one end.

P(word | history) = P(group | history) * P(class | group, history) * P(word | class, history). All
factors are softmaxes, whose logits are sums of rows of three hashed weight tables, a row for each
feature of the history: a bias, the word before, the two words before, and (in the first table) a
skip to the second word before. In the second table the features are crossed with the group. The
words of a class are cut into at most BRANCHES parts of about equal mass, and those again, down to
single words: the third factor is the product of the softmaxes over the parts on a word's way. Each cut has
a bias row in the third table, and its feature is the word before, crossed with the cut; classes of one
word need none.

Classes are cut from the common words (at most COMMON of them, so that they fit every task) in
the order of their company: a word belongs to the bucket of texts, by their most frequent word,
in which it occurs most. Frequent words are classes of their own. All other words, with one
place for all unseen ones, are the last class, in which a word has its share whatever the history;
their counts are joined by word, so the vocabulary is never gathered anywhere. The probabilities of all words and the unseen one add up to 1.

Training goes once over all training texts, in ROUNDS parts. In a part each task takes steps
from the common weights over its own texts (row-wise AdaGrad on the gradient of small batches) and
emits the change of each row it touched, in bytes with a scale for each row; rows are averaged over
the tasks that touched them, weighted by touches. There are TASKS_PER_CORE tasks for each of
the cluster's cores at most, so what travels is bounded by the cluster and not by the corpus, and
the merged tables have a fixed size.

Scoring computes the softmaxes for batches of positions at a time from gathered rows, however long a text is.

Defined cases: null text is the empty text, whose only token is the end; a null doc_id is a
training row; rows that repeat are separate texts of the training and are scored each; very long texts
are scored in batches like all others; without any training text every word is unseen; an empty table
has no rows; columns of other names, or names that differ only by case, fall away. Scores of
one text differ between runs as far as partitions change the order of training steps; base scores don't.
"""
from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass, field, replace
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, as_batch, doc_columns, drop_dir, released, stage

#: Key of a text's end among the words, none of which holds white space.
END = b"\n"

FOLDS, HELD_OUT = 5, 1
#: Pseudocount of every word and of the unseen one.
PSEUDO = 0.5

#: Most common words, which every task holds.
COMMON = 1 << 17
#: Occurrences that a common word has at least, so that the last class has words like those still unseen.
COMMON_FROM = 4
GROUPS = 16
CLASSES = 16  # of a group
BRANCHES = 16  # of a cut of a class
WIDTHS = (GROUPS, CLASSES, BRANCHES)
#: Rows of the weight tables for hashed features, as powers of two, 16 at most; bias rows stand before them.
ROW_BITS = (15, 16, 16)
#: Of the first two tables; the third has one for each cut.
BIASES = (1, GROUPS)
ROUNDS = 2
TASKS_PER_CORE = 4
RATE = 0.3
BATCH = 4096
#: Softmaxes computed together: most words of a batch have few cuts on their ways.
ROOM = 2 * BATCH
#: Bound of a hashed feature's weight, so that sums of logits have exponentials.
MOST = 12.0
#: Bytes of texts read together, or one text.
READ_BYTES = 1 << 20
#: Rows of a block of changes.
BLOCK_ROWS = 512
#: Buckets of texts by their most frequent word.
BUCKETS = 64
#: Words that a task counts before it passes them on.
HELD = 1 << 19
#: Hash values for words that aren't common, as parts of a history.
OTHER_BITS = 20

_COUNTS = "word string, n bigint, home bigint"
_CHANGES = "part int, block int, rows binary, weight binary, scale binary, change binary, square binary"
_SCORED = (
    "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_common bigint, base double, path double, "
    "rare array<struct<word: string, n: bigint>>"
)
#: Logit of what can't occur.
NO_SHARE = -1e30
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]
#: Words of a history; so many pads stand before a text.
PADS = 2


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()


def held_out(folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    """Whether a row is kept from the training."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


# --- words --------------------------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c, bucket: occurrences over all texts, ends among them, and the bucket of texts in which the word is at home."""
    target = arrow_schema(docs.sparkSession, _COUNTS)

    def run(batches):
        held: dict = defaultdict(Counter)
        size = 0

        def passed():
            total: Counter = Counter()
            home: dict = {}  # occurrences in a bucket, and the bucket, as one number
            for bucket, counter in held.items():
                total.update(counter)
                for w, n in counter.items():
                    n = n * BUCKETS + bucket
                    if n > home.get(w, 0):
                        home[w] = n
            words = list(total)
            columns = {"word": pa.array(words, pa.binary()), "n": pa.array(total.values(), pa.int64()), "home": pa.array(map(home.__getitem__, words), pa.int64())}
            for at in range(0, len(words), 1 << 16):
                yield as_batch({k: v.slice(at, 1 << 16) for k, v in columns.items()}, target)
            held.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                top = Counter(words).most_common(1)[0][0] if words else END  # of equals the first in the text
                words.append(END)
                counter = held[zlib.crc32(top) % BUCKETS]
                size -= len(counter)
                counter.update(words)
                size += len(counter)
                if size > HELD:
                    yield from passed()
                    size = 0
        yield from passed()

    counted = docs.select("text").mapInArrow(released(run), _COUNTS)
    return counted.groupBy("word").agg(F.sum("n").alias("c"), (F.max("home") % BUCKETS).cast("int").alias("bucket"))


def common_from(counts: DataFrame, most: int) -> int:
    """The least count of a common word, COMMON_FROM or more: words of at least that count are at most so many.

    It is found from a histogram of the counts' logarithms, of bounded size.
    """
    step = F.floor(F.log2(F.col("c")) * 16).cast("int")
    cells = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("c").alias("least")).collect()
    held, least = 0, 1 << 62
    for r in sorted(cells, key=lambda r: -r["step"]):
        held += r["words"]
        if held > most:
            break
        least = r["least"]
    return max(least, COMMON_FROM)


@dataclass
class Model:
    """What a task needs: common words with their classes, and the weight tables; its size doesn't grow with the corpus."""

    words: list[bytes]
    counts: np.ndarray
    leaf: np.ndarray  # class of each common word
    mass: np.ndarray  # occurrences of each class
    first: np.ndarray  # where each common word's way begins in cuts and turns; then twice where the last one's ends
    cuts: np.ndarray
    turns: np.ndarray  # the part taken at each cut of a way
    total: int  # all training tokens
    distinct: int  # all training words
    tables: list[np.ndarray]
    squares: list[np.ndarray]
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def last(self) -> int:
        """The class of all words that aren't common."""
        return GROUPS * CLASSES - 1

    @property
    def rare_total(self) -> float:
        """The denominator of a word's share in the last class."""
        return self.total - int(self.counts.sum()) + PSEUDO * (self.distinct - len(self.words) + 1)

    @property
    def biases(self) -> tuple[int, ...]:
        return *BIASES, len(self.tables[2]) - (1 << ROW_BITS[2])

    def base_total(self) -> float:
        return self.total + PSEUDO * (self.distinct + 1)


def classes_of(counts: np.ndarray, buckets: np.ndarray, total: int, classes: int) -> np.ndarray:
    """A class below classes for each word: words in the order of bucket and count fill classes of about equal mass.

    Buckets go by their mass. A class is closed when it has its share, so that frequent words are alone
    or nearly; what the first classes have beyond their share the later ones get less.
    """
    order = np.lexsort((-counts, buckets, -np.bincount(buckets, counts)[buckets] if len(counts) else counts))
    out = np.zeros(len(counts), np.int64)
    left, at, held = float(counts.sum()), 0, 0.0
    for k, i in enumerate(order):
        share = left / (classes - at)
        if held and at < classes - 1 and held + counts[i] / 2 > share:
            left -= held
            at, held = at + 1, 0.0
        out[i] = at
        held += counts[i]
    return out


def ways_of(counts: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, cuts, turns, bias rows of the cuts): each word's way from its class to itself; a bias row holds logarithms of shares."""
    words, owner = np.arange(len(counts)), leaf
    levels, bias = [], [np.zeros((0, BRANCHES))]
    made = 0
    while True:
        _, owner, size = np.unique(owner, return_inverse=True, return_counts=True)
        left = size[owner] > 1
        words, owner = words[left], owner[left]
        if not len(words):
            break
        order = np.lexsort((-counts[words], owner))
        words, (_, owner, size) = words[order], np.unique(owner[order], return_inverse=True, return_counts=True)
        n, begin = counts[words].astype(np.float64), np.cumsum(size) - size
        mass = np.bincount(owner, n)
        before = np.cumsum(n) - n
        middle = before - before[begin][owner] + n / 2
        place = np.arange(len(words)) - begin[owner]
        turn = np.where(size[owner] <= BRANCHES, place, np.minimum(middle * BRANCHES / mass[owner], BRANCHES - 1).astype(np.int64))
        slot = owner * BRANCHES + turn
        with np.errstate(divide="ignore"):
            share = np.log(np.bincount(slot, n, len(size) * BRANCHES).reshape(-1, BRANCHES) / mass[:, None])
        bias.append(np.maximum(share, NO_SHARE))
        levels.append((words, owner + made, turn))
        made, owner = made + len(size), slot
    words, cuts, turns = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*levels) if levels else ((), (), ())))
    order = np.argsort(words, kind="stable")
    ends = np.cumsum(np.bincount(words, minlength=len(counts)))
    first = np.concatenate([[0], ends, ends[-1:]]) if len(ends) else np.zeros(2, np.int64)
    return first.astype(np.int64), cuts[order].astype(np.int32), turns[order].astype(np.int8), np.concatenate(bias)


def vocabulary(counts: DataFrame, common: int) -> Model:
    """An untrained model of counted words; only the common ones come to the driver."""
    least = common_from(counts, common)
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    table = counts.where(F.col("c") >= least).toArrow()
    words = [w.encode("utf-8") for w in table["word"].to_pylist()]
    order = sorted(range(len(words)), key=words.__getitem__)
    words = [words[i] for i in order]
    n, bucket = (table[c].to_numpy().astype(np.int64)[order] if words else np.zeros(0, np.int64) for c in ("c", "bucket"))
    leaf = classes_of(n, bucket, total, GROUPS * CLASSES - 1)
    mass = np.bincount(leaf, n, GROUPS * CLASSES).astype(np.int64)
    mass[-1] = total - int(n.sum())
    first, cuts, turns, bias = ways_of(n, leaf)
    # A start at the classes' own frequencies: the bias rows hold their logarithms. Classes without words get no share.
    tables = [np.zeros((free + (1 << bits), width), np.float32) for free, bits, width in zip((*BIASES, len(bias)), ROW_BITS, WIDTHS)]
    used = np.append(np.bincount(leaf, minlength=GROUPS * CLASSES - 1) > 0, True)
    share = np.where(used, np.log((mass + PSEUDO) / (mass.sum() + PSEUDO * len(mass))), NO_SHARE).reshape(GROUPS, CLASSES)
    tables[0][0] = np.logaddexp.reduce(share, axis=1)
    tables[1][:GROUPS] = share
    tables[2][: len(bias)] = bias
    return Model(words, n, leaf, mass, first, cuts, turns, int(total), int(distinct), tables, [np.full(len(t), 1e-2, np.float32) for t in tables])


# --- histories ----------------------------------------------------------------------------------


class Reader:
    """Texts as ids: common words by their number, others by a hash beyond these, and a pad before each text."""

    def __init__(self, model: Model):
        self.words = pa.array(model.words, pa.binary()).cast(pa.string())
        self.common = len(model.words)
        self.pad = self.common + (1 << OTHER_BITS)
        self.leaf = np.append(model.leaf, 0)

    def read(self, text: str | None) -> tuple[np.ndarray, list[bytes]]:
        """(ids with pads before them, the words that aren't common)."""
        ids, _, _, others = self.read_all(pa.array([text], pa.string()))
        return ids, [w.encode("utf-8") for w in others.to_pylist()]

    def read_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.DictionaryArray]:
        """(ids of the texts one after the other, how many each has, with pads; the text of each word that isn't common, those words)."""
        parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
        words, own = parts.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy())
        kept = pc.not_equal(words, "")  # beside white space at a text's borders
        words, own = words.filter(kept), own[kept.to_numpy(zero_copy_only=False)]
        sizes = np.bincount(own, minlength=len(texts)) + PADS + 1
        place = np.concatenate([np.arange(len(own)) + own * (PADS + 1) + PADS, np.cumsum(sizes) - 1])
        words, own = pa.concat_arrays([words, pa.array([END.decode()] * len(texts), pa.string())]), np.append(own, np.arange(len(texts)))
        number = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        rare = number < 0
        others = words.filter(pa.array(rare)).dictionary_encode()
        hashed = [self.common + (zlib.crc32(w) & ((1 << OTHER_BITS) - 1)) for w in others.dictionary.cast(pa.binary()).to_pylist()]
        number[rare] = np.array(hashed, np.int64)[others.indices.to_numpy()]
        ids = np.full(int(sizes.sum()), self.pad)
        ids[place] = number
        return ids, sizes, own[rare], others

    def classes(self, ids: np.ndarray, last: int) -> np.ndarray:
        out = self.leaf[np.minimum(ids, self.common)]
        out[ids >= self.common] = last
        return out


def history(ids: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """A hash for each hashed feature of the history at these positions."""
    a, b = (ids[at - k].astype(np.uint64) + np.uint64(1) for k in (1, 2))
    with np.errstate(over="ignore"):
        return [a * np.uint64(_ODD[0]), b * np.uint64(_ODD[1]), (a * np.uint64(_ODD[2]) + b) * np.uint64(_ODD[0])]


def feature_rows(hashes: list[np.ndarray], k: int, group: np.ndarray) -> list[np.ndarray]:
    """Rows of table k, after its bias rows, for each hashed feature.

    The second table has no skips, and the group takes part; in the third it is the cut, with the word before alone.
    """
    shift = np.uint64(64 - ROW_BITS[k])
    with np.errstate(over="ignore"):
        if k:
            hashes = [hashes[0], hashes[2]] if k == 1 else hashes[:1]
            turn = (group.astype(np.uint64) + np.uint64(1)) * np.uint64(_ODD[3])
            hashes = [(h ^ turn) * np.uint64(_ODD[1]) for h in hashes]
        return [(h >> shift).astype(np.uint16) for h in hashes]


def choices(model: Model, ids: np.ndarray, at: np.ndarray, leaf: np.ndarray):
    """(table, feature rows, owner, choice, position) of all softmaxes on the words' ways, for ROOM positions or cuts at most.

    The owner, which has a bias row, is the group or the cut; position is the place in at.
    """
    hashes, group, every = history(ids, at), leaf // CLASSES, np.arange(len(at))
    for k, want in enumerate((group, leaf % CLASSES)):
        yield k, feature_rows(hashes, k, group), group, want, every
    words = np.minimum(ids[at], len(model.words))
    start = model.first[words]
    size = model.first[words + 1] - start
    own = np.repeat(every, size)
    step = np.arange(len(own)) + np.repeat(start - (np.cumsum(size) - size), size)
    for i in range(0, len(own), ROOM):
        here, there = own[i : i + ROOM], step[i : i + ROOM]
        cut = model.cuts[there]
        yield 2, feature_rows([hashes[0][here]], 2, cut), cut, model.turns[there], here


class Softmax:
    """Exponentials of the logits at some positions and their sums, in buffers that are used again."""

    def __init__(self, width: int):
        self.z, self.e, self.ones = np.empty((ROOM, width), np.float32), np.empty((ROOM, width), np.float32), np.ones(width, np.float32)

    def of(self, table: np.ndarray, free: int, rows: list[np.ndarray], group: np.ndarray):
        """(logits, exponentials, sums)."""
        n = len(group)
        z, e, body = self.z[:n], self.e[:n], table[free:]
        np.take(body, rows[0], axis=0, out=z, mode="clip")
        for r in rows[1:]:
            np.take(body, r, axis=0, out=e, mode="clip")
            z += e
        if free == 1:
            z += table[0]
        else:
            np.take(table, group, axis=0, out=e, mode="clip")
            z += e
        np.exp(z, out=e)
        return z, e, e @ self.ones


# --- training -----------------------------------------------------------------------------------


class Trainer:
    """Steps over a task's texts from the common weights."""

    def __init__(self, model: Model):
        self.model, self.biases = model, model.biases
        self.tables = [t.copy() for t in model.tables]
        self.squares = [s.copy() for s in model.squares]
        self.touched = [np.zeros(len(t), np.float32) for t in model.tables]
        self.softmax = [Softmax(t.shape[1]) for t in model.tables]
        # Used again by all steps: fresh memory for each of them took longer than the sums.
        self.slope, self.lines = ({w: np.empty((ROOM, w), np.float32) for w in WIDTHS} for _ in range(2))

    def step(self, ids: np.ndarray, at: np.ndarray, leaf: np.ndarray) -> None:
        for k, rows, owner, want, _ in choices(self.model, ids, at, leaf):
            _, g, total = self.softmax[k].of(self.tables[k], self.biases[k], rows, owner)
            g /= total[:, None]
            g[np.arange(len(want)), want] -= 1
            for r in rows:
                self._down(k, self.biases[k], r, g)

    def _down(self, k: int, base: int, rows: np.ndarray, slopes: np.ndarray) -> None:
        """One step of the rows (after base) against their summed slopes, of which each position has a line."""
        order = np.argsort(rows, kind="stable")  # of 16 bits: by radix
        there, (_, width), table = rows[order], slopes.shape, self.tables[k]
        begin = np.flatnonzero(np.concatenate([[True], there[1:] != there[:-1]]))
        there, n = there[begin].astype(np.int64) + base, np.diff(begin, append=len(rows))
        slope = np.take(slopes, order[begin], axis=0, out=self.slope[width][: len(n)], mode="clip")
        many = n > 1
        if many.any():  # the others have their whole sum already
            more, m = order[np.repeat(many, n)], n[many]
            lines = np.take(slopes, more, axis=0, out=self.lines[width][: len(more)], mode="clip")
            slope[many] = np.add.reduceat(lines, np.cumsum(m) - m, axis=0)
        self.touched[k][there] += n
        square = self.squares[k][there] + np.einsum("ij,ij->i", slope, slope)
        self.squares[k][there] = square
        slope *= (RATE / np.sqrt(square))[:, None]
        np.subtract(np.take(table, there, axis=0, out=self.lines[width][: len(n)], mode="clip"), slope, out=slope)
        np.clip(slope, -MOST, MOST, out=slope)
        whole = np.dtype((np.void, slope.itemsize * width))  # a row as one item
        table.view(whole)[there, 0] = slope.view(whole)[:, 0]

    def changes(self, model: Model):
        """Rows of the changes' schema: a block's touched rows with their weights, changes and sums of squares."""
        for k, (new, old) in enumerate(zip(self.tables, model.tables)):
            there = np.flatnonzero(self.touched[k])
            ends = np.searchsorted(there, np.arange(0, len(new) + 1, BLOCK_ROWS))
            for b, (i, j) in enumerate(zip(ends, ends[1:])):
                if i < j:
                    r = there[i:j]
                    change = new[r] - old[r]
                    scale = np.maximum(np.abs(change).max(1), 1e-30) / 127
                    parts = (r - b * BLOCK_ROWS).astype("<u2"), self.touched[k][r], scale.astype("<f4"), np.rint(change / scale[:, None]).astype("i1"), self.squares[k][r]
                    yield k, b, *(x.tobytes() for x in parts)


def pieces(batch: pa.RecordBatch):
    """Slices of a batch with about READ_BYTES of its text, or one longer text."""
    size = pc.binary_length(batch["text"]).fill_null(0).to_numpy().astype(np.int64)
    group = (np.cumsum(size) - size) // READ_BYTES
    borders = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for i, j in zip(borders, borders[1:]):
        if i < j:
            yield batch.slice(i, j - i)


def batches_of(reader: Reader, last: int, texts, size: int):
    """(ids, positions, classes) of so many positions, over the borders of texts and within them."""
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    for piece in pieces(pa.RecordBatch.from_arrays([texts], ["text"])):
        yield from _cut(reader, last, reader.read_all(piece["text"])[0], size)


def _cut(reader: Reader, last: int, ids: np.ndarray, size: int):
    at = np.flatnonzero(ids != reader.pad)
    leaf = reader.classes(ids[at], last)
    for i in range(0, len(at), size):
        yield ids, at[i : i + size], leaf[i : i + size]


_READERS: dict = {}


def _reader(model: Model) -> Reader:
    """One reader for each worker process and vocabulary."""
    if model.key not in _READERS:
        _READERS.clear()
        _READERS[model.key] = Reader(model)
    return _READERS[model.key]


def train_part(docs: DataFrame, model: Model) -> Model:
    """The model after one part of the training texts; its vocabulary stays."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    target = arrow_schema(spark, _CHANGES)

    def learn(batches):
        model = sent.value
        reader, trainer, any_text = _reader(model), Trainer(model), False
        for batch in batches:
            any_text |= batch.num_rows > 0
            for ids, at, leaf in batches_of(reader, model.last, batch["text"], BATCH):
                trainer.step(ids, at, leaf)
        if any_text:
            rows = []
            for r in trainer.changes(model):
                rows.append(r)
                if len(rows) == 64:
                    yield as_batch(dict(zip(target.names, zip(*rows))), target)
                    rows = []
            if rows:
                yield as_batch(dict(zip(target.names, zip(*rows))), target)

    def merge(batches):
        """Weighted means of a block's rows; a partition holds few blocks, each of a fixed size."""
        sums: dict = {}
        for batch in batches:
            for part, block, rows, weight, scale, change, square in zip(*(batch.column(i).to_pylist() for i in range(7))):
                r, w = np.frombuffer(rows, "<u2"), np.frombuffer(weight, "<f4")
                width = WIDTHS[part]
                if (part, block) not in sums:
                    sums[part, block] = np.zeros((BLOCK_ROWS, width + 2))
                s = sums[part, block]
                s[r, 0] += w
                s[r, 1] += w * np.frombuffer(square, "<f4")
                s[r, 2:] += (w * np.frombuffer(scale, "<f4"))[:, None] * np.frombuffer(change, "i1").reshape(-1, width)
        for (part, block), s in sums.items():
            r = np.flatnonzero(s[:, 0])
            mean = (s[r, 1:] / s[r, :1]).astype("<f4")
            row = (part, block, r.astype("<u2").tobytes(), s[r, 0].astype("<f4").tobytes(), b"", mean[:, 1:].tobytes(), mean[:, 0].tobytes())
            yield as_batch(dict(zip(target.names, ([x] for x in row))), target)

    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    merged = docs.select("text").coalesce(tasks).mapInArrow(released(learn), _CHANGES).repartition("part", "block").mapInArrow(merge, _CHANGES)
    tables, squares = [t.copy() for t in model.tables], [s.copy() for s in model.squares]
    for r in merged.toArrow().to_pylist():
        k, at = r["part"], np.frombuffer(r["rows"], "<u2").astype(np.int64) + r["block"] * BLOCK_ROWS
        tables[k][at] += np.frombuffer(r["change"], "<f4").reshape(len(at), -1)
        squares[k][at] = np.frombuffer(r["square"], "<f4")
    sent.destroy()
    return replace(model, tables=tables, squares=squares)


def train(docs: DataFrame, counts: DataFrame, common: int = COMMON, rounds: int = ROUNDS) -> Model:
    """A model of all rows of docs, whose words are counted; each text is learnt from once, in one of the rounds."""
    model = vocabulary(counts, common)
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(rounds))
    for r in range(rounds):
        model = train_part(docs.where(part == r), model)
    return model


# --- scores -------------------------------------------------------------------------------------


def path_logs(model: Model, softmax: list[Softmax], ids: np.ndarray, at: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """log10 of P(group | history) * P(class | group, history) * P(word | class, history) at these positions, BATCH of them at most.

    The last factor is left out for words that aren't common.
    """
    out = np.zeros(len(at))
    for k, rows, owner, want, own in choices(model, ids, at, leaf):
        z, _, total = softmax[k].of(model.tables[k], model.biases[k], rows, owner)
        logs = z[np.arange(len(want)), want] - np.log(total.astype(np.float64))
        out += np.bincount(own, logs, len(at)) if k == 2 else logs
    return out / math.log(10)


def _listed(own: np.ndarray, words: pa.DictionaryArray, texts: int, kind: pa.ListType) -> pa.Array:
    """An array of the words, with their numbers, of each text; own is the text of each of them."""
    most = len(words.dictionary)
    seen, n = np.unique(own * most + words.indices.to_numpy(), return_counts=True)
    ends = np.searchsorted(seen, np.arange(texts + 1) * most).astype(np.int32)
    pairs = pa.StructArray.from_arrays([words.dictionary.take(pa.array(seen % most)), pa.array(n, pa.int64())], fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array(ends), pairs, type=kind)


def score_rows(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each text: sums over its common words, and its other words with their numbers."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    target = arrow_schema(spark, _SCORED)

    def run(batches):
        model = sent.value
        reader, made = _reader(model), TaskContext.get().partitionId() << 40
        base = np.append(np.log10(model.counts + PSEUDO), 0)
        softmax = [Softmax(t.shape[1]) for t in model.tables]

        def sums(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
            """(base, path) of each of these texts, a row each; batches go over the texts' borders."""
            own = np.repeat(np.arange(len(sizes)), sizes)
            out = np.zeros((2, len(sizes)))
            at = np.flatnonzero(ids != reader.pad)
            for i in range(0, len(at), BATCH):
                here = at[i : i + BATCH]
                words, text = ids[here], own[here]
                common = np.minimum(words, reader.common)
                out[0] += np.bincount(text, base[common], len(sizes))
                out[1] += np.bincount(text, path_logs(model, softmax, ids, here, reader.classes(words, model.last)), len(sizes))
            return out

        for piece in chain.from_iterable(map(pieces, batches)):
            ids, sizes, own, others = reader.read_all(piece["text"])
            rare = np.bincount(own, minlength=len(sizes))
            columns = [range(made, made + len(sizes)), piece["doc_id"], piece["held_out"], sizes - PADS, sizes - PADS - rare]
            columns += [*sums(ids, sizes), _listed(own, others, len(sizes), target.field("rare").type)]
            made += len(sizes)
            yield as_batch(dict(zip(target.names, columns)), target)

    return docs.select("doc_id", "held_out", "text").mapInArrow(released(run), _SCORED)


def score(docs: DataFrame, common: int = COMMON, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: learnt from the rows that aren't held out."""
    own = doc_columns(docs, "doc_id", "text").withColumn("held_out", held_out())
    training = own.where(~F.col("held_out"))
    counts = stage(word_counts(training), "words")
    model = train(training, counts, common, rounds)
    scored = stage(score_rows(own, model), "scored")
    # What isn't common has fewer occurrences than any common word; a word that isn't there is unseen.
    rare = scored.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.n")
    met = rare.join(counts.select("word", "c"), "word", "left").na.fill(0, ["c"])
    sums = met.groupBy("row").agg(
        F.sum("n").alias("n_rare"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + PSEUDO)).alias("rare_log")
    )
    whole = scored.drop("rare").join(sums, "row", "left").na.fill(0, ["n_rare", "rare_known", "rare_log"])
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_common") + F.col("rare_known")).alias("n_known"), F.lit(model.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.col("rare_log") - F.col("n_tokens") * math.log10(model.base_total())).alias("base_score"),
        (F.col("path") + F.col("rare_log") - F.col("n_rare") * math.log10(model.rare_total)).alias("score"),
    )
