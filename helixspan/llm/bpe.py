"""Byte-level BPE by Spark higher-order functions.

A word (a match of the vocabulary's pattern) is held as its bytes, which never change, and an
array with an item for each of its pieces: the rank of the pair that begins with the piece, and
the piece's first byte. A fold merges the leftmost pair of lowest rank, which is the least item,
and looks up the two pairs that this makes, until no pair has a rank. The rank map is a literal
of the plan: an array of small maps, so that a lookup is a hash and a few comparisons. Decoding
looks every id's bytes up in a literal array and concatenates these binary pieces. The bytes of a
word that is folded are held as text of the same code points (ISO 8859-1), since maps want text.

Only distinct words are folded:
1. Words are counted over all documents; the most frequent ones (at most `common`, which bounds
   the broadcast: those with at least the smallest count for which they are no more) are folded
   once and sent to all tasks, as Arrow columns in order of the words' hashes.
2. Each task numbers the pieces of its texts (a word or two each) and the words in them. A block of
   documents goes on as the numbers of its pieces, with what is new in it: pieces as numbers of
   words, and the words that are not among the frequent ones, on which the fold and the decoding run in
   the same stage. Numbers begin anew after HELD_PIECES of them, which bounds what a task holds.
3. The documents' ids and decoded bytes are put together by number.
So no text and no occurrence is shuffled, and each word's ids come from the fold. Since a fold
copies its items at each merge, words of more than LONG_WORD bytes, which have no place in prose,
are merged by a heap in the task instead, by the same rule. Their ids are decoded as all others, through
the literal table of pieces.

Python finds the words (Spark's own regular expressions know another edition of Unicode) and
concatenates their results.

Defined cases: null text is the empty text: no tokens, both digests of the empty string; very
long texts and words take time in proportion to n log n; repeated rows give repeated results; an
empty table has no rows; columns of other names, or names that differ only by case, fall away.
"""
from __future__ import annotations

import base64
import hashlib
import heapq
import json
import math
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, doc_columns, released, stage, tokenizer_path
from .tokens import Grown, Rows, spaced_pieces

COMMON = 800_000
HELD_PIECES = 600_000
BUCKETS = 8192
NO_RANK = 1 << 30
ROW_CHARS = 1 << 20
LONG_WORD = 1024  # bytes
FREQUENT, FOLDED, LONG = 0, 1, 2
CHUNK = 256
PIECE_ROWS = 256


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


# --- literals and the fold -----------------------------------------------------------------------


def rank_literal(ranks: dict[bytes, int]):
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        text = piece.decode("latin-1")
        buckets[xxhash.xxh64_intdigest(text.encode(), seed=42) & (BUCKETS - 1)][text] = rank  # as Spark's xxhash64
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def piece_literal(ranks: dict[bytes, int]):
    at = {r: p for p, r in ranks.items()}
    texts = [base64.b64encode(at.get(i, b"")).decode() for i in range(max(at) + 1)]
    return F.from_json(F.lit(json.dumps(texts)), "array<binary>")


def bind(value, body):
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rank_of(table, piece):
    place = F.xxhash64(piece).bitwiseAND(F.lit(BUCKETS - 1).cast("bigint")).cast("int") + 1
    return F.element_at(F.element_at(table, place), piece)


def fold_word(table, word):
    """ids of a word given as text of its bytes' code points."""
    mask, none = F.lit((1 << 32) - 1).cast("bigint"), F.lit(NO_RANK)

    def rank(a, b):
        return bind(F.substring(word, a + 1, b - a), lambda p: F.coalesce(rank_of(table, p), none))

    def item(r, start):
        return F.shiftleft(r.cast("bigint"), 32).bitwiseOR(start.cast("bigint"))

    def merge(items, _):
        first = lambda i: F.element_at(items, i).bitwiseAND(mask).cast("int")

        def at(i):
            merged = bind(first(i), lambda a: item(F.when(i + 3 <= F.size(items), rank(a, first(i + 3))).otherwise(none), a))
            left = bind(first(i - 1), lambda a: item(rank(a, first(i + 2)), a))
            rest = F.slice(items, i + 2, F.size(items))
            return F.when(i > 1, F.flatten(F.array(F.slice(items, F.lit(1), i - 2), F.array(left, merged), rest))).otherwise(F.flatten(F.array(F.array(merged), rest)))

        least = lambda x: F.when(x < F.lit(NO_RANK << 32), bind(F.array_position(items, x).cast("int"), at)).otherwise(items)
        return bind(F.array_min(items), least)

    def ids(items):
        start = lambda i: F.element_at(items, i).bitwiseAND(mask).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(items) - 1), lambda i: bind(start(i), lambda a: rank_of(table, F.substring(word, a + 1, start(i + 1) - a))))

    def fold(n):
        # An item for each byte, and one for the end.
        items = F.transform(F.sequence(F.lit(0), n), lambda i: item(F.when(i + 2 <= n, rank(i, i + 2)).otherwise(none), i))
        return F.aggregate(F.sequence(F.lit(1), n - 1), items, merge, ids)

    def whole(known):
        return F.when(known.isNull(), bind(F.length(word), fold)).otherwise(F.array(known))

    return bind(rank_of(table, word), whole)


def encode_words(words, ranks):
    """array<array<int>>: the ids of each word of an array of texts."""
    one = lambda table: lambda w: bind(F.decode(F.encode(w, "UTF-8"), "ISO-8859-1"), lambda x: fold_word(table, x))
    return bind(rank_literal(ranks), lambda table: F.transform(words, one(table)))


def decode_ids(ids, ranks):
    """array<binary>: the bytes of each array of ids, its pieces concatenated (in chunks, for words of very many)."""
    empty = F.lit(b"").cast("binary")

    def one(table):
        pieces = lambda part: F.aggregate(part, empty, lambda all_, i: F.concat(all_, F.element_at(table, i + 1)))
        starts = lambda x: F.sequence(F.lit(1), F.size(x), F.lit(CHUNK))
        return lambda x: F.when(F.size(x) <= CHUNK, pieces(x)).otherwise(
            F.aggregate(starts(x), empty, lambda all_, i: F.concat(all_, pieces(F.slice(x, i, F.lit(CHUNK)))))
        )

    return bind(piece_literal(ranks), lambda table: F.transform(ids, one(table)))


def heap_merge(ranks: dict[bytes, int], word: bytes) -> list[int]:
    """ids of a very long word: pairs wait in a heap by rank and place."""
    n = len(word)
    after, before, live = list(range(1, n + 2)), list(range(-1, n)), [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(a: int) -> None:
        b = after[a]
        if b < n and (r := ranks.get(word[a : after[b]])) is not None:
            heapq.heappush(heap, (r, a, after[b]))

    for a in range(n):
        offer(a)
    while heap:
        r, a, end = heapq.heappop(heap)
        b = after[a]
        if not live[a] or b >= n or after[b] != end:
            continue  # one of the two has been merged since
        live[b] = False
        after[a] = end
        if end < n:
            before[end] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    out, a = [], 0
    while a < n:
        out.append(ranks[word[a : after[a]]])
        a = after[a]
    return out


class Texts:
    """Byte strings by number, one behind another in a growing array."""

    def __init__(self):
        self.flat, self.first, self.size = Grown(np.uint8), Grown(np.int64), Grown(np.int32)

    def extend(self, texts: list[bytes]) -> None:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        at = self.flat.extend(np.frombuffer(b"".join(texts), np.uint8))
        self.first.extend(at + np.cumsum(sizes) - sizes)
        self.size.extend(sizes)

    def joined(self, numbers: np.ndarray, upto: np.ndarray) -> tuple[memoryview, list[int]]:
        """The texts of these numbers as one, and where those of the first upto[i] numbers end."""
        sizes = self.size.data[numbers].astype(np.int64)
        ends = np.cumsum(sizes)
        at = np.repeat(self.first.data[numbers] - (ends - sizes), sizes)
        at += np.arange(len(at))
        return memoryview(self.flat.data[at]), np.concatenate([[0], ends])[upto].tolist()


class Held:
    """Results of the words and pieces that a task has numbered."""

    def __init__(self):
        self.word_csv: list[str] = []
        self.word_bytes: list[bytes] = []
        self.csv, self.bytes, self.counts = Texts(), Texts(), Grown(np.int32)

    def add_words(self, kinds: np.ndarray, csv: tuple, raw: tuple) -> None:
        """csv and raw: the results of the words of each kind, in order."""
        for out, parts in ((self.word_csv, csv), (self.word_bytes, raw)):
            each = [iter(p) for p in parts]
            out.extend([next(each[k]) for k in kinds.tolist()])

    def add_pieces(self, sizes: np.ndarray, words: np.ndarray) -> None:
        names, ends = words.tolist(), np.cumsum(sizes).tolist()
        spans = list(zip([0, *ends], ends))
        csv = [",".join([self.word_csv[w] for w in names[a:b]]) + "," for a, b in spans]
        self.csv.extend([x.encode() for x in csv])
        self.bytes.extend([b"".join([self.word_bytes[w] for w in names[a:b]]) for a, b in spans])
        self.counts.extend(np.fromiter((x.count(",") for x in csv), np.int32, len(csv)))

    def texts(self, numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list, list]:
        """For texts of so many pieces each: their tokens, ids (comma-joined) and bytes."""
        upto = np.cumsum(sizes)
        tokens = np.concatenate([[0], np.cumsum(self.counts.data[numbers], dtype=np.int64)])
        csv, csv_ends = self.csv.joined(numbers, upto)
        raw, ends = self.bytes.joined(numbers, upto)
        all_ids = [csv[a : max(a, b - 1)] for a, b in zip([0, *csv_ends], csv_ends)]  # without the last comma
        return np.diff(tokens[np.concatenate([[0], upto])]), all_ids, [raw[a:b] for a, b in zip([0, *ends], ends)]


# --- words of texts --------------------------------------------------------------------------------


def values(column: pa.Array):
    """A column's values one by one, of which only some are Python objects at a time."""
    for i in range(0, len(column), PIECE_ROWS):
        yield from column.slice(i, PIECE_ROWS).to_pylist()


def matcher():
    """Finds the words of a piece of text, by the pattern that comes with the vocabularies."""
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN).findall


def is_long(word: str) -> bool:
    return len(word) > LONG_WORD // 4 and len(word.encode()) > LONG_WORD


class Common:
    """Words in order of their hashes."""

    def __init__(self, words: pa.Array):
        parts = [self.hashed(words.slice(i, 50_000).to_pylist()) for i in range(0, len(words), 50_000)]
        hashes = np.concatenate([np.empty(0, np.uint64), *parts])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.order = hashes[order], pa.array(order)
        self.words = words.take(self.order)

    @staticmethod
    def hashed(words: list[str]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, [w.encode() for w in words]), np.uint64, len(words))

    def places(self, words: list[str]) -> np.ndarray:
        """The place of each word, or -1; a word whose hash another one has before it counts as not there."""
        if not len(self.hashes) or not words:
            return np.full(len(words), -1)
        own = self.hashed(words)
        at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        same = np.flatnonzero(self.hashes[at] == own)
        out = np.full(len(words), -1)
        for i, w in zip(same.tolist(), self.words.take(pa.array(at[same])).to_pylist()):
            if words[i] == w:
                out[i] = at[i]
        return out


def common_words(docs: DataFrame, ranks: dict[bytes, int], common: int) -> tuple[Common, tuple[pa.Array, pa.Array]]:
    """The most frequent words, and in the same order their ids (comma-joined) and decoded bytes."""
    spark = docs.sparkSession
    target = arrow_schema(spark, "word string, n bigint")

    def count(batches):
        find, held = matcher(), Counter()

        def out():
            words: Counter = Counter()
            for piece, n in held.items():
                for w in find(piece):
                    if not is_long(w):
                        words[w] += n
            held.clear()
            flat = list(words.items())
            for i in range(0, len(flat), 50_000):
                part = flat[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], target.field(0).type), pa.array([n for _, n in part], pa.int64())], schema=target)

        for batch in batches:
            for text in values(batch.column(0)):
                if text:
                    held.update(spaced_pieces(text))
                if len(held) > 300_000:
                    yield from out()
        yield from out()

    counted = docs.select("text").mapInArrow(released(count), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counted = stage(counted.filter("n > 1"), "words")
    # The smallest count (in steps of 1/16 of its power of two) for which the words aren't too many.
    step = F.floor(F.log2("n") * 16).cast("int")
    left, least = common, math.inf
    for r in sorted(counted.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["step"]):  # some hundred rows
        left -= r["words"]
        if left < 0:
            break
        least = r["step"]
    often = counted.filter(step >= (int(least) if least < math.inf else 1 << 30)).select("word")
    # Arrays of words, so that the literals are evaluated once for many.
    slots = max(1, min(spark.sparkContext.defaultParallelism * 4, 256))
    often = often.repartition(slots).groupBy(F.spark_partition_id().alias("p"), (F.monotonically_increasing_id() % 64).alias("q"))
    table = fold_columns(often.agg(F.collect_list("word").alias("words")), ranks).select(F.explode(F.arrays_zip("words", "csv", "pieces")).alias("x"))
    found = table.select("x.words", "x.csv", "x.pieces").toArrow()
    words = Common(found.column("words").combine_chunks())
    results = tuple(found.column(k).combine_chunks().take(words.order) for k in ("csv", "pieces"))
    del words.order
    return words, results


def fold_columns(rows: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Adds to `words`: csv (ids, comma-joined) and pieces (decoded bytes), by word."""
    ids = rows.withColumn("ids", encode_words(F.col("words"), ranks))
    out = ids.withColumn("csv", F.transform("ids", lambda x: F.array_join(x.cast("array<string>"), ",")))
    return out.withColumn("pieces", decode_ids(F.col("ids"), ranks)).drop("ids")


SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_and_decode(docs: DataFrame, vocabulary: str | None = None, common: int = COMMON, with_ids: bool = False) -> DataFrame:
    """Per document: token count and digests of its ids and of the decoded bytes; with_ids adds the ids (comma-joined)."""
    spark = docs.sparkSession
    docs = doc_columns(docs, "doc_id", "text")
    ranks = load_ranks(vocabulary or tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    words, results = common_words(docs, ranks, common)
    shared, shared_results, held_ranks = (spark.sparkContext.broadcast(x) for x in (words, results, ranks))
    del words, results
    gathered = (
        "anew boolean, doc_ids array<bigint>, sizes binary, numbers binary, kinds binary, places binary, piece_sizes binary, "
        "piece_words binary, long_ids array<array<int>>, words array<string>"
    )
    target_a = arrow_schema(spark, gathered)

    def gather(batches):
        find, known = matcher(), shared.value
        pieces, words = Rows(), Rows()
        ids, texts, room = [], [], ROW_CHARS

        def row():
            anew = len(pieces) > HELD_PIECES
            if anew:
                pieces.clear()
                words.clear()
            cuts = [spaced_pieces(text) if text else [] for text in texts]
            counts = list(map(len, cuts))
            numbers = np.fromiter(map(pieces.__getitem__, chain.from_iterable(cuts)), np.int32, sum(counts))
            found = [find(piece) for piece in pieces.noted()]
            piece_sizes = list(map(len, found))
            piece_words = np.fromiter(map(words.__getitem__, chain.from_iterable(found)), np.int32, sum(piece_sizes))
            new = words.noted()
            places = known.places(new)
            kinds = np.where(places >= 0, FREQUENT, FOLDED).astype(np.uint8)
            kinds[np.fromiter(map(is_long, new), bool, len(new))] = LONG
            of = lambda kind: [new[i] for i in np.flatnonzero(kinds == kind).tolist()]
            cols = [anew, ids, counts, numbers, kinds, places[kinds == FREQUENT], piece_sizes, piece_words, [heap_merge(held_ranks.value, w.encode()) for w in of(LONG)], of(FOLDED)]
            as_bytes = lambda v, f: v if f.type != pa.binary() else v.tobytes() if isinstance(v, np.ndarray) and v.dtype.itemsize < 8 else np.asarray(v, "<i4").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([as_bytes(v, f)], f.type) for v, f in zip(cols, target_a)], schema=target_a)

        for batch in batches:
            for d, text in zip(values(batch.column(0)), values(batch.column(1))):
                ids.append(d)
                texts.append(text or "")
                room -= len(texts[-1]) + 64
                if room < 0:
                    yield row()
                    ids, texts, room = [], [], ROW_CHARS
        if ids:
            yield row()

    ddl = SCHEMA + (", ids string" if with_ids else "")
    target_b = arrow_schema(spark, ddl)

    def assemble(batches):
        known_csv, known_pieces = shared_results.value
        held = None
        for batch in batches:
            for i in range(batch.num_rows):
                anew, ids, sizes, numbers, kinds, places, piece_sizes, piece_words, long_ids, csv, raw, long = (batch.column(c)[i].as_py() for c in range(12))
                if anew or held is None:
                    held = Held()
                at = pa.array(np.frombuffer(places, "<i4"))
                long_csv = [",".join(map(str, x)) for x in long_ids]
                held.add_words(np.frombuffer(kinds, np.uint8), (known_csv.take(at).to_pylist(), csv, long_csv), (known_pieces.take(at).to_pylist(), raw, long))
                held.add_pieces(np.frombuffer(piece_sizes, "<i4"), np.frombuffer(piece_words, "<i4"))
                n_tokens, all_ids, plain = held.texts(np.frombuffer(numbers, "<i4"), np.frombuffer(sizes, "<i4"))
                cols = [ids, n_tokens, [hashlib.sha256(x).hexdigest() for x in all_ids], [hashlib.sha256(x).hexdigest() for x in plain]]
                cols += [[bytes(x).decode() for x in all_ids]] if with_ids else []
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, target_b)], schema=target_b)

    rows = fold_columns(docs.mapInArrow(released(gather), gathered), ranks).withColumn("long_pieces", decode_ids(F.col("long_ids"), ranks)).drop("words")
    return rows.mapInArrow(released(assemble), ddl)
