"""Divergence audit of sources: how far each source of a language is from every other one, and by which terms.

A term vector of a group (language, source) is cut by term into blocks, so that no task ever
holds a group, a language or a term's whole list. In a block the groups have seats: a seat's
vectors are resident in one partition, and compressed copies of the others' circulate. Seats
meet by the circle method of a round-robin tournament, so that any two meet in exactly one
round; of the two, one is host, chosen so that each seat is host of about half of its meetings.
A meeting evaluates both directions. As rounds and hosts are closed formulas of the seats, the
whole rotation is one shuffle by host with the rounds in order inside it: a task holds its
residents and one visitor at a time, and a lost task only meets again.

The vectors are sparse. A pair of groups differs from the case of two absent terms only where
one of them has the term, so a meeting takes time by its two vectors; absent terms are counted.

Terms of a group are ranked by local heaps over the blocks of a task, then over all tasks.

Numbers are integers throughout: p = 1 + floor(SCALE * (count + 1) / (N + V)), and a pair's or
term's value is floor((p - q)^2 / q), summed. Counts beyond 64 bits' room are scaled as Python
integers.

Defined cases: null text, language and source are the empty string; each row is one document of
its language, so that repeated rows count as often as they stand; very long texts take time in
proportion to their length; a group without kept terms takes part with counts of 0, and where a
language keeps no term all its pairs have the value 0; ties go by the item's UTF-8 bytes; an
empty table has no rows; columns of other names, or names that differ only by case, fall away.
"""
from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, as_batch, doc_columns, released, stage

# Fixed values of the contract.
SCALE = 1_000_000_000
LEAST_DOCS = 3
TERM_RANKS = 200

#: Terms: runs of ASCII letters and of anything beyond ASCII.
_SEPARATORS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Entries (group, term, count) of a block: between these, so many as a language has pairs of groups,
#: so that the sums of blocks aren't more than the entries as long as the upper bound isn't met.
BLOCK_ENTRIES = (1 << 17, 1 << 21)
#: Seats of a block; languages with more groups have several groups on a seat.
SEATS = 64
#: Entries that a task counts before it passes them on.
HELD = 1 << 19

_COUNTS = "lang string, source string, term string, n bigint, docs bigint"
_CELLS = (
    "lang string, block bigint, source string, seat bigint, seats bigint, total bigint, kept bigint, "
    "width bigint, vector binary, item string, value bigint"
)
_PAIRS = "lang string, source string, item string, value bigint"


# --- counts -----------------------------------------------------------------------------------


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().translate(_SEPARATORS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """Occurrences and documents of each term of each group: counted in the tasks first, so a frequent term is a row a task."""
    target = arrow_schema(docs.sparkSession, _COUNTS)

    def run(batches):
        held: dict = defaultdict(lambda: (Counter(), Counter()))
        size = 0

        def passed():
            for (lang, source), (n, d) in held.items():
                terms = list(n)
                columns = {
                    "lang": pa.repeat(pa.scalar(lang), len(terms)), "source": pa.repeat(pa.scalar(source), len(terms)), "term": pa.array(terms, pa.binary()),
                    "n": pa.array(n.values(), pa.int64()), "docs": pa.array([d[t] for t in terms], pa.int64()),
                }
                for at in range(0, len(terms), 1 << 16):
                    yield as_batch({k: v.slice(at, 1 << 16) for k, v in columns.items()}, target)
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = terms_of(text)
                n, d = held[lang, source]
                before = len(n)
                n.update(words)
                d.update(set(words))
                size += len(n) - before
                if size > HELD:
                    yield from passed()
                    size = 0
        yield from passed()

    counted = _named(docs, "text").mapInArrow(released(run), _COUNTS)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _named(docs: DataFrame, *more: str) -> DataFrame:
    own = doc_columns(docs, "lang", "source", *more)
    return own.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), *more)


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The entries of terms in at least so many documents of the language, with the language's own count.

    A window holds one term's groups of one language: a row for each source at most.
    """
    w = Window.partitionBy("lang", "term")
    of_lang = counts.select(
        "lang", "source", "term", "n", F.sum("n").over(w).alias("lang_n"), F.sum("docs").over(w).alias("lang_docs"), (F.min("source").over(w) == F.col("source")).alias("first")
    )
    return of_lang.where(F.col("lang_docs") >= least_docs).drop("lang_docs")


def group_table(docs: DataFrame, kept: DataFrame, block_entries: tuple[int, int], seats: int) -> tuple[DataFrame, DataFrame]:
    """(a row for each group: its total, its seat; a row for each language: totals, kept terms, blocks)."""
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("entries"))
    groups = _named(docs).distinct().join(totals, ["lang", "source"], "left").na.fill(0, ["total", "entries"])
    sums = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("first").cast("bigint")).alias("kept"), F.count("*").alias("lang_entries"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("groups")).join(sums, "lang", "left").na.fill(0)
    low, high = block_entries
    room = F.greatest(F.lit(low), F.least(F.col("groups") * F.col("groups"), F.lit(high)))
    langs = langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("lang_entries") / room)).cast("bigint"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("entries"), "source")) - 1
    seated = groups.withColumn("place", place).join(langs, "lang").withColumn("seats", F.least("groups", F.lit(seats)).cast("bigint"))
    return seated.withColumn("seat", (F.col("place") % F.col("seats")).cast("bigint")), langs


# --- vectors ----------------------------------------------------------------------------------


def scaled(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exact for counts of any size."""
    if total <= 0:
        return np.ones(len(counts), np.int64)
    if len(counts) and int(counts.max()) >= (1 << 63) // SCALE - 1:
        return np.array([1 + SCALE * (int(c) + 1) // total for c in counts], np.int64)
    return 1 + SCALE * (counts.astype(np.int64) + 1) // total


def values(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); both are at most SCALE + 1, so squares fit 64 bits."""
    d = p - q
    return d * d // q


def packed(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """A sparse vector: gaps of ascending ids, then counts, in the narrowest types that hold them."""
    gaps = np.diff(ids, prepend=-1)
    parts = []
    for a in (gaps, counts):
        kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(a) or int(a.max()) <= np.iinfo(k).max)
        parts.append((kind[-1].encode(), a.astype(kind).tobytes()))
    return zlib.compress(len(ids).to_bytes(8, "little") + b"".join(k + b for k, b in parts), 1)


def unpacked(vector: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(vector)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for _ in range(2):
        kind = np.dtype(f"<u{raw[at : at + 1].decode()}")
        out.append(np.frombuffer(raw, kind, n, at + 1).astype(np.int64))
        at += 1 + n * kind.itemsize
    return np.cumsum(out[0]) - 1, out[1]


def runs(batches, *keys: str):
    """(key, table) of each run of equal key columns, over the batches' borders; null isn't a key."""
    held: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for k in keys:
            c = batch.column(batch.schema.get_field_index(k))
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            piece = batch.slice(a, b - a)
            key = tuple(piece.column(piece.schema.get_field_index(k))[0].as_py() for k in keys)
            if key != last and held:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(piece)
    if held:
        yield last, pa.Table.from_batches(held)


def cells(kept: DataFrame, groups: DataFrame, langs: DataFrame, ranks: int) -> DataFrame:
    """A row for each block and group with its packed vector, and rows of the groups' highest terms so far.

    A block's rows are its groups and then its entries by term; ids are the places of its terms in
    UTF-8 order. The heaps go over all the blocks of a language that a task holds.
    """
    spark = kept.sparkSession
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    numbers = ("total", "kept", "lang_total", "seat", "seats")
    heads = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", F.lit("").alias("term"), *none("bigint", "n", "lang_n"), *numbers)
    entries = kept.join(langs.select("lang", "blocks"), "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "source", "term", "n", "lang_n", *none("bigint", *numbers)
    )
    rows = heads.unionByName(entries).repartition("lang", "block").sortWithinPartitions("lang", "block", "term", "source")
    target = arrow_schema(spark, _CELLS)

    def run(batches):
        best: dict = {}
        of = None

        def ranked():
            flat = [(of, s, t.decode("utf-8"), -v) for s, heap in best.items() for v, t in heap]
            best.clear()
            return _filled({"lang": [r[0] for r in flat], "source": [r[1] for r in flat], "item": [r[2] for r in flat], "value": [r[3] for r in flat]}, target)

        for (lang, block), t in runs(batches, "lang", "block"):
            if of is not None and of != lang:
                yield ranked()
            of = lang
            head = t.filter(pc.is_valid(t["seat"]))
            body = t.filter(pc.is_null(t["seat"]))
            sources = head["source"].combine_chunks()
            total, v, lang_total, seat, seats = (head[c].to_numpy() for c in numbers)
            term = body["term"].combine_chunks()
            new = np.ones(len(term), bool)
            if len(term):
                new[1:] = pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)).to_numpy(zero_copy_only=False)
            ids = np.cumsum(new) - 1
            n, lang_n = body["n"].to_numpy(), body["lang_n"].to_numpy()
            group = pc.index_in(body["source"].combine_chunks(), value_set=sources).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(group, kind="stable")
            ends = np.searchsorted(group[order], np.arange(len(sources) + 1))
            names, vectors = sources.to_pylist(), []
            for i, name in enumerate(names):
                mine = order[ends[i] : ends[i + 1]]
                vectors.append(packed(ids[mine], n[mine]))
                p, q = scaled(n[mine], int(total[i] + v[i])), scaled(lang_n[mine], int(lang_total[i] + v[i]))
                up = np.flatnonzero(p > q)
                value = values(p[up], q[up])
                top = up[np.lexsort((up, -value))[:ranks]]  # mine is in the terms' order
                value = values(p[top], q[top])
                if len(top):
                    new_ones = zip((-value).tolist(), [x.encode("utf-8") for x in term.take(pa.array(mine[top])).to_pylist()])
                    best[name] = heapq.nsmallest(ranks, [*best.get(name, ()), *new_ones])
            k = len(names)
            yield _filled(
                {
                    "lang": pa.repeat(pa.scalar(lang), k), "block": np.full(k, block), "source": sources, "seat": seat, "seats": seats, "total": total, "kept": v,
                    "width": np.full(k, int(new.sum())), "vector": vectors,
                }, target,
            )
        if of is not None:
            yield ranked()

    return rows.mapInArrow(released(run), _CELLS)


def _filled(columns: dict, target: pa.Schema) -> pa.RecordBatch:
    """A batch whose other columns are null."""
    n = len(next(iter(columns.values())))
    return as_batch({f.name: columns.get(f.name, pa.nulls(n, f.type)) for f in target}, target)


# --- tournament -------------------------------------------------------------------------------


def host(i, j):
    """Which of two seats (numbers) is host: the smaller one if their sum is odd."""
    return min(i, j) if (i + j) % 2 else max(i, j)


def round_of(i: int, j: int, seats: int) -> int:
    """The round in which two seats meet by the circle method: an even number of seats, of which the last stays in place."""
    ring = seats - 1 + seats % 2
    return 2 * min(i, j) % ring if max(i, j) == ring else (i + j) % ring


def _journeys():
    """Column: (host, round) of each stop of a seat's vectors, first its own seat in round -1; host and round_of as expressions."""
    i, n = F.col("seat"), F.col("seats")
    ring = n - 1 + n % 2
    hosted = lambda j: F.when((i + j) % 2 == 1, F.least(i, j)).otherwise(F.greatest(i, j)) == j
    turn = lambda j: F.when(F.greatest(i, j) == ring, 2 * F.least(i, j) % ring).otherwise((i + j) % ring)
    stops = F.filter(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda j: (j != i) & hosted(j))
    own = F.array(F.struct(i.alias("host"), F.lit(-1).cast("bigint").alias("round")))
    return F.concat(own, F.transform(stops, lambda j: F.struct(j.alias("host"), turn(j).cast("bigint").alias("round"))))


class Guest:
    """A group's part of a block, ready to meet others."""

    def __init__(self, source: str, total: int, kept: int, vector: bytes):
        self.source = source
        self.ids, counts = unpacked(vector)
        self.p = scaled(counts, total + kept)
        self.none = scaled(np.zeros(1, np.int64), total + kept)


class Board:
    """A block's terms, on which one visitor's vector is spread out at a time."""

    def __init__(self, width: int):
        self.place = np.full(width, -1, np.int64)
        self.guest: Guest | None = None

    def spread(self, g: Guest) -> None:
        if self.guest is not None:
            self.place[self.guest.ids] = -1
        self.guest = g
        self.place[g.ids] = np.arange(len(g.ids))

    def meet(self, a: Guest) -> tuple[int, int]:
        """(value of a against the guest, value of the guest against a) over all terms of the block."""
        b = self.guest
        at = self.place[a.ids]
        both = at >= 0
        pb = np.where(both, b.p[at] if len(b.p) else 0, b.none)
        alone = np.ones(len(b.ids), bool)
        alone[at[both]] = False
        only = b.p[alone]
        neither = len(self.place) - len(a.ids) - len(only)
        one = values(a.p, pb).sum() + values(a.none, only).sum() + neither * values(a.none, b.none)[0]
        two = values(pb, a.p).sum() + values(only, a.none).sum() + neither * values(b.none, a.none)[0]
        return int(one), int(two)


def tournament(vectors: DataFrame) -> DataFrame:
    """lang, source, item, value: the sum over a block for each ordered pair of its groups."""
    stops = vectors.withColumn("stop", F.explode(_journeys())).select(
        "lang", "block", F.col("stop.host").alias("host"), F.col("stop.round").alias("round"), "source", "total", "kept", "width", "vector"
    )
    rows = stops.repartition("lang", "block", "host").sortWithinPartitions("lang", "block", "host", "round", "source")
    target = arrow_schema(vectors.sparkSession, _PAIRS)

    def run(batches):
        key, residents, board = None, [], None
        for batch in batches:
            out: list = []
            c = batch.to_pydict()
            for lang, block, seat, turn, source, total, kept, width, vector in zip(*(c[n] for n in ("lang", "block", "host", "round", "source", "total", "kept", "width", "vector"))):
                if (lang, block, seat) != key:
                    key, residents, board = (lang, block, seat), [], Board(width)
                guest = Guest(source, total, kept, vector)
                board.spread(guest)
                for r in residents:
                    one, two = board.meet(r)
                    out += [(lang, r.source, source, one), (lang, source, r.source, two)]
                if turn < 0:
                    residents.append(guest)
            columns = list(zip(*out)) if out else [[]] * 4
            yield as_batch(dict(zip(target.names, columns)), target)

    return rows.mapInArrow(released(run), _PAIRS)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = TERM_RANKS, block_entries: tuple[int, int] = BLOCK_ENTRIES, seats: int = SEATS) -> DataFrame:
    """lang, source, part, item, value, rank: other sources of the language by divergence, and the group's terms above the language's share."""
    kept = stage(kept_terms(term_counts(docs), least_docs), "kept_terms")
    groups, langs = (stage(t, n) for t, n in zip(group_table(docs, kept, block_entries, seats), ("groups", "langs")))
    found = stage(cells(kept, groups, langs, ranks), "vectors")
    pairs = tournament(found.where(F.col("vector").isNotNull())).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    terms = found.where(F.col("item").isNotNull()).select("lang", "source", "item", "value")
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(w).cast("int")
    out = [
        t.withColumn("rank", rank).where(limit).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
        for t, part, limit in ((pairs, "pair", F.lit(True)), (terms, "term", F.col("rank") <= ranks))
    ]
    return out[0].unionByName(out[1])
