"""Exact n-gram Jaccard join with skipping over positions, sizes and already answered sets.

A document's set holds the 64-bit hashes of its distinct n-word shingles (fewer words: one
shingle of them all). Sets link if 100 * |x and y| >= threshold * |x or y|.

1. Sets. One scan gives each document's set size and a 128-bit print of the set; equal prints
   are one class, whose smallest doc_id stands for it.
2. Order. Shingles of the documents' leading parts are counted exactly, and those of documents
   whose leading parts are mostly shared are counted to their end; the most frequent (bounded
   number) go last in the order of shingles, by count, the rest are ordered by hash. Any order
   gives the same links; this one keeps index lists short.
3. Lists. Two linked sets share a shingle among the first n - ceil(t n) + 1 of each. Each task
   emits these with position and size, once for each distinct set it meets; shingle lists that
   only one set stands in are dropped, the others go to the shared folder. A list of more than
   LIST_ROWS sets is dealt to slots by a hash of the set, so that no task holds a whole long list;
   those of the frequent shingles already when the entries are gathered.
4. Answers from similar sets. The first rounds only check each set with a few others of its
   lists, those that most lists propose: neighbours by size, and hubs, the sets with the fewest
   rare shingles of their own, which near copies have more in common with than with each other. A
   set that links takes its answer over from the other: they are in one component, and what links
   with one needs no check against the other's component. Copies so cost a few checks each.
5. Skipping. The last round looks for what is left: links between different components. A list
   of one component is skipped whole. In the others only sets outside the list's largest
   component look for partners. A list falls into blocks of one size, each in order of position;
   a block whose size can't link is skipped, and of the others only the sets are read whose
   position still leaves room for the needed overlap (the pair's first common shingle passes, so
   no link is lost). Of a list in slots, the sets outside its largest component visit all slots.
   No pair is checked twice.

Pairs are ruled out by an exact bound on a quarter of their shingles, or else verified by the
overlap of the whole sets. Shingles are compared by their 64-bit hashes: results are exact but
for accidental equality of two hashes within a pair of documents, whose chance is about
n m / 2^64 for sets of n and m shingles. Components come from components.components. The result
has one row per document.

Defined cases: null text, or text without words, has the empty set and links with nothing;
repeated rows of one doc_id are one node with several sets and give repeated rows; of very long
texts all shingles count; an empty table has no rows; columns of other names, or names that differ
only by case, fall away.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, batch_rows, by_place, column_place, doc_columns, released, stage
from .components import components

WORDS = 5
THRESHOLD = 80
HEAVY_COUNT = 4
HEAVY_TOKENS = 1 << 20
STAR_ROUNDS = 2
NEIGHBOURS = 2
HUBS = 2
PROPOSALS = 3
LIST_ROWS = 8192
BATCH_ROWS = 2048
PAIRS_AT_ONCE = 500_000
BROADCAST_IDS = 1_000_000
FLUSH_ROWS = 100_000
PIECE = 64
SMALL_SET = 256

_U = np.uint64
_BYTE = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=_U)
_R = _U(0x9E3779B97F4A7C15)
_MIX = [_U(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h = h * _MIX[0]
    h = h ^ (h >> _U(29))
    h = h * _MIX[1]
    return h ^ (h >> _U(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _P, _Q
    if len(_P) <= n:
        m = 1 << (n + 1).bit_length()
        inverse = _U(pow(int(_R), -1, 1 << 64))
        _P = np.concatenate([[_U(1)], np.cumprod(np.full(m, _R))])
        _Q = np.concatenate([[_U(1)], np.cumprod(np.full(m, inverse))])
    return _P, _Q


_P = _Q = np.ones(1, _U)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles. The texts are hashed together."""
    raw = [t.encode("utf-8") if t else b"" for t in texts]
    ends_at = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)  # a space after each text
    flat = _FOLD[np.frombuffer(b" ".join([*raw, b""]), np.uint8)]
    gap = np.empty(len(flat) + 1, bool)
    gap[0] = True
    np.take(_SPACE, flat, out=gap[1:])
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    power, inverse = _powers(len(flat))
    sums = np.empty(len(flat) + 1, _U)
    sums[0] = 0
    np.cumsum(_BYTE[flat] * power[: len(flat)], out=sums[1:])
    word = _mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U) * _MIX[5])
    first = np.concatenate([[0], np.searchsorted(starts, ends_at)])
    size = np.diff(first)
    h = np.full(len(word), _U(words))
    for i in range(words):
        h[: len(word) - i] = _mixed(h[: len(word) - i] * _MIX[2] + word[i:])
    out = []
    for d in range(len(texts)):
        a, n = int(first[d]), int(size[d])
        if n >= words:
            s = np.sort(h[a : a + n - words + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s if keep.all() else s[keep])
        elif n:
            x = np.full(1, _U(n))
            for i in range(n):
                x = _mixed(x * _MIX[2] + word[a + i : a + i + 1])
            out.append(x)
        else:
            out.append(np.empty(0, _U))
    return out


def needed(x, y, threshold: int = THRESHOLD):
    """Least overlap of linked sets of sizes x and y."""
    return -(-threshold * (x + y) // (100 + threshold))


def prefix_length(n: int, threshold: int = THRESHOLD) -> int:
    return n - -(-threshold * n // 100) + 1 if n else 0


def print_of(tokens: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _batched(ddl: str, spark, rows_of):
    target = arrow_schema(spark, ddl)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                piece = batch.slice(at, PIECE)
                cols = rows_of(piece)
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(cols, target)], schema=target)

    return released(run)


def sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n, mark): set size and print, in the shared folder."""

    def rows_of(piece):
        tokens = shingle_sets(piece.column(1).to_pylist(), words)
        return piece.column(0), [len(t) for t in tokens], [print_of(t) if len(t) else None for t in tokens]

    ddl = "doc_id bigint, n bigint, mark binary"
    return stage(docs.mapInArrow(_batched(ddl, docs.sparkSession, rows_of), ddl), "sets")


def _leading(n: int, threshold: int) -> int:
    return prefix_length(n, threshold) * 3 // 2 + 8


def _order(tokens: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The tokens in the order of shingles: rare ones by hash, then frequent ones by count."""
    known, counts = heavy
    if not len(known) or not len(tokens):
        return tokens
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    late = known[at] == tokens
    if not late.any():
        return tokens
    last = tokens[late]
    return np.concatenate([tokens[~late], last[np.lexsort((last, counts[at[late]]))]])


def _counted(docs: DataFrame, words: int, threshold: int, heavy=None) -> DataFrame:
    """(token, c): counts of the shingles of leading parts, or, if heavy is given, of the rest of those documents with many frequent ones."""
    target = arrow_schema(docs.sparkSession, "token bigint")

    def run(batches):
        known = None if heavy is None else heavy.value[0]
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                parts = [np.empty(0, _U)]
                for s in shingle_sets(batch.slice(at, PIECE).column(1).to_pylist(), words):
                    k = _leading(len(s), threshold)
                    if known is None:
                        parts.append(s[:k])
                    elif len(known) and 4 * _shared(known, s[:k]) > min(k, len(s)):
                        parts.append(s[k:])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64))], schema=target)

    return docs.mapInArrow(released(run), "token bigint").groupBy("token").agg(F.count("*").alias("c")).filter(F.col("c") >= HEAVY_COUNT)


def _most(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, at most HEAVY_TOKENS, and their counts, sorted by token.

    They are those of at least the least count (in steps of 1/16 of its power of two) for which there aren't more,
    found from a histogram of the counts.
    """
    counts = stage(counts, "counts")
    step = F.floor(F.log2("c") * 16).cast("int")
    left, least = HEAVY_TOKENS, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("tokens")).collect(), key=lambda r: -r["step"]):  # some hundred rows
        left -= r["tokens"]
        if left < 0:
            break
        least = r["step"]
    if least is None:
        return np.empty(0, _U), np.empty(0, np.int32)
    top = counts.filter(step >= least).select("token", F.least("c", F.lit(2**31 - 1)).cast("int").alias("c")).toArrow()
    token, count = (top.column(i).to_numpy() for i in range(2))
    order = np.argsort(token.view(_U))
    return token.view(_U)[order], count[order]


def frequent(docs: DataFrame, words: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent shingles, sorted, and their counts; at most HEAVY_TOKENS, which bounds the broadcast."""
    first = _most(_counted(docs, words, threshold))
    if not len(first[0]):
        return first
    shared = docs.sparkSession.sparkContext.broadcast(first)
    more = _most(_counted(docs, words, threshold, shared))
    token, count = (np.concatenate([x, y]) for x, y in zip(first, more))
    order = np.lexsort((-count, token))
    token, count = token[order], count[order]
    once = np.concatenate([[True], token[1:] != token[:-1]])
    token, count = token[once], count[once]
    if len(token) > HEAVY_TOKENS:
        kept = np.sort(np.lexsort((token, -count))[:HEAVY_TOKENS])
        token, count = token[kept], count[kept]
    return token, count


def lists(docs: DataFrame, heavy, words: int, threshold: int, list_rows: int = LIST_ROWS) -> DataFrame:
    """Index entries (token, doc_id, n, pos, twin) of lists that hold more than one set, in the shared folder.

    twin is a 64-bit print of the set: entries with the same n and twin are one set. Lists of tokens that are known
    to stand in more than list_rows leading parts are dealt to parts by the set's print from the start, and stay
    whatever they hold; of the others a task sees one list after another and holds no more of it than the
    entries of its first set.
    """
    spark = docs.sparkSession
    ddl = "token bigint, doc_id bigint, n int, pos int, twin bigint, part int"
    target = arrow_schema(spark, ddl)

    def emit(batches):
        seen: set = set()
        last = heavy.value
        hot = last[1] > list_rows
        tokens, parts = last[0][hot], (last[1][hot] // list_rows + 1).astype(np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                cols: list[list] = [[], [], [], [], [], []]
                piece = batch.slice(at, PIECE)
                for d, s in zip(piece.column(0).to_pylist(), shingle_sets(piece.column(1).to_pylist(), words)):
                    n = len(s)
                    if not n or d is None:
                        continue
                    mark = print_of(s)
                    if mark in seen:
                        continue
                    seen.add(mark)
                    p = prefix_length(n, threshold)
                    own = _order(s, last)[:p]
                    twin = int.from_bytes(mark[:8], "little", signed=True)
                    part = np.zeros(p, np.int64)
                    if len(tokens):
                        i = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
                        part = np.where(tokens[i] == own, 1 + twin % parts[i], 0)
                    for c, x in zip(cols, (own, np.full(p, d), np.full(p, n), np.arange(p), np.full(p, twin), part)):
                        c.append(x)
                if cols[0]:
                    flat = [np.concatenate(c) for c in cols]
                    flat[0] = flat[0].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(flat, target)], schema=target)

    def shared(batches):
        """Drops lists of a single set; a list may go on in the next batch."""
        held: list = []  # entries of the last list so far, as long as they are of one set
        last = first = None  # its token; its first set, or None once another one has come
        for batch in batches:
            if not batch.num_rows:
                continue
            token, twin, part = (batch.column(i).to_numpy() for i in (0, 4, 5))
            new = np.concatenate([[True], token[1:] != token[:-1]])
            start = np.flatnonzero(new)
            other = (twin != twin[start][np.cumsum(new) - 1]) | (part > 0)
            many = np.add.reduceat(other.astype(np.int64), start) > 0
            goes_on = token[0] == last
            if goes_on:
                if first is None:
                    many[0] = True
                elif many[0] or twin[0] != first:
                    yield from held
                    many[0] = True
                elif len(start) == 1:
                    held.append(batch)
                    continue
                else:
                    many[0] = False
            keep = np.repeat(many, np.diff(np.append(start, len(token))))
            tail = int(start[-1])
            alone = not many[-1]
            out = batch.filter(pa.array(keep))
            if out.num_rows:
                yield out
            last, first = token[-1], twin[tail] if alone else None
            held = [batch.slice(tail)] if alone else []

    entries = docs.mapInArrow(released(emit), ddl).repartition("token", "part").sortWithinPartitions("token", "part", "n", "doc_id")
    return stage(entries.mapInArrow(released(shared), ddl).drop("part"), "lists")


ENTRY = ("token", "slot", "n", "doc_id", "pos", "twin", "label")


def in_slots(labelled: DataFrame, long: DataFrame | None, list_rows: int, visits: bool) -> DataFrame:
    """Entries with slot, guest and top; long: (token, slots) of the long lists, or None.

    visits: of long lists, entries that aren't of the list's largest component (top) also go to
    all other slots, as guests. For other lists top is null.
    """
    top = F.lit(None).cast("bigint")
    plain = labelled.withColumns({"slot": F.lit(0), "guest": F.lit(False), "top": top})
    if long is None:
        return plain
    held = F.broadcast(long) if long.count() <= BROADCAST_IDS else long
    dealt = labelled.join(held, "token").withColumn("slot", F.pmod(F.xxhash64("doc_id", "token"), F.col("slots")).cast("int"))
    rest = labelled.join(held, "token", "left_anti").withColumns({"slot": F.lit(0), "guest": F.lit(False), "top": top})
    names = rest.columns
    if not visits:
        return rest.unionByName(dealt.withColumns({"guest": F.lit(False), "top": top}).select(names))
    tops = dealt.groupBy("token", "label").agg(F.count("*").alias("c")).groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("top"))
    tops = stage(tops, "tops")
    dealt = dealt.join(F.broadcast(tops) if tops.count() <= BROADCAST_IDS else tops, "token").withColumn("guest", F.lit(False))
    guests = dealt.filter("label <> top").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).filter("at <> slot")
    guests = guests.withColumn("slot", F.col("at").cast("int")).withColumn("guest", F.lit(True))
    return rest.unionByName(dealt.select(names)).unionByName(guests.select(names))


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (count[i] numbers), for all i."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def few_pairs(entries: dict[str, np.ndarray], threshold: int):
    """(asks, whom) of some pairs of every list: with the sets before and behind in order of size, and with the hubs."""
    n, doc, pos, twin, label = (entries[k] for k in ("n", "doc_id", "pos", "twin", "label"))
    start = _starts(entries["token"], entries["slot"])
    size = np.diff(np.append(start, len(n)))
    of, every = np.repeat(np.arange(len(start)), size), np.arange(len(n))
    rank = every - start[of]
    asks, whom = [], []

    def keep(i, j):
        ok = (label[i] != label[j]) & ((twin[i] != twin[j]) | (n[i] != n[j])) & (doc[i] != doc[j])
        ok &= threshold * np.maximum(n[i], n[j]) <= 100 * np.minimum(n[i], n[j])
        ok &= np.minimum(n[i] - pos[i], n[j] - pos[j]) >= needed(n[i], n[j], threshold)
        asks.append(doc[i[ok]])
        whom.append(doc[j[ok]])

    order = np.lexsort((doc, pos, of))
    for place in range(HUBS):
        keep(every, order[start + np.minimum(place, size - 1)][of])
    for k in range(1, NEIGHBOURS + 1):
        live = every[rank >= k]
        keep(live, live - k)
        keep(live - k, live)
    yield np.concatenate(asks), np.concatenate(whom)


def all_pairs(entries: dict[str, np.ndarray], threshold: int):
    """(a, b) of every pair of a list that may link and isn't of one component, skipping blocks by size and position."""
    token, slot, n, doc, pos, twin, label, guest, top, long = (entries[k] for k in (*ENTRY, "guest", "top", "long"))
    start = _starts(token, slot)
    of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(token))))
    # The largest component of each list.
    order = np.lexsort((label, of))
    at = _starts(of[order], label[order])
    count = np.diff(np.append(at, len(order)))
    best = np.lexsort((count, of[order][at]))
    best = best[np.append(np.flatnonzero(np.diff(of[order][at][best])), len(best) - 1)]
    largest = np.where(long, top, label[order][at[best]][of])
    asks = label != largest
    mixed = np.zeros(len(start), bool)
    mixed[of[asks]] = True
    live = np.flatnonzero(mixed[of])
    if not len(live):
        return
    # Own entries in blocks of one list and size, by position.
    own = live[~guest[live]]
    own = own[np.lexsort((doc[own], pos[own], n[own], of[own]))]
    if not len(own):
        return
    block = _starts(of[own], n[own])
    blocks = np.diff(np.append(block, len(own)))
    number = np.repeat(np.arange(len(block)), blocks)
    wide = int(pos.max()) + 2
    key = number * wide + pos[own]
    list_of = of[own][block]
    place = np.full(len(token), len(token))
    place[own] = np.arange(len(own))

    who = np.flatnonzero(asks)
    lo, hi = np.searchsorted(list_of, of[who], "left"), np.searchsorted(list_of, of[who], "right")
    done = 0
    steps = np.cumsum(hi - lo)
    while done < len(who):
        upto = max(done + 1, int(np.searchsorted(steps, (steps[done - 1] if done else 0) + PAIRS_AT_ONCE, "right")))
        i = np.repeat(who[done:upto], (hi - lo)[done:upto])
        b = _runs(lo[done:upto], (hi - lo)[done:upto])
        done = upto
        size = n[own][block][b]
        least = needed(n[i], size, threshold)
        fits = (threshold * np.maximum(n[i], size) <= 100 * np.minimum(n[i], size)) & (n[i] - pos[i] >= least)
        i, b, room = i[fits], b[fits], (size - least)[fits]
        upper = np.searchsorted(key, b * wide + np.minimum(room, wide - 1), "right")
        count = np.maximum(upper - block[b], 0)
        sums = np.cumsum(count)
        first = 0
        while first < len(i):
            last = max(first + 1, int(np.searchsorted(sums, (sums[first - 1] if first else 0) + PAIRS_AT_ONCE, "right")))
            x = np.repeat(i[first:last], count[first:last])
            y = own[_runs(block[b[first:last]], count[first:last])]
            first = last
            ok = (label[x] != label[y]) & ((twin[x] != twin[y]) | (n[x] != n[y])) & (doc[x] != doc[y])
            ok &= guest[x] | ~asks[y] | (place[x] < place[y])  # both ask: once
            if ok.any():
                yield doc[x[ok]], doc[y[ok]]


def candidates(entries: DataFrame, star: bool, threshold: int) -> DataFrame:
    """Pairs (a, b, votes) to verify from entries that in_slots() gives.

    star: few_pairs(), directed; otherwise all_pairs(), a < b.
    """
    spark = entries.sparkSession
    target = arrow_schema(spark, "a bigint, b bigint, votes bigint")
    names = (*ENTRY, "guest", "top", "long")

    def run(batches):
        def counted(a, b):
            if not star:
                a, b = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = _starts(a, b)
            return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(np.diff(np.append(new, len(a))))], schema=target)

        def flush(done):
            cols = {k: np.concatenate([x[i] for x in done]) for i, k in enumerate(names)}
            for a, b in (few_pairs if star else all_pairs)(cols, threshold):
                if len(a):
                    yield counted(a, b)

        held: list = []
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))]
            if not len(cols[0]):
                continue
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            cut = int(np.searchsorted(last, True))
            if cut and sum(len(h[0]) for h in held) + cut >= FLUSH_ROWS:
                yield from flush([*held, [c[:cut] for c in cols]])
                held = []
                cols = [c[cut:] for c in cols]
            held.append(cols)
        if held:
            yield from flush(held)

    entries = entries.withColumn("long", F.col("top").isNotNull()).withColumn("top", F.coalesce("top", "label"))
    ordered = entries.select(*names).repartition("token", "slot").sortWithinPartitions("token", "slot", "n", "doc_id")
    return ordered.mapInArrow(released(run), "a bigint, b bigint, votes bigint")


def verified(docs: DataFrame, pairs: DataFrame, words: int, threshold: int) -> DataFrame:
    """Those of the staged pairs (a, b) whose whole sets link.

    First on a quarter of the shingles (all of them for small sets): linked sets differ in at
    most a ninth of their summed sizes, so more differences than that among the shingles of one
    range of hashes already rule the link out. Half a hash is enough for this, since an
    accidental match only adds overlap.
    """

    def part(tokens):
        q = int(np.searchsorted(tokens, _U(1 << 62)))
        held = tokens if len(tokens) <= SMALL_SET else tokens[:q]
        return len(tokens), q, np.unique((held >> _U(32)).astype(np.uint32)).tobytes()

    def rows_of(piece):
        got = [part(t) for t in shingle_sets(piece.column(1).to_pylist(), words)]
        return piece.column(0), [g[0] for g in got], [g[1] for g in got], [g[2] for g in got]

    def maybe(piece):
        a, b, n, q, x, m, r, y = (piece.column(i).to_pylist() for i in range(8))
        keep = []
        for i in range(len(a)):
            u, v = np.frombuffer(x[i], np.uint32), np.frombuffer(y[i], np.uint32)
            if n[i] <= SMALL_SET and m[i] <= SMALL_SET:
                in_u, in_v = n[i], m[i]
            else:  # the range that both have
                in_u, in_v = q[i], r[i]
                u, v = (t[: np.searchsorted(t, np.uint32(1 << 30))] for t in (u, v))
            both = min(_shared(u, v) + in_u - len(u) + in_v - len(v), in_u, in_v)  # at most
            keep.append(in_u + in_v - 2 * both <= n[i] + m[i] - 2 * needed(n[i], m[i], threshold))
        return piece.column(0), piece.column(1), keep

    def whole(piece):
        return piece.column(0), [t.tobytes() for t in shingle_sets(piece.column(1).to_pylist(), words)]

    def check(piece):
        keep = []
        for x, y in zip(piece.column(2).to_pylist(), piece.column(3).to_pylist()):
            u, v = np.frombuffer(x, _U), np.frombuffer(y, _U)
            both = _shared(u, v)
            keep.append(100 * both >= threshold * (len(u) + len(v) - both))
        return piece.column(0), piece.column(1), keep

    left = _with_sets(docs, pairs, "doc_id bigint, n bigint, q bigint, tokens binary", rows_of, "a bigint, b bigint, fine boolean", maybe, "quarters")
    left = stage(left, "likely")
    return _with_sets(docs, left, "doc_id bigint, tokens binary", whole, "a bigint, b bigint, fine boolean", check, "members")


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    if not len(x) or not len(y):
        return 0
    return int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())


def _with_sets(docs, pairs, set_ddl: str, make, out_ddl: str, check, name: str) -> DataFrame:
    """The pairs for which check holds; it gets the pair and what make says of both documents."""
    spark = docs.sparkSession
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # The texts stay where they are while the ids are few enough to be sent to them.
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    held = stage(docs.join(ids, "doc_id", "left_semi").mapInArrow(_batched(set_ddl, spark, make), set_ddl), name)
    own = [c for c in held.columns if c != "doc_id"]
    side = lambda s: held.select(F.col("doc_id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in own])
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", *[f"{s}_{c}" for s in "ab" for c in own])
    return joined.mapInArrow(_batched(out_ddl, spark, check), out_ddl).filter("fine").select("a", "b")


def release(spark) -> None:
    """Lets Spark drop the shuffle files of steps that are over."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def similarity_components(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, list_rows: int = LIST_ROWS) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    with batch_rows(docs.sparkSession, BATCH_ROWS):
        return _components(docs, words, threshold, list_rows)


def _components(docs: DataFrame, words: int, threshold: int, list_rows: int) -> DataFrame:
    spark = docs.sparkSession
    docs = doc_columns(docs, "doc_id", "text")
    own = sets(docs, words)
    # The smallest doc_id of each set, and of each doc_id that repeats with other texts. The table of
    # copies is written, so that the join's hot prints can be split.
    classes = own.filter("mark is not null").groupBy("mark").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    copies = stage(classes.filter("copies > 1").select("mark", "rep"), "copies")
    full = own.filter("mark is not null").join(copies, "mark", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    reps = stage(full.unionByName(own.filter("mark is null").select("doc_id", "n", F.col("doc_id").alias("rep"))), "reps")
    heavy = spark.sparkContext.broadcast(frequent(docs, words, threshold))
    entries = lists(docs, heavy, words, threshold, list_rows)
    release(spark)
    # Repeated doc_ids are one node: their sets' classes hang together.
    again = reps.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high")
    links = stage(
        reps.join(again.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).filter("u <> v").distinct(), "links"
    )
    long = stage(entries.groupBy("token").agg(F.count("*").alias("rows")).filter(F.col("rows") > list_rows).select("token", F.ceil(F.col("rows") / list_rows).cast("int").alias("slots")), "long")
    long = None if long.isEmpty() else long
    listed = entries.select("doc_id").distinct()
    home = stage(reps.join(listed, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("rep").alias("rep")), "homes")
    seen = None
    for step in range(STAR_ROUNDS + 1):
        labels = components(links) if step and not links.isEmpty() else None
        label = home.withColumn("label", F.col("rep"))
        if labels is not None:
            label = home.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep"))
        moved = stage(label.filter("label <> doc_id").select("doc_id", "label"), "labels")  # the others are their own
        moved = F.broadcast(moved) if moved.count() <= BROADCAST_IDS else moved
        labelled = entries.join(moved, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
        star = step < STAR_ROUNDS
        pairs = candidates(in_slots(labelled, long, list_rows, not star), star, threshold)
        if star:  # each set with those that most lists propose
            w = Window.partitionBy("a").orderBy(F.desc("votes"), "b")
            pairs = pairs.groupBy("a", "b").agg(F.sum("votes").alias("votes"))
            pairs = pairs.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= PROPOSALS)
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = pairs.select("a", "b").distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = stage(pairs.select("a", "b"), "pairs")
        if pairs.isEmpty():
            continue
        seen = pairs if seen is None else seen.unionByName(pairs)
        found = verified(docs, pairs, words, threshold).select("a", "b")
        ends = home.select("doc_id", "rep")
        found = found.join(ends.select(F.col("doc_id").alias("a"), F.col("rep").alias("u")), "a").join(ends.select(F.col("doc_id").alias("b"), F.col("rep").alias("v")), "b")
        links = stage(links.unionByName(found.select("u", "v")), "links")
        release(spark)
    out = reps.select("doc_id", F.col("n").alias("n_shingles"), "rep")
    if links.isEmpty():
        return out.select("doc_id", "n_shingles", F.col("rep").alias("component_id"))
    final = components(links).withColumnRenamed("node", "rep")
    return out.join(final, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def with_ids(docs: DataFrame, name: str) -> tuple[DataFrame, DataFrame] | None:
    """docs with ids of their own for rows whose id is null, and these ids; None where no id is null."""
    bare = docs.filter(F.col(name).isNull())
    if bare.isEmpty():
        return None
    kind = docs.schema[name].dataType
    place = F.monotonically_increasing_id()
    high = docs.agg(F.max(name)).first()[0]
    for salt in range(100):
        # Beyond all ids, so that documents with ids stand for their groups; else by hash, where no id is met.
        own = F.lit(-1 if high is None else high) + 1 + place if (high or 0) < 1 << 62 else F.xxhash64(place, F.lit(salt))
        given = stage(bare.withColumn(name, own.cast("bigint")), "given")  # the ids must not change from scan to scan
        if given.join(docs.select(F.col(name).cast("bigint").alias(name)), name, "left_semi").isEmpty():
            break
    else:
        raise ValueError("no free ids")
    all_rows = docs.filter(F.col(name).isNotNull()).withColumn(name, F.col(name).cast("bigint")).unionByName(given)
    return all_rows, given.select(F.col(name).alias("given"), F.lit(None).cast(kind).alias("none"))


def one_of_each(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each component, that of the smallest doc_id; all columns as they are.

    A document without a doc_id is a document of its own, which goes if it links with another one
    that stays: one with a doc_id where there is one. Rows of one doc_id are one document, whatever
    their texts; the smallest row of them, column by column, stays.
    """
    given_names, texts = docs.columns, f"c{column_place(docs, 'text')}"
    name, docs = f"c{column_place(docs, 'doc_id')}", by_place(docs)
    kind = docs.schema[name].dataType
    named = with_ids(docs, name)
    every = docs if named is None else named[0]
    found = similarity_components(every.select(F.col(name).alias("doc_id"), F.col(texts).alias("text")), words, threshold)
    # Those that go, and those of more than one row: the few ids that the texts need to meet.
    kept = F.min(F.col("doc_id") == F.col("component_id"))
    odd = stage(found.groupBy(F.col("doc_id").alias(name)).agg(F.count("*").alias("rows"), kept.alias("kept")).filter("rows > 1 or not kept"), "odd")
    few = odd.count() <= BROADCAST_IDS
    out = every.join(F.broadcast(odd.select(name)) if few else odd.select(name), name, "left_anti").select(*docs.columns)
    repeated = odd.filter("kept").select(name)
    if not repeated.isEmpty():
        rows = every.join(F.broadcast(repeated) if few else repeated, name, "left_semi")
        least = rows.groupBy(F.col(name).alias("of")).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
        out = out.unionByName(least)
    if named is not None:
        given = named[1]
        out = out.join(given, out[name] == given["given"], "left").withColumn(name, F.when(F.col("given").isNull(), F.col(name)).cast(kind)).select(*docs.columns)
    return out.toDF(*given_names)
