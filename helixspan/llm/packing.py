"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of its documents' ids. In every window a queue may send its quantum (its
target share of the window) plus the deficit left from the windows before; what a whole number
of tokens can't express is carried on, across windows and across the partitions that hold parts
of a queue. Because a queue is served in order and without gaps, what queue q has sent after t
tokens in all is a closed formula, S_q(t): so each document finds its windows from its own place
in its queue alone, and no task has to run the rounds one after another. When a queue runs dry,
its share goes to the others in proportion to their weights: queues run dry in the order of tokens
by weight, so with k of them dry, S_q(t) = floor(w_q * (t - N_k) / W_k), where N_k is what the dry ones
had and W_k the weight of the others, both prefix sums in that order. It is one rule for any number of
sources. quantum() and deficit() show a round's terms; tests hold the formula against rounds run one by one.

Windows follow each other without gaps and are cut every `capacity` tokens, so only the very
last sequence has padding. The targets are given as weights, or are the queues' sizes raised to
`temperature`: 1 keeps the corpus' own proportions in every window, less raises small sources.

Plan: one scan encodes the texts and writes (part, queue, place in the part's queue, ids) to the
shared folder; sums by (part, queue) give each part's place in each queue; a join (a broadcast
while the sums are few, else a shuffle) brings them to the documents.

Defined cases: null text is the empty text (its document is the end id alone); null source is a
queue of its own; very long texts are cut into pieces; repeated rows are separate documents; an
empty table has no pieces; columns of other names, or names that differ only by case, fall away.

Every source is a queue, however many there are. The driver and the tasks hold one name, total and
weight for each source, and a task a window's totals for some windows, as arrays.
"""
from __future__ import annotations

import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, doc_columns, released, stage, tokenizer_path
from .tokens import CACHE_BYTES, encoder, lots

CAPACITY = 1024
WINDOW = 64 * CAPACITY
END_ID = 0
HELD_NUMBERS = 8_000_000
BROADCAST_SUMS = 200_000
NO_SOURCE = ""


class Stage:
    """Queues that are served together from token `begin` of the stream on, each by its weight."""

    def __init__(self, places: np.ndarray, totals: np.ndarray, weights: np.ndarray, begin: int):
        self.places, self.begin = places, begin
        # In the order in which they run dry: by totals over weights, compared as fractions.
        order = np.array(sorted(range(len(places)), key=lambda i: Fraction(int(totals[i]), int(weights[i]))), np.int64)
        self.totals, self.weights = totals, weights
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.dry = [0, *np.cumsum(totals[order]).tolist()]  # what the first k queues have
        self.alive = [*(np.cumsum(weights[order][::-1])[::-1]).tolist(), 0]  # weights of the others
        self.order = order.tolist()
        self.end = begin + self.dry[-1]

    def phase(self, t: int) -> int:
        """How many queues have run dry when t tokens of the stage are sent."""
        lo, hi = 0, len(self.order)
        while lo < hi:
            mid = (lo + hi) // 2
            i = self.order[mid]
            # Queue i is dry at t if (t - dry) / alive >= total / weight, with mid queues dry before it.
            if (t - self.dry[mid]) * int(self.weights[i]) >= self.alive[mid] * int(self.totals[i]):
                lo = mid + 1
            else:
                hi = mid
        return lo

    def served(self, t: int) -> np.ndarray:
        """What each queue has sent after t tokens of the stream."""
        t = min(max(t - self.begin, 0), self.dry[-1])
        k = self.phase(t)
        if k == len(self.order):
            return self.totals
        p, over = t - self.dry[k], self.alive[k]
        # floor(w * p / over): a floating estimate is off by one at most, which the remainder shows (modulo 2^64).
        x = np.minimum(np.floor(self.weights * (p / over)), self.totals).astype(np.int64)
        left = (self.weights.astype(np.uint64) * np.uint64(p) - x.astype(np.uint64) * np.uint64(over)).astype(np.int64)
        x += (left >= over).astype(np.int64) - (left < 0)
        return np.where(self.rank < k, self.totals, np.minimum(x, self.totals))

    def one(self, i: int, t: int) -> int:
        """The same for one queue."""
        t = min(max(t - self.begin, 0), self.dry[-1])
        k = self.phase(t)
        if k > self.rank[i]:
            return int(self.totals[i])
        return min(int(self.totals[i]), int(self.weights[i]) * (t - self.dry[k]) // self.alive[k])


class Rounds:
    """The served totals of deficit round-robin as a function of the tokens sent in all.

    Queues with a weight are served first, then those of weight 0, each alike. Weights are scaled
    down together if they are beyond 31 bits, to 1 at least.
    """

    def __init__(self, totals: dict[str, int], weights: dict[str, int] | None = None, window: int = WINDOW):
        self.names = sorted(q for q, n in totals.items() if n > 0)
        self.place = {q: i for i, q in enumerate(self.names)}
        self.totals = np.array([totals[q] for q in self.names], np.int64)
        self.window = window
        self.end = int(self.totals.sum())
        given = [int((weights or {}).get(q, 0)) for q in self.names] if weights else self.totals.tolist()
        scale = max(1, -(-max(given, default=0) >> 31))
        self.weights = np.array([max(1, w // scale) if w > 0 else 0 for w in given], np.int64)
        self.stages: list[Stage] = []
        begin = 0
        for chosen, own in ((self.weights > 0, self.weights), (self.weights == 0, np.ones(len(given), np.int64))):
            at = np.flatnonzero(chosen)
            if len(at):
                self.stages.append(Stage(at, self.totals[at], own[at], begin))
                begin = self.stages[-1].end
        self.stage_of = {int(q): (s, i) for s in self.stages for i, q in enumerate(s.places)}
        self.known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def served(self, t: int) -> np.ndarray:
        out = np.zeros(len(self.names), np.int64)
        for s in self.stages:
            if t > s.begin:
                out[s.places] = s.served(t)
        return out

    def served_of(self, q: int, t: int) -> int:
        s, i = self.stage_of[q]
        return s.one(i, t)

    def quantum(self, w: int, q: int) -> Fraction:
        """Tokens that queue q is due in window w, as long as no queue runs dry in it."""
        s, i = self.stage_of[q]
        return Fraction(self.window * int(s.weights[i]), s.alive[s.phase(w * self.window - s.begin)])

    def deficit(self, w: int, q: int) -> Fraction:
        """What queue q carries from window w to the next one: less than a token."""
        s, i = self.stage_of[q]
        t = (w + 1) * self.window - s.begin
        k = s.phase(t)
        return Fraction(int(s.weights[i]) * (t - s.dry[k]), s.alive[k]) - self.served_of(q, (w + 1) * self.window)

    def at(self, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of window w, by queue: served before it, served after it, place of its part in the whole stream."""
        if w not in self.known:
            if len(self.known) > max(2, HELD_NUMBERS // max(1, 3 * len(self.names))):
                self.known.clear()
            a, b = self.served(w * self.window), self.served((w + 1) * self.window)
            self.known[w] = a, b, int(a.sum()) + np.cumsum(b - a) - (b - a)
        return self.known[w]

    def first_window(self, q: int, x: int) -> int:
        """The window that sends token x of queue q."""
        lo, hi = 0, 1
        while self.served_of(q, hi * self.window) <= x:
            lo, hi = hi, 2 * hi
        while lo < hi:
            mid = (lo + hi) // 2
            if self.served_of(q, (mid + 1) * self.window) > x:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def pieces(self, queue: str, start: int, length: int, guess: list, capacity: int = CAPACITY):
        """(offset in the document, length, place in the whole stream) for each piece.

        guess: a list holding the window where the document before this one ended, or nothing.
        """
        q, x, end = self.place[queue], start, start + length
        w = guess[0] if guess and self.at(guess[0])[0][q] <= x else self.first_window(q, x)
        while x < end:
            a, b, places = self.at(w)
            if b[q] <= x:
                w += 1
                continue
            take = min(end, int(b[q])) - x
            place = int(places[q]) + x - int(a[q])
            while take:
                n = min(take, capacity - place % capacity)
                yield x - start, n, place
                x, take, place = x + n, take - n, place + n
        guess[:] = [w]


def encode_queues(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Rows (part, queue, doc_id, local, n_tokens, ids) in the shared folder; ids are zstd frames of u16."""
    vocabulary = vocabulary or tokenizer_path("byte_bpe_50k.json")
    docs = doc_columns(docs, "doc_id", "source", "text")
    queue = F.coalesce("source", F.lit(NO_SOURCE))
    ddl = "part int, queue string, doc_id bigint, local bigint, n_tokens bigint, ids binary"
    target = arrow_schema(docs.sparkSession, ddl)

    def run(batches):
        part, sent = TaskContext.get().partitionId(), {}
        enc, pack = encoder(vocabulary, False, end_id, cache_bytes), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for at, rows in lots(batch.column(2)):
                piece = batch.slice(at, rows)
                queues = piece.column(1).to_pylist()
                ids, sizes = enc.encode(piece.column(2).to_pylist())
                ends = np.cumsum(sizes).tolist()
                local, frames = [], []
                for q, a, b in zip(queues, [0, *ends], ends):
                    local.append(sent.get(q, 0))
                    sent[q] = local[-1] + b - a
                    frames.append(pack(ids[a:b].astype("<u2").tobytes()))
                cols = [[part] * len(frames), queues, piece.column(0), local, sizes.tolist(), frames]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) if isinstance(v, list) else v for v, f in zip(cols, target)], schema=target)

    return stage(docs.select("doc_id", queue.alias("queue"), "text").mapInArrow(released(run), ddl), "packing")


def pack(
    docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, window: int = WINDOW,
    weights: dict[str, int] | None = None, with_ids: bool = False, temperature: float = 1.0, cache_bytes: int = CACHE_BYTES,
) -> DataFrame:
    """Pieces of documents with their places in sequences; with_ids adds each piece's ids (u16 bytes). cache_bytes: of a task's cache of encoded pieces."""
    spark = docs.sparkSession
    encoded = encode_queues(docs, vocabulary, end_id, cache_bytes)
    sums = encoded.groupBy("part", "queue").agg(F.sum("n_tokens").alias("n"))
    totals = {r["queue"]: r["n"] for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # a row for each source
    if weights is None and temperature != 1:
        weights = {q: max(1, round(1000 * n**temperature)) for q, n in totals.items()}
    before = F.sum("n").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.select("part", "queue", F.coalesce(before, F.lit(0)).alias("base"))
    rounds = Rounds(totals, weights, window)
    ddl = (
        "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
        "offset bigint, queue string" + (", ids binary" if with_ids else "")
    )
    target = arrow_schema(spark, ddl)

    def run(batches):
        unpack, guesses = zstandard.ZstdDecompressor().decompress, {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = []
                for d, q, x, n, frame in zip(*(batch.slice(at, 1024).column(i).to_pylist() for i in range(5))):
                    ids = np.frombuffer(unpack(frame), "<u2").astype("<u4")
                    for off, size, place in rounds.pieces(q, x, n, guesses.setdefault(q, []), capacity):
                        own = ids[off : off + size]
                        row = (d, off, size, zlib.crc32(own.tobytes()), n, place // capacity, place % capacity, q)
                        rows.append(row + (own.astype("<u2").tobytes(),) if with_ids else row)
                cols = list(zip(*rows)) if rows else [[]] * len(target)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, target)], schema=target)

    # The texts' ids stay where they are while the sums (tasks x queues rows) are few.
    bases = F.broadcast(bases) if sums.count() <= BROADCAST_SUMS else bases
    placed = encoded.join(bases, ["part", "queue"]).select(
        "doc_id", "queue", (F.col("base") + F.col("local")).alias("place"), "n_tokens", "ids"
    )
    return placed.mapInArrow(released(run), ddl)
