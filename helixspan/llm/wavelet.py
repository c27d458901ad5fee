"""Token ids as wavelet matrices, one compressed file image per shard.

A shard's ids are stored as bit-planes, highest bit first; each plane is ordered by a stable
partition on the planes before it. With the planes go cumulative counts of ones, so that
access, rank (count of a token before a place), select (place of a token's k-th occurrence,
by binary search in the counts) and listing of occurrences need only the planes; and the planes
are compressed in blocks, of which a query unpacks those it touches. A document is a span of its
shard.

write() deals the documents into ranges of doc_id, sorts each range and streams it into
shards. Each shard is one file, through Spark's committer into a shared folder: a row (part,
shard, base, n_tokens, n_docs, image) whose image is self-contained, of the format below.
read() opens the images and gives the ids back by document.

Image: b"WVM2", then little-endian: u8 bits, u32 n_docs, u64 n_tokens, doc_ids i64[n_docs]
(the null id is the smallest i64), lengths u64[n_docs], zeros u64[bits], then for each plane
the counts of ones before every 512th bit as u32 length and a zstd frame, and its packed bits in
blocks of BLOCK_BYTES, as u32 length[blocks] and a zstd frame for each.

Defined cases: null text is the empty text; a document with a null id comes first; rows that
share a doc_id stay separate documents, in order of their text; very long texts make one long
shard; an empty table has no shards; columns of other names, or names that differ only by case,
fall away.
"""
from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, doc_columns, tokenizer_path, work_dir
from .tokens import encoder, lots

MAGIC = b"WVM2"
BITS = 16
STEP = 512
SHARD_TOKENS = 1 << 22
#: A task's cache of encoded words: texts that are dealt by doc_id share few of their rare ones.
CACHE_BYTES = 320 << 20
BLOCK_BYTES = 1 << 14
END_ID = 1
NULL_ID = -(1 << 63)


class Plane:
    """The bytes of a plane in compressed blocks, each unpacked when it is first asked for."""

    def __init__(self, frames: list[bytes], size: int):
        self.frames, self.size = frames, size
        self.blocks: dict[int, np.ndarray] = {}

    def block(self, i: int) -> np.ndarray:
        if i not in self.blocks:
            self.blocks[i] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.frames[i]), np.uint8)
        return self.blocks[i]

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        at = np.asarray(at, np.int64)
        out, number = np.empty(at.shape, np.uint8), at // BLOCK_BYTES
        for i in np.unique(number).tolist():
            own = number == i
            out[own] = self.block(i)[at[own] - i * BLOCK_BYTES]
        return out

    def whole(self) -> np.ndarray:
        return np.concatenate([np.empty(0, np.uint8), *(self.block(i) for i in range(len(self.frames)))])


class Packed:
    """A plane that isn't compressed."""

    def __init__(self, data: np.ndarray):
        self.data, self.size = data, len(data)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.data[at]

    def whole(self) -> np.ndarray:
        return self.data


class WaveletMatrix:
    """Planes of packed bits with counts of ones; ids below 2 ** bits."""

    def __init__(self, planes: list, ones: list[np.ndarray], zeros: np.ndarray, n: int):
        self.planes, self.ones, self.zeros, self.n = planes, ones, zeros, n
        self.bits = len(planes)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int = BITS) -> "WaveletMatrix":
        planes, ones, zeros = [], [], np.zeros(bits, np.uint64)
        cur = ids
        for k in range(bits):
            bit = (cur & cur.dtype.type(1 << (bits - 1 - k))) != 0
            packed = np.packbits(bit, bitorder="little")
            planes.append(Packed(packed))
            ones.append(_step_counts(packed))
            none = np.flatnonzero(~bit)  # places are several times faster than masks
            zeros[k] = len(none)
            cur = np.concatenate([cur[none], cur[np.flatnonzero(bit)]])
        return cls(planes, ones, zeros, len(ids))

    def _bit(self, k: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[k][at >> 3] >> (at & 7).astype(np.uint8)) & 1

    def _ones_before(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones of plane k before each place: the stored count, then whole bytes, then bits."""
        block = at // STEP
        out = self.ones[k][block].astype(np.int64)
        plane = self.planes[k]
        for j in range(STEP // 8):
            byte = block * (STEP // 8) + j
            whole = byte < (at >> 3)
            if not whole.any():
                break
            out[whole] += _POP[plane[byte[whole]]]
        part = (at & 7) > 0
        out[part] += _POP[plane[at[part] >> 3] & ((1 << (at[part] & 7)) - 1).astype(np.uint8)]
        return out

    def access(self, at) -> np.ndarray:
        at = np.atleast_1d(np.asarray(at, np.int64)).copy()
        out = np.zeros(len(at), np.uint32)
        for k in range(self.bits):
            bit = self._bit(k, at)
            ones = self._ones_before(k, at)
            at = np.where(bit == 1, int(self.zeros[k]) + ones, at - ones)
            out = (out << 1) | bit
        return out

    def _span(self, token: int, end: int) -> tuple[int, int]:
        """Where the token's occurrences before end lie, below the last plane."""
        lo, hi = np.array([0]), np.array([end])
        for k in range(self.bits):
            a, b = self._ones_before(k, lo), self._ones_before(k, hi)
            if (token >> (self.bits - 1 - k)) & 1:
                lo, hi = int(self.zeros[k]) + a, int(self.zeros[k]) + b
            else:
                lo, hi = lo - a, hi - b
        return int(lo[0]), int(hi[0])

    def rank(self, token: int, end: int) -> int:
        lo, hi = self._span(token, end)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, nth) -> np.ndarray:
        """Places of the token's occurrences number nth, from 0, found plane by plane upwards."""
        nth = np.atleast_1d(np.asarray(nth, np.int64))
        lo, hi = self._span(token, self.n)
        if len(nth) and (nth.min() < 0 or nth.max() >= hi - lo):
            raise IndexError("fewer occurrences")
        at = lo + nth
        for k in reversed(range(self.bits)):
            one = (token >> (self.bits - 1 - k)) & 1
            at = self._place(k, at - int(self.zeros[k]) if one else at, one)
        return at

    def _place(self, k: int, nth: np.ndarray, one: int) -> np.ndarray:
        """Places of ones (or zeros) number nth of plane k: the block by the counts, then the bit in it."""
        counts = self.ones[k].astype(np.int64)
        counts = counts if one else np.arange(len(counts)) * STEP - counts
        out = np.empty(len(nth), np.int64)
        for a in range(0, len(nth), 4096):
            own = nth[a : a + 4096]
            block = np.searchsorted(counts, own, "right") - 1
            at = block[:, None] * (STEP // 8) + np.arange(STEP // 8)
            bits = np.unpackbits(self.planes[k][np.minimum(at, self.planes[k].size - 1)], axis=1, bitorder="little") == one
            left = np.cumsum(bits, axis=1) == (own - counts[block] + 1)[:, None]
            out[a : a + 4096] = block * STEP + left.argmax(1)
        return out

    def occurrences(self, token: int) -> np.ndarray:
        return self.select(token, np.arange(self.count(token)))

    def all(self) -> np.ndarray:
        """Every id in order, by undoing the partitions from the lowest plane up."""
        cur = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in reversed(range(self.bits)):
            bit = np.unpackbits(self.planes[k].whole(), count=self.n, bitorder="little").view(bool)
            z = int(self.zeros[k])
            up = np.empty_like(cur)
            up[np.flatnonzero(~bit)] = cur[:z]
            up[np.flatnonzero(bit)] = cur[z:] | cur.dtype.type(1 << (self.bits - 1 - k))
            cur = up
        return cur


_POP = np.array([bin(i).count("1") for i in range(256)], np.int64)


def _step_counts(packed: np.ndarray) -> np.ndarray:
    size = STEP // 8
    full = np.zeros(-(-len(packed) // size) * size or size, np.uint8)
    full[: len(packed)] = packed
    return np.concatenate([[0], np.cumsum(_POP[full].reshape(-1, size).sum(1))]).astype("<u4")


def to_image(doc_ids: list, lengths, ids: np.ndarray, bits: int = BITS) -> bytes:
    w = WaveletMatrix.build(ids, bits)
    pack = zstandard.ZstdCompressor(level=1).compress
    out = [
        MAGIC, struct.pack("<BIQ", bits, len(doc_ids), w.n),
        np.array([NULL_ID if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.asarray(lengths).astype("<u8").tobytes(), w.zeros.astype("<u8").tobytes(),
    ]
    for plane, ones in zip(w.planes, w.ones):
        counts, data = pack(ones.tobytes()), plane.whole()
        frames = [pack(data[i : i + BLOCK_BYTES].tobytes()) for i in range(0, len(data), BLOCK_BYTES)]
        out += [struct.pack("<I", len(counts)), counts, np.array([len(f) for f in frames], "<u4").tobytes(), *frames]
    return b"".join(out)


def from_image(image: bytes) -> tuple[list, np.ndarray, WaveletMatrix]:
    """(doc_ids, lengths, wavelet matrix) of a shard's image."""
    if image[:4] != MAGIC:
        raise ValueError("not a wavelet shard")
    bits, n_docs, n = struct.unpack_from("<BIQ", image, 4)
    at = 4 + struct.calcsize("<BIQ")
    doc_ids = np.frombuffer(image, "<i8", n_docs, at)
    lengths = np.frombuffer(image, "<u8", n_docs, at + 8 * n_docs)
    at += 16 * n_docs
    zeros = np.frombuffer(image, "<u8", bits, at)
    at += 8 * bits
    planes, ones, unpack, size = [], [], zstandard.ZstdDecompressor(), -(-n // 8)
    blocks = -(-size // BLOCK_BYTES)
    for _ in range(bits):
        (length,) = struct.unpack_from("<I", image, at)
        ones.append(np.frombuffer(unpack.decompress(image[at + 4 : at + 4 + length]), "<u4"))
        at += 4 + length
        ends = at + 4 * blocks + np.cumsum(np.frombuffer(image, "<u4", blocks, at).astype(np.int64))
        starts = np.concatenate([[at + 4 * blocks], ends])
        planes.append(Plane([image[a:b] for a, b in zip(starts[:-1].tolist(), ends.tolist())], size))
        at = int(starts[-1])
    return [None if d == NULL_ID else d for d in doc_ids.tolist()], lengths, WaveletMatrix(planes, ones, zeros, n)


def write(
    docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS
) -> None:
    """Writes the documents' ids in ascending order of doc_id as shards under path.

    One shuffle deals the texts by ranges of doc_id (bounds from Spark's own bounded sample, so
    no key makes a hot task unless one id repeats without end). A task keeps one shard in memory.
    """
    vocabulary = vocabulary or tokenizer_path("word_bpe_49k.json")
    ddl = "part int, shard int, base bigint, n_tokens bigint, n_docs int, image binary"
    target = arrow_schema(docs.sparkSession, ddl)

    def run(batches):
        part, shard, base = TaskContext.get().partitionId(), 0, 0
        ids, names, sizes, held = [], [], [], 0

        def flush():
            nonlocal shard, base, ids, names, sizes, held
            image = to_image(names, np.concatenate(sizes), np.concatenate(ids))
            row = [[part], [shard], [base], [held], [len(names)], [image]]
            shard, base = shard + 1, base + held
            ids, names, sizes, held = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, target)], schema=target)

        enc = encoder(vocabulary, True, end_id, CACHE_BYTES)
        for batch in batches:
            for at, rows in lots(batch.column(1)):
                piece = batch.slice(at, rows)
                got, lengths = enc.encode(piece.column(1).to_pylist())
                ids.append(got)
                names += piece.column(0).to_pylist()
                sizes.append(lengths)
                held += len(got)
                if held >= shard_tokens:
                    yield flush()
        if names:
            yield flush()

    ordered = doc_columns(docs, "doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, ddl).write.options(compression="none", maxRecordsPerFile=1).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document from the shards: doc_id, start over all documents, n_tokens, ids_crc32.

    Only the token totals of the write tasks (a row for each task) go to the driver.
    """
    shards = spark.read.schema("part int, shard int, base bigint, n_tokens bigint, n_docs int, image binary").parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    first, before = {}, 0
    for part, n in sorted((r["part"], r["n"]) for r in totals):
        first[part] = before
        before += n
    ddl = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    target = arrow_schema(spark, ddl)

    def run(batches):
        for batch in batches:
            for part, base, image in zip(*(batch.column(i).to_pylist() for i in range(3))):
                names, sizes, w = from_image(image)
                ids = w.all().astype("<u4")
                ends = np.cumsum(sizes.astype(np.int64))
                starts = ends - sizes.astype(np.int64)
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                cols = [names, starts + (first[part] + base), sizes.astype(np.int64), crcs]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, target)], schema=target)

    return shards.select("part", "base", "image").mapInArrow(run, ddl)


def encode_and_read(docs: DataFrame, path: str | None = None) -> DataFrame:
    path = path or work_dir(docs.sparkSession, "wavelet")
    write(docs, path)
    return read(docs.sparkSession, path)
