"""Sharded vector search: shards of all rows, blocks of queries, and the merge of their results.

All rows are dealt evenly, without a key, into shards of about shard_rows vectors; each task
writes its shard's index as one binary row into the shared folder. The queries (rows whose
vec_id is divisible by the step) are dealt into blocks in the same way. Every block meets every
shard by the shard's number, under which the index comes first and the blocks behind it, so that an
index is shipped once and nothing is broadcast; a block's rows are never paired with single candidates.
A first round searches each block in one shard and keeps its k-th scores; the second round
takes these along to the other shards, which then only return candidates that can still count.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor
does a candidate whose length differs from the query's; ties go to the smaller vec_id; a query
row meets no candidate with its own vec_id; rows that repeat a vec_id each count as candidates,
and as queries with results of their own; an empty table has no results.
"""
from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, batch_rows, by_place, column_place, stage

#: Rows of an Arrow batch that hold an image each.
IMAGES = 16


def to_bytes(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def from_bytes(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as f:
        return {k: f[k] for k in f.files}


def vector_columns(rows: DataFrame) -> DataFrame:
    own = by_place(rows)
    return own.select(*[F.col(f"c{column_place(rows, n)}").alias(n) for n in ("vec_id", "embedding")])


def usable(rows: DataFrame, drop_zero: bool) -> DataFrame:
    vec = F.col("embedding")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    out = vector_columns(rows).select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    out = out.filter(F.col("vec_id").isNotNull() & vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(fine, F.lit(False)))
    return out.filter(F.exists(vec, lambda x: x != 0)) if drop_zero else out


def matrices(batches) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(vec_ids, vectors) by vector length."""
    found: dict[int, list] = {}
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        lists = batch.column(1)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(lists.offsets.to_numpy())
        ends = np.cumsum(sizes)
        for d in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == d)
            found.setdefault(d, []).append((ids[own], flat[(ends[own] - d)[:, None] + np.arange(d)]))
    return {d: tuple(np.concatenate(x) for x in zip(*parts)) for d, parts in found.items()}


def deal(rows: DataFrame, per_part: int, build, name: str) -> tuple[DataFrame, int]:
    """Rows (part, image), one for each part and vector length; build(vec_ids, vectors) makes an image."""
    n = max(1, -(-rows.count() // per_part))
    ddl = "part int, dim int, image binary"
    target = arrow_schema(rows.sparkSession, ddl)

    def run(batches):
        part = TaskContext.get().partitionId()
        for d, (ids, vectors) in sorted(matrices(batches).items()):
            order = np.argsort(ids, kind="stable")
            cols = [[part], [d], [build(ids[order], vectors[order])]]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, target)], schema=target)

    return stage(rows.repartition(n).mapInArrow(run, ddl), name), n


class Best:
    """The k best (score, vec_id) of each query so far; ties to the smaller vec_id."""

    def __init__(self, queries: int, k: int, kth=None):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)
        self.least = np.full(queries, -np.inf) if kth is None else kth.astype(float).copy()

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """scores [len(at), m] of candidates ids (m, or [len(at), m]) for the queries at; own: the queries' vec_ids."""
        ids = np.broadcast_to(ids, scores.shape)
        scores = np.where(ids == own[:, None], -np.inf, scores)
        least = self.least[at]
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k])
        r, c = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        if not len(r):
            return
        rows, back = np.unique(r, return_inverse=True)
        k, n = self.k, len(rows)
        q = at[rows]
        row = np.concatenate([np.repeat(np.arange(n), k), back])
        score = np.concatenate([self.score[q].ravel(), scores[r, c]])
        vec = np.concatenate([self.ids[q].ravel(), ids[r, c]])
        order = np.lexsort((vec, -score, row))
        row = row[order]
        first = np.searchsorted(row, np.arange(n))
        rank = np.arange(len(row)) - first[row]
        keep = order[rank < k]
        self.score[q] = score[keep].reshape(n, k)
        self.ids[q] = vec[keep].reshape(n, k)
        self.least[q] = np.maximum(self.least[q], self.score[q][:, -1])


def search(rows: DataFrame, every: int, k: int, build, find, shard_rows: int, block_rows: int, name: str, drop_zero: bool) -> DataFrame:
    """(query_id, rank, vec_id, score): find(image, queries, query_ids, best) searches one shard."""
    spark = rows.sparkSession
    rows = usable(rows, drop_zero)
    shards, n = deal(rows, shard_rows, build, f"{name}-shards")
    plain = lambda ids, vectors: to_bytes(ids=ids, vectors=vectors)
    blocks, _ = deal(rows.filter(F.col("vec_id") % every == 0), block_rows, plain, f"{name}-queries")
    home = F.pmod(F.col("part"), F.lit(n))
    shards = shards.select(F.col("part").alias("shard"), "dim", "image")
    ddl = "block int, dim int, at int, query_id bigint, shard int, vec_id bigint, score double, least double"
    target = arrow_schema(spark, ddl)

    def run(batches):
        held, index = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                shard, d, block, image, kth = (batch.column(i)[r].as_py() for i in range(5))
                if block < 0:
                    held, index = (shard, d), from_bytes(image)
                    continue
                if held != (shard, d):  # a shard without vectors of this length
                    continue
                q = from_bytes(image)
                best = Best(len(q["ids"]), k, None if kth is None else np.array(kth))
                find(index, q["vectors"].astype(float), q["ids"], best)
                at, c = np.nonzero(best.score > -np.inf)
                m = len(at)
                cols = [np.full(m, block), np.full(m, d), at, q["ids"][at], np.full(m, shard), best.ids[at, c], best.score[at, c], best.least[at]]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, target)], schema=target)

    none = F.lit(None).cast("array<double>")

    def searched(met: DataFrame) -> DataFrame:
        """met (shard, dim, block, image, kth) against its shards. An index comes once and its blocks behind it; no image is ever broadcast."""
        index = shards.select("shard", "dim", F.lit(-1).alias("block"), "image", none.alias("kth"))
        return index.unionByName(met).repartition("shard", "dim").sortWithinPartitions("shard", "dim", "block").mapInArrow(run, ddl)

    blocks = blocks.select(F.col("part").alias("block"), "dim", "image", home.alias("home"))
    with batch_rows(spark, IMAGES):
        first = stage(searched(blocks.select(F.col("home").alias("shard"), "dim", "block", "image", none.alias("kth"))), f"{name}-first")
    # k-th scores of a block, in order of its queries (block_rows numbers); queries without any have -inf.
    least = first.groupBy("block", "dim", "at").agg(F.max("least").alias("least"))
    kth = least.groupBy("block", "dim").agg(F.map_from_entries(F.collect_list(F.struct("at", "least"))).alias("kth"))
    ddl_kth = "block int, dim int, image binary, home int, kth array<double>"
    target_kth = arrow_schema(spark, ddl_kth)

    def order_kth(batches):
        for batch in batches:
            for block, d, image, h, found in zip(*(batch.column(i).to_pylist() for i in range(5))):
                got = dict(found or ())
                lst = [got.get(i, -np.inf) for i in range(len(from_bytes(image)["ids"]))]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip([[block], [d], [image], [h], [lst]], target_kth)], schema=target_kth)

    found = first
    if n > 1:
        with batch_rows(spark, IMAGES):
            rest = blocks.join(kth.hint("merge"), ["block", "dim"], "left").select("block", "dim", "image", "home", "kth").mapInArrow(order_kth, ddl_kth)
            rest = rest.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).filter("shard <> home")
            found = first.unionByName(stage(searched(rest.select("shard", "dim", "block", "image", "kth")), f"{name}-others"))
    order = Window.partitionBy("block", "dim", "at").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
