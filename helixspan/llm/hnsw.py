"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Every vector has a level drawn from its vec_id by a geometric law; layer l links the vectors of
level l or more. A layer's lists are chosen, as in the published algorithm, from a vector's
nearest ones so that no chosen neighbour is nearer to another chosen one than to the vector
itself, then completed by back links, and cut to the layer's width. The lists are flat arrays
of row numbers. Inside a shard the nearest ones come from blocked products, since a shard is of
bounded size; so building is the same work per row at every size of the table.

A search descends greedily through the upper layers and then widens a beam of `ef` candidates
in layer 0; a whole block of queries takes each step at once. Results of shards are merged by
vectors.search. Nearness is the inner product; scores are products of the original vectors in
double precision.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import vectors

SHARD_ROWS = 1 << 13
BLOCK_ROWS = 1024
EVERY = 20
K = 20
WIDTH = 16
EF = 128
EXPAND = 4


def levels(ids: np.ndarray, width: int = WIDTH) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    u = ((x >> np.uint64(11)).astype(float) + 1) / 2.0**53
    return np.floor(-np.log(u) / np.log(width)).astype(int)


def _layer(points: np.ndarray, width: int) -> np.ndarray:
    """Neighbour lists [n, width] within points, -1 where there are fewer."""
    n, pool = len(points), min(len(points) - 1, 2 * width)
    if pool <= 0:
        return np.full((n, width), -1, np.int32)
    source, target, score = [], [], []
    for a in range(0, n, 1024):
        near = points[a : a + 1024] @ points.T
        m = len(near)
        near[np.arange(m), np.arange(a, a + m)] = -np.inf
        cand = np.argpartition(near, n - pool, axis=1)[:, n - pool :]
        base = np.take_along_axis(near, cand, 1)
        order = np.argsort(-base, axis=1, kind="stable")
        cand, base = np.take_along_axis(cand, order, 1), np.take_along_axis(base, order, 1)
        vec = points[cand]
        among = vec @ vec.transpose(0, 2, 1)
        taken = np.zeros((m, pool), bool)
        for j in range(pool):
            taken[:, j] = ~((among[:, j, :] > base[:, j, None]) & taken).any(1)
        # chosen ones first, then the nearest of the others
        rank = np.argsort(~taken, axis=1, kind="stable")[:, : max(1, width // 2)]
        source.append(np.repeat(np.arange(a, a + m), rank.shape[1]))
        target.append(np.take_along_axis(cand, rank, 1).ravel())
        score.append(np.take_along_axis(base, rank, 1).ravel())
    s, t, w = (np.concatenate(x) for x in (source, target, score))
    forward = np.concatenate([np.ones(len(s), bool), np.zeros(len(s), bool)])
    s, t, w = np.concatenate([s, t]), np.concatenate([t, s]), np.concatenate([w, w])
    _, only = np.unique(s.astype(np.int64) * n + t, return_index=True)
    s, t, w, forward = s[only], t[only], w[only], forward[only]
    order = np.lexsort((-w, ~forward, s))
    s, t = s[order], t[order]
    rank = np.arange(len(s)) - np.searchsorted(s, np.arange(n))[s]
    keep = rank < width
    out = np.full((n, width), -1, np.int32)
    out[s[keep], rank[keep]] = t[keep]
    return out


def build(ids: np.ndarray, points: np.ndarray, width: int = WIDTH) -> dict[str, np.ndarray]:
    exact = {"exact": points} if points.dtype == np.float64 else {}
    points = points.astype(np.float32)
    level = levels(ids, width)
    if len(level):
        level[level.argmax()] = max(1, level.max())
    out = dict(ids=ids, points=points, graph0=_layer(points, 2 * width), **exact)
    for l in range(1, int(level.max(initial=0)) + 1):
        own = np.flatnonzero(level >= l)
        links = _layer(points[own], width)
        full = np.where(links >= 0, own[np.maximum(links, 0)], -1).astype(np.int32)
        out[f"nodes{l}"], out[f"graph{l}"] = own.astype(np.int32), full
    return out


def _dots(points: np.ndarray, at: np.ndarray, queries: np.ndarray) -> np.ndarray:
    return (points[np.maximum(at, 0)] @ queries[:, :, None])[:, :, 0]


def beam(index: dict[str, np.ndarray], queries: np.ndarray, ef: int = EF) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and scores [queries, ef] found in layer 0, -1 where there are fewer."""
    points, n, m = index["points"], len(index["points"]), len(queries)
    rows = np.arange(m)
    top = max([int(k[5:]) for k in index if k.startswith("nodes")], default=0)
    cur = np.full(m, int(index[f"nodes{top}"][0]) if top else 0)
    score = (points[cur] * queries).sum(1)
    for l in range(top, 0, -1):
        nodes, graph = index[f"nodes{l}"], index[f"graph{l}"]
        live = rows
        while len(live):
            links = graph[np.searchsorted(nodes, cur[live])]
            s = np.where(links >= 0, _dots(points, links, queries[live]), -np.inf)
            j = s.argmax(1)
            got = s[np.arange(len(live)), j]
            better = got > score[live]
            live, j, got, links = live[better], j[better], got[better], links[better]
            cur[live], score[live] = links[np.arange(len(live)), j], got
    graph = index["graph0"]
    seen = np.zeros((m, n + 1), bool)  # the last column takes the places without a neighbour
    seen[rows, cur] = True
    ids = np.full((m, ef), -1, np.int32)
    val = np.full((m, ef), -np.inf, np.float32)
    done = np.ones((m, ef), bool)
    ids[:, 0], val[:, 0], done[:, 0] = cur, score, False
    live = rows
    while len(live):
        i, v, d = ids[live], val[live], done[live]
        pick = np.argsort(np.where(d, np.inf, -v), axis=1)[:, :EXPAND]
        fresh = ~np.take_along_axis(d, pick, 1)
        np.put_along_axis(d, pick, True, 1)
        links = np.where(fresh[:, :, None], graph[np.maximum(np.take_along_axis(i, pick, 1), 0)], -1).reshape(len(live), -1)
        links.sort(axis=1)
        new = (links >= 0) & ~seen[live[:, None], links]
        new[:, 1:] &= links[:, 1:] != links[:, :-1]
        seen[live[:, None], np.where(new, links, n)] = True
        wide = int(new.sum(1).max(initial=0))
        if wide:  # the new ones to the front, to score no more than there are
            front = np.argsort(~new, axis=1, kind="stable")[:, :wide]
            links, new = np.take_along_axis(links, front, 1), np.take_along_axis(new, front, 1)
            s = np.where(new, _dots(points, links, queries[live]), -np.inf).astype(np.float32)
            all_v = np.concatenate([v, s], 1)
            keep = np.argpartition(-all_v, ef - 1, axis=1)[:, :ef]
            v = np.take_along_axis(all_v, keep, 1)
            i = np.take_along_axis(np.concatenate([i, links], 1), keep, 1)
            d = np.take_along_axis(np.concatenate([d, ~new], 1), keep, 1)
        ids[live], val[live], done[live] = np.where(v > -np.inf, i, -1), v, d | (v == -np.inf)
        live = live[~done[live].all(1)]
    return ids, val


def find(index: dict[str, np.ndarray], queries: np.ndarray, query_ids: np.ndarray, best: vectors.Best, ef: int = EF) -> None:
    ef = max(ef, best.k + 1)
    for a in range(0, len(queries), 256):
        q = queries[a : a + 256]
        rows, _ = beam(index, q.astype(np.float32), ef)
        vec = index["exact" if "exact" in index else "points"][np.maximum(rows, 0)].astype(float)
        score = np.where(rows >= 0, (vec * q[:, None, :]).sum(2), -np.inf)
        at = np.arange(a, a + len(q))
        best.add(at, score, index["ids"][np.maximum(rows, 0)], query_ids[at])


def top_k(rows: DataFrame, k: int = K, every: int = EVERY, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    make = lambda ids, points: vectors.to_bytes(**build(ids, points))
    return vectors.search(rows, every, k, make, find, shard_rows, block_rows, "hnsw", True)
