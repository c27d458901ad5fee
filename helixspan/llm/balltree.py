"""Exact top-k inner products: ball-tree branch and bound in each shard.

A shard's tree splits its vectors at the median of their widest direction down to leaves; each
node keeps the centre and radius of its ball. No vector of a ball has an inner product with a
query above q . centre + |q| * radius. A block of queries walks the tree together: at each node
the queries whose k-th score already exceeds the bound drop out, the child with the larger
bounds comes first, and leaves are scored for the queries that are left. The k-th scores are
shared over leaves, and over shards by the two rounds of vectors.search.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors

LEAF = 256
SHARD_ROWS = 1 << 15
BLOCK_ROWS = 2048
EVERY = 20
K = 20


def build(ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """Flat arrays: order of the points by leaf, and per node centre, radius, first, end, children."""
    points = points.astype(float)
    order = np.arange(len(points))
    centres, radii, first, end, left, right = [], [], [], [], [], []

    def node(a: int, b: int) -> int:
        at = len(centres)
        own = points[order[a:b]]
        centre = own.mean(0)
        centres.append(centre)
        radii.append(float(np.sqrt(((own - centre) ** 2).sum(1).max())))
        first.append(a)
        end.append(b)
        left.append(-1)
        right.append(-1)
        if b - a > leaf and radii[at] > 0:
            far = own[((own - centre) ** 2).sum(1).argmax()]
            other = own[((own - far) ** 2).sum(1).argmax()]
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own @ (other - far), mid)]
            left[at] = node(a, a + mid)
            right[at] = node(a + mid, b)
        return at

    node(0, len(points))
    for a, b, l in zip(first, end, left):
        if l < 0:
            order[a:b].sort()
    return dict(
        ids=ids[order], points=points[order], centres=np.array(centres), radii=np.array(radii), first=np.array(first),
        end=np.array(end), left=np.array(left), right=np.array(right),
    )


def find(tree: dict[str, np.ndarray], queries: np.ndarray, query_ids: np.ndarray, best: vectors.Best) -> None:
    points = tree["points"]
    top = max(1.0, float(np.abs(points).max(initial=0))) * max(1.0, float(np.abs(queries).max(initial=0))) * points.shape[1]
    exact = top < 2.0**53  # sums of products are then exact in doubles
    whole = None if exact else points.astype(np.int64)
    norms = np.sqrt((queries**2).sum(1)) * (1 + 1e-9)
    slack = 1e-9 * top

    def bound(n: int, at: np.ndarray) -> np.ndarray:
        return queries[at] @ tree["centres"][n] + norms[at] * tree["radii"][n] * (1 + 1e-9) + slack

    stack = [(0, np.arange(len(queries)), bound(0, np.arange(len(queries))))]
    while stack:
        n, at, most = stack.pop()
        at = at[most >= best.least[at]]
        if not len(at):
            continue
        if tree["left"][n] < 0:
            a, b = tree["first"][n], tree["end"][n]
            scores = queries[at] @ points[a:b].T if exact else queries[at].astype(np.int64) @ whole[a:b].T
            best.add(at, scores.astype(float), tree["ids"][a:b], query_ids[at])
            continue
        sides = [(c, at, bound(c, at)) for c in (int(tree["left"][n]), int(tree["right"][n]))]
        stack += sorted(sides, key=lambda s: s[2].mean())


def scaled(rows: DataFrame, scale: int = 64) -> DataFrame:
    """Each component as floor(scale * x), x as double."""
    vec = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(F.floor(x * scale).cast("double")))
    return vectors.vector_columns(rows).select("vec_id", vec.alias("embedding"))


def top_k(rows: DataFrame, k: int = K, every: int = EVERY, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows: (vec_id, embedding) with integral components."""
    make = lambda ids, points: vectors.to_bytes(**build(ids, points))
    return vectors.search(rows, every, k, make, find, shard_rows, block_rows, "balltree", False)
