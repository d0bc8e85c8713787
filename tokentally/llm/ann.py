"""Approximate nearest neighbours by stable projections, a kd-tree and a chi-square stopping test.

Vectors are normalised, so the largest cosine is the smallest Euclidean distance, and projected by
``m`` Gaussian (2-stable) directions: the squared projected distance of two points divided by their
squared distance is chi-square with ``m`` degrees of freedom. Each task indexes its rows in
shards: a kd-tree over the projections with a bounding box per node. A query takes the tree's nodes in
order of projected distance, verifies a leaf's rows exactly, and stops when a row at its current k-th
distance or nearer would lie beyond the frontier with probability at most 1 - ``confidence``.
Every row is indexed; nothing is capped: the test alone ends a search.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.llm.common import checkpointed
from tokentally.llm.vectors import QUERY_EVERY, matrices, query_blocks, ranked, usable

K = 5
PROJECTIONS = 8
CONFIDENCE = 0.97
SEED = 11
SHARD_ROWS = 20_000  # rows a task indexes at once
LEAF_ROWS = 96


def chi_square_quantile(p: float, m: int) -> float:
    """Quantile of the chi-square distribution with an even number of degrees of freedom."""
    def cdf(x):
        term = total = 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    lo, hi = 0.0, 10.0 * m + 100
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def directions(dim: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, m))


class KdTree:
    """Median splits along the widest side; each node has the bounding box of its points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF_ROWS):
        self.order = np.arange(len(points))
        self.children: list[tuple[int, int] | None] = []
        self.span: list[tuple[int, int]] = []
        low, high = [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            node = len(self.span)
            own = points[self.order[a:b]]
            lo, hi = own.min(0), own.max(0)
            self.span.append((a, b))
            self.children.append(None)
            low.append(lo)
            high.append(hi)
            if parent >= 0:
                left, right = self.children[parent]
                self.children[parent] = (node, right) if side == 0 else (left, node)
            axis = int((hi - lo).argmax())
            if b - a > leaf and hi[axis] > lo[axis]:
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], mid)]
                self.children[node] = (-1, -1)
                todo += [(a, a + mid, node, 0), (a + mid, b, node, 1)]
        self.low, self.high = np.array(low), np.array(high)

    def box_distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of a point to every node's box."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return (gap * gap).sum(1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component near 1: the cosine stays, squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _cosines(q: np.ndarray, q_norm: float, x: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return (x * q).sum(1) / (norms * q_norm)


def _search(tree: KdTree, x, norms, ids, own_id, q, q_norm, q_low, best, k, quantile):
    """Merge a shard's neighbours into ``best``, a list of (-cosine, id), sorted, at most k long."""
    dist = tree.box_distances(q_low).tolist()
    heap = [(dist[0], 0)]
    limit = quantile * max(0.0, 2 + 2 * best[-1][0]) if len(best) == k else math.inf
    while heap:
        d, node = heapq.heappop(heap)
        if d > limit:
            break  # the stopping test: nearer rows out here are unlikely enough
        pair = tree.children[node]
        if pair:
            for child in pair:
                if dist[child] <= limit:
                    heapq.heappush(heap, (dist[child], child))
            continue
        a, b = tree.span[node]
        cos = _cosines(q, q_norm, x[a:b], norms[a:b])
        for i in np.flatnonzero(cos >= -best[-1][0] if len(best) == k else cos >= -2).tolist():
            if ids[a + i] != own_id:
                best.append((-float(cos[i]), int(ids[a + i])))
        best.sort()
        del best[k:]
        if len(best) == k:
            limit = quantile * max(0.0, 2 + 2 * best[-1][0])
    return best


def _neighbours(rows: DataFrame, queries, k: int, m: int, quantile: float, seed: int) -> DataFrame:
    """Each task's k nearest found of every query."""

    def shard(ids, x, best):
        d = x.shape[1]
        x = _scaled(x)
        norms = np.sqrt((x * x).sum(1))
        tree = KdTree((x / norms[:, None]) @ directions(d, m, seed))
        x, norms, ids = x[tree.order], norms[tree.order], ids[tree.order]
        q_ids, q = queries.value[d][0], _scaled(queries.value[d][1])
        q_norms = np.sqrt((q * q).sum(1))
        q_low = (q / q_norms[:, None]) @ directions(d, m, seed)
        for i, own in enumerate(q_ids.tolist()):
            best[d, i] = _search(tree, x, norms, ids, own, q[i], q_norms[i], q_low[i], best.get((d, i), []), k, quantile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held = {}, {}
        for batch in batches:
            for ids, x in matrices(batch):
                d = x.shape[1]
                if d not in queries.value:
                    continue
                own = held.setdefault(d, [])
                own.append((ids, x))
                if sum(len(i) for i, _ in own) >= SHARD_ROWS:
                    shard(np.concatenate([i for i, _ in own]), np.concatenate([v for _, v in own]), best)
                    held[d] = []
        for own in held.values():
            if own:
                shard(np.concatenate([i for i, _ in own]), np.concatenate([v for _, v in own]), best)
        out = [(int(queries.value[d][0][i]), v, -s) for (d, i), found in best.items() for s, v in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()),
                                          pa.array([r[2] for r in out], pa.float64())], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(df: DataFrame, k: int = K, every: int = QUERY_EVERY, m: int = PROJECTIONS, confidence: float = CONFIDENCE,
            seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest cosines found for each query, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows with another
    id and as many components (all of them, if fewer than k). Rows without an id, zero vectors, and vectors that are
    null or hold null or non-finite components, take no part. Repeated candidate rows each count; a repeated
    query id is answered once, with its smallest vector. An empty table gives an empty result; other columns are ignored.
    ``confidence`` is the chance of meeting each true neighbour: the expected recall is at least that.
    """
    if m < 2 or m % 2:
        raise ValueError("m must be even")
    rows = usable(df, id_col, vec_col).where(F.exists("x", lambda v: v != 0))
    quantile = chi_square_quantile(confidence, m)
    results = []
    for block in query_blocks(rows, every):
        queries = df.sparkSession.sparkContext.broadcast(block)
        results.append(checkpointed(ranked(_neighbours(rows, queries, k, m, quantile, seed), k)))
    if not results:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, results)
