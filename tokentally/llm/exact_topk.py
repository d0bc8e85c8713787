"""Exact top-k search by distributed histogram selection.

Components become integers, floor(256 x), and a score is an integer inner product. For a block
of queries every task scores all its candidates and counts the scores in a histogram of 512
bins per query over the current range; the summed histograms tell in which bin the k-th largest
score lies, and the next round counts inside that bin. When bins are one unit wide, the k-th
value is known, and a last pass keeps the scores above it and, of those equal to it, the smallest
ids. A task passes on only the bins from the top down to its own k-th score: the global k-th
cannot be lower.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokentally.llm.common import checkpointed
from tokentally.llm.vectors import QUERY_EVERY, matrices, query_blocks, ranked, usable

K = 5
SCALE = 256
BIN_BITS = 9
_SCORES = 8_000_000  # scores a task holds at once
_EXACT = 2 ** 53     # doubles hold integers up to here exactly


def _integers(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x)


def _scored(batches: Iterator[pa.RecordBatch], queries: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(dimension, query rows, candidate ids, scores) for pieces of the batch; own scores are nan."""
    for batch in batches:
        for ids, x in matrices(batch):
            if x.shape[1] not in queries:
                continue
            q_ids, q = queries[x.shape[1]]
            step = max(1, _SCORES // max(1, len(q_ids)))
            for lo in range(0, len(ids), step):
                s = q @ _integers(x[lo:lo + step]).T
                own = np.isin(ids[lo:lo + step], q_ids)
                if own.any():
                    cols = np.flatnonzero(own)
                    s[np.searchsorted(q_ids, ids[lo + cols]), cols] = np.nan
                yield x.shape[1], ids[lo:lo + step], s


def _count(rows: DataFrame, queries, state: dict, shift: int, bins: int, k: int) -> DataFrame:
    """(dim, q, bin, n): per task the histogram of scores in [low, low + bins * 2**shift), cut below its k-th."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist = {}
        for d, _, s in _scored(batches, queries.value):
            low = state[d][0]
            at = np.floor((s - low[:, None]) * 2.0 ** -shift)
            inside = (at >= 0) & (at < bins)  # own scores are nan: outside
            row, _ = np.nonzero(inside)
            flat = np.bincount(row * bins + at[inside].astype(np.int64), minlength=len(low) * bins)
            hist[d] = hist.get(d, 0) + flat.reshape(len(low), bins)
        for d, h in hist.items():
            above = np.cumsum(h[:, ::-1], axis=1)[:, ::-1] - h
            q, b = np.nonzero((h > 0) & (above < k))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), d, np.int32)), pa.array(q.astype(np.int64)), pa.array(b.astype(np.int64)),
                                              pa.array(h[q, b].astype(np.int64))], ["dim", "q", "bin", "n"])

    return rows.mapInArrow(run, "dim int, q long, bin long, n long")


def _locate(rows: DataFrame, queries, k: int, largest: float) -> dict[int, np.ndarray]:
    """The k-th largest score of each query, by dimension (minus infinity: fewer than k candidates)."""
    bound = max([float(np.abs(q).sum(1).max(initial=0)) * largest for _, q in queries.value.values()], default=0.0)
    if bound >= _EXACT:
        raise ArithmeticError("scores beyond 2**53 cannot be held exactly")
    shift = max(0, int(2 * bound + 1).bit_length() - BIN_BITS)
    half = 2.0 ** (shift + BIN_BITS - 1)
    state = {d: (np.full(len(ids), -half), np.full(len(ids), k)) for d, (ids, _) in queries.value.items()}
    bins = 1 << BIN_BITS
    while True:
        merged = _count(rows, queries, state, shift, bins, k).groupBy("dim", "q", "bin").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("dim", "q").orderBy(F.desc("bin")))
        top = merged.withColumn("upto", upto).where(F.col("upto") - F.col("n") < k)  # at most k rows a query
        left = {d: need.copy() for d, (_, need) in state.items()}
        found = {d: np.full(len(low), -1, np.int64) for d, (low, _) in state.items()}
        for r in top.orderBy("dim", "q", F.desc("bin")).collect():
            d, q = r["dim"], r["q"]
            if found[d][q] < 0:
                if r["upto"] >= state[d][1][q]:
                    found[d][q] = r["bin"]
                else:
                    left[d][q] = state[d][1][q] - r["upto"]
        state = {d: (np.where(found[d] >= 0, low + found[d] * 2.0 ** shift, -np.inf), left[d]) for d, (low, _) in state.items()}
        if not shift:
            return {d: low for d, (low, _) in state.items()}
        bins = 1 << min(shift, BIN_BITS)  # the next range is the bin just found
        shift = max(0, shift - BIN_BITS)


def _filtered(rows: DataFrame, queries, kth: dict, k: int) -> DataFrame:
    """Scores above the k-th value, and per task the k smallest ids of those equal to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, ids, s in _scored(batches, queries.value):
            order = np.argsort(ids, kind="stable")
            ids, s = ids[order], s[:, order]
            t = kth[d][:, None]
            equal = s == t
            keep = (s > t) | (equal & (np.cumsum(equal, axis=1) <= k))
            q, c = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array(queries.value[d][0][q]), pa.array(ids[c]), pa.array(s[q, c].astype(np.int64))],
                                             ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def exact_topk(df: DataFrame, k: int = K, every: int = QUERY_EVERY, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows with another
    id and as many components (all of them, if fewer than k). Rows without an id, and vectors that are null or
    hold null or non-finite components, take no part. Repeated candidate rows each count; a repeated query
    id is answered once, with its smallest vector. An empty table gives an empty result; other columns are ignored.
    Raises ArithmeticError for the whole table when a query's sum of absolute integer components, times the table's
    largest, reaches 2**53 (one component of about 370,000 that is also the largest; 64 of about 46,000).
    """
    rows = usable(df, id_col, vec_col)
    spark = df.sparkSession
    largest = rows.agg(F.max(F.array_max(F.transform("x", lambda v: F.abs(F.floor(v * SCALE).cast("double"))))).alias("m")).first()["m"] or 0.0
    results = []
    for block in query_blocks(rows, every):
        queries = spark.sparkContext.broadcast({d: (ids, _integers(q)) for d, (ids, q) in block.items()})
        kth = _locate(rows, queries, k, largest)
        results.append(checkpointed(ranked(_filtered(rows, queries, kth, k), k)))
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, results)
