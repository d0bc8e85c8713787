"""What the two vector searches share: usable rows, blocks of queries, the final ranking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_EVERY = 50
BLOCK_BYTES = 8_000_000  # query components sent to the tasks at once, as doubles


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id long, x array<double>) of the rows with an id and a vector of finite numbers."""
    x = F.col(vec_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite) \
        .select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))


def query_blocks(rows: DataFrame, every: int = QUERY_EVERY) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The queries (ids divisible by ``every``), block by block: {dimension: (ids, matrix)}.

    A block holds about ``BLOCK_BYTES``, so what the driver and a task hold doesn't grow with the
    table. A repeated id is one query, with the smallest of its vectors.
    """
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
    size = queries.agg(F.sum(F.size("x") + 1).alias("n")).first()["n"] or 0
    blocks = math.ceil(8 * size / BLOCK_BYTES)
    for b in range(blocks):
        by_dim: dict[int, list] = {}
        for r in queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").collect():
            by_dim.setdefault(len(r["x"]), []).append(r)
        yield {d: (np.array([r["vec_id"] for r in own], np.int64), np.array([r["x"] for r in own], np.float64).reshape(len(own), d))
               for d, own in by_dim.items()}


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of a batch of usable rows, by dimension."""
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
    x = batch.column("x")
    ends = np.r_[0, np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
    flat = x.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield ids[at], flat[ends[at][:, None] + np.arange(d)].reshape(len(at), d)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query: highest score first, ties to the smaller id.

    ``found`` holds at most a few rows per query and task.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
