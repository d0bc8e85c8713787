"""Best-fit packing of documents into training sequences by exact-complement hashing.

Texts are tokenised, closed with an end id and cut into pieces of at most ``size`` tokens;
only the lengths matter for packing, and there are at most ``size`` distinct ones. The driver
plans on the histogram of lengths (``size`` counts, whatever the table's size):

1. from the longest length down, the gap it leaves is looked up in an index of single, pair
   and triple sums of the available lengths; combinations that fill it exactly are consumed,
   as many times at once as the counts allow;
2. what is left is packed best fit, longest first, bins with the same filling handled together.

The plan has a few thousand rows at most: every step uses up a length or splits one group of
equal bins. Tasks then place the pieces: a piece's rank among the pieces of its length (its
rank in its task plus the counts of the tasks before) picks its sequence and offset. No task
or group gathers the pieces of a hot length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentally.llm.byte_tokens import tokenizer
from tokentally.llm.common import shared_table, small_batches

SIZE = 1024
END_ID = 2
OFFSETS_BROADCAST_ROWS = 500_000  # 80 MB (32,768 rows were 5); more are joined by shuffle
_GROUP_CHARS = 2_000_000          # text tokenised at once in a task


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def token_pieces(docs: DataFrame, path: str, size: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of every row: (doc_id, piece, start, length, ids, task, nth).

    ``ids`` holds little-endian unsigned 32-bit ids; ``nth`` counts the task's pieces of that length.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)]).add("piece", "integer").add("start", "long") \
        .add("length", "long").add("ids", "binary").add("task", "integer").add("nth", "long")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        task = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            for lo, hi in _groups(batch.column(1)):
                row, piece, start, length, ids, nth = [], [], [], [], [], []
                for i, blob in enumerate(tok.blobs(batch.column(1).slice(lo, hi - lo).to_pylist()), lo):
                    blob += end
                    n = len(blob) // 4
                    cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        ids.append(blob[4 * a:4 * b])
                        nth.append(seen[b - a])
                        seen[b - a] += 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array([task] * len(row), pa.int32()),
                     pa.array(nth, pa.int64())], [f.name for f in schema.fields])

    return small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _groups(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about ``_GROUP_CHARS`` characters."""
    sizes = pc.fill_null(pc.utf8_length(column), 0).to_pylist()
    lo = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > _GROUP_CHARS:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


class _Sums:
    """Available lengths, with their pair and triple sums found by complement."""

    def __init__(self, counts: dict[int, int], size: int):
        self.n = np.zeros(size + 1, np.int64)
        for length, c in counts.items():
            self.n[length] = c

    def pairs(self, total: int):
        """Lengths (a, b), a >= b, that sum to ``total``, largest a first."""
        low = np.arange(1, total // 2 + 1)
        for b in low[(self.n[low] > 0) & (self.n[total - low] > 0)].tolist():
            yield total - b, b

    def combinations(self, gap: int):
        """Singles, pairs and triples that fill ``gap`` exactly."""
        if gap < len(self.n) and self.n[gap] > 0:
            yield (gap,)
        for p in self.pairs(gap):
            yield p
        for a in range(gap - 2, (gap + 2) // 3 - 1, -1):
            if self.n[a] > 0:
                for b, c in self.pairs(gap - a):
                    if b <= a:
                        yield a, b, c

    def consume(self, lengths: tuple[int, ...]) -> int:
        """Take the combination as often as the counts allow."""
        need = Counter(lengths)
        k = min(int(self.n[x]) // m for x, m in need.items())
        for x, m in need.items():
            self.n[x] -= k * m
        return k


def plan_sequences(counts: dict[int, int], size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Histogram of lengths -> [(runs of (length, times) in one sequence, number of such sequences)]."""
    sums = _Sums({x: c for x, c in counts.items() if x < size}, size)
    plan = [([(size, 1)], counts[size])] if counts.get(size) else []
    for length in range(size - 1, 0, -1):
        if sums.n[length] > 0:
            for combo in sums.combinations(size - length):
                k = sums.consume((length, *combo))
                if k:
                    plan.append((list(Counter((length, *combo)).items()), k))
                if not sums.n[length]:
                    break
    return plan + _best_fit(sums.n, size)


def _best_fit(left: np.ndarray, size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit, longest first; bins with equal filling are one group [gap, runs, how many]."""
    by_gap: dict[int, list] = {}
    for length in range(size - 1, 0, -1):
        c = int(left[length])
        for gap in sorted(g for g in by_gap if g >= length):
            fit = gap // length
            groups, by_gap[gap] = by_gap[gap], []
            for runs, bins in groups:
                full = min(bins, c // fit)
                c -= full * fit
                parts = [(fit, full)]
                if c and full < bins:
                    parts.append((c, 1))
                    c, full = 0, full + 1
                for times, n in parts:
                    if n:
                        by_gap.setdefault(gap - times * length, []).append(([*runs, (length, times)], n))
                if full < bins:
                    by_gap[gap].append((runs, bins - full))
            if not by_gap[gap]:
                del by_gap[gap]
            if not c:
                break
        if c:
            fit = size // length
            if c // fit:
                by_gap.setdefault(size - fit * length, []).append(([(length, fit)], c // fit))
            if c % fit:
                by_gap.setdefault(size - c % fit * length, []).append(([(length, c % fit)], 1))
    return [group for groups in by_gap.values() for group in groups]


def _slots(plan: list) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset, times per sequence), by rank."""
    slots, taken, sequence = {}, Counter(), 0
    for runs, bins in plan:
        offset = 0
        for length, times in runs:
            slots.setdefault(length, []).append((taken[length], sequence, offset, times))
            taken[length] += bins * times
            offset += length * times
        sequence += bins
    return {k: np.array(v, np.int64) for k, v in slots.items()}


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id",
         text_col: str = "text", derive: dict[str, Column] | None = None, keep_ids: bool = True) -> DataFrame:
    """Pack every row's tokens into as few sequences of at most ``size`` tokens as the method finds.

    Returns one row per piece: doc_id, piece, start, length, ids (unless ``keep_ids`` is off),
    the ``derive`` columns (made from a piece's columns), sequence_id and offset. Longer
    documents are cut into ``size``-token pieces, the first one shorter. Null and empty texts are
    one end id. Repeated rows and rows without an id are packed like any other; an empty table gives an
    empty result; other columns of ``docs`` are ignored.
    """
    pieces = token_pieces(docs, path or default_tokenizer(), size, end_id, id_col, text_col)
    if derive:
        pieces = pieces.withColumns(derive)
    pieces = shared_table(pieces if keep_ids else pieces.drop("ids"), "packing-pieces")
    counts = pieces.groupBy("length", "task").agg((F.max("nth") + 1).alias("n"))
    before = counts.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    slots = _slots(plan_sequences(histogram, size))
    if counts.count() <= OFFSETS_BROADCAST_ROWS:
        before = F.broadcast(before)
    ranked = pieces.join(before, ["length", "task"]).withColumn("rank", F.col("nth") + F.col("before"))
    out = [c for c in pieces.columns if c not in ("task", "nth")]
    schema = T.StructType([ranked.schema[c] for c in out]).add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                rows = slots[x][np.searchsorted(slots[x][:, 0], rank[at], "right") - 1]
                nth = rank[at] - rows[:, 0]
                sequence[at] = rows[:, 1] + nth // rows[:, 3]
                offset[at] = rows[:, 2] + nth % rows[:, 3] * x
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in out], pa.array(sequence), pa.array(offset)], [f.name for f in schema.fields])

    return ranked.select(*out, "rank").mapInArrow(place, schema)
