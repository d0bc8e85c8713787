"""Quality classifier: random Fourier features, partition-summed ridge, isotonic calibration.

A text becomes a few document statistics, standardised, and random Fourier features of them, whose
inner product approximates a Gaussian kernel. Every partition sums its part of the normal equations,
apart for each of five folds (by the hash of the text, so copies share a fold); the sums
are added up in a tree of Spark groups, and the driver solves systems of a fixed size. Each row
is scored by the weights of the four other folds; those scores, counted in bins, are calibrated by isotonic
regression (pool adjacent violators over a fixed number of bins). All labelled rows are learned from.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentally.llm.common import checkpointed, crc_fold, small_batches

FEATURES = 300
BANDWIDTH = 3.0  # of the Gaussian kernel, in standard deviations
RIDGE = 1.0
SEED = 17
INNER_FOLDS = 5
BINS = 1_000
LOW, HIGH = -0.5, 1.5  # raw scores outside are counted in the end bins
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
COLUMNS = ("quality_score", "quality_predicted")

_UPPER = bytes(range(65, 91))
_LETTERS = bytes(c for c in range(256) if c >= 128 or chr(c).isalpha())
_DIGITS = b"0123456789"
_SYMBOLS = b"#$%&*@^~<>{}[]=+_/\\"


def statistics(text: str | None) -> list[float]:
    """Document statistics of a whole text; null and empty texts give zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * N_STATS
    n, size = len(words), len(raw)
    count = lambda kind: size - len(raw.translate(None, kind))
    letters = count(_LETTERS)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    lengths = list(map(len, words))
    mean = sum(lengths) / n
    return [
        math.log1p(size), math.log1p(n), mean, math.log1p(max(lengths)), letters / size, count(_UPPER) / max(1, letters),
        count(_DIGITS) / size, count(_SYMBOLS) / n, raw.count(b"|") / n, raw.count(b"!") / n, raw.count(b".") / n, raw.count(b",") / n,
        len(counts) / n, max(counts.values()) / n, sum(map(eq, words, islice(words, 1, None))) / n,
        1 - len(set(lines)) / max(1, len(lines)), math.log1p(size / max(1, len(lines))), sum(v > 2 for v in counts.values()) / len(counts),
    ]


N_STATS = 18


def with_statistics(docs: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """The named columns and ``stats`` of every row."""
    kept = [docs.schema[c] for c in columns]
    schema = T.StructType([*kept, T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [statistics(t) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(stats, pa.list_(pa.float64()))], [*columns, "stats"])

    return small_batches(docs).select(*columns, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


@dataclass
class QualityModel:
    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray     # of all rows
    by_fold: np.ndarray     # of all rows but the fold's
    calibrated: np.ndarray  # isotonic score of each bin

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.std, -6, 6)
        rng = np.random.default_rng(SEED)
        w = rng.standard_normal((N_STATS, FEATURES)) / BANDWIDTH
        z = np.cos(x @ w + rng.uniform(0, 2 * np.pi, FEATURES)) * math.sqrt(2 / FEATURES)
        return np.c_[np.ones(len(x)), x, z]

    def scores(self, stats: np.ndarray) -> np.ndarray:
        raw = self.features(stats) @ self.weights
        centres = LOW + (np.arange(BINS) + 0.5) * (HIGH - LOW) / BINS
        return np.interp(raw, centres, self.calibrated)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), N_STATS)


def pool_adjacent(total: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Isotonic regression of binned labels: one non-decreasing value per bin; empty bins are filled between."""
    blocks: list[list[float]] = []  # weight, positives, first bin, last bin
    for i in np.flatnonzero(total):
        blocks.append([total[i], positive[i], i, i])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w, p, _, last = blocks.pop()
            blocks[-1][0] += w
            blocks[-1][1] += p
            blocks[-1][3] = last
    at = [x for b in blocks for x in (b[2], b[3])]
    value = [b[1] / b[0] for b in blocks for _ in range(2)]
    return np.interp(np.arange(len(total)), at, value)


def _normal_equations(train: DataFrame, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """Per inner fold: sums of z z' and z y, each partition's first, then a tree of groups."""
    d = 1 + N_STATS + FEATURES

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            stats, y = _matrix(b.column("stats")), b.column("y").to_numpy(zero_copy_only=False)
            fold = b.column("inner").to_numpy(zero_copy_only=False)
            for f in np.unique(fold).tolist():
                z = model.features(stats[fold == f])
                sums[f] = sums.get(f, 0) + np.c_[z.T @ z, z.T @ y[fold == f]]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(sums), pa.int32()),
                                          pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["inner", "part", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(d * (d + 1))
        for s in pdf["sums"]:
            total += np.frombuffer(s)
        return pd.DataFrame({"inner": [pdf["inner"].iloc[0]], "part": [pdf["part"].iloc[0]], "sums": [total.tobytes()]})

    schema = "inner int, part int, sums binary"
    parts = train.select("stats", "y", "inner").mapInArrow(part, schema)
    fan = max(2, math.isqrt(train.rdd.getNumPartitions()))
    tree = parts.groupBy("inner", F.pmod("part", F.lit(fan))).applyInPandas(add, schema).groupBy("inner").applyInPandas(add, schema)
    a, b = np.zeros((INNER_FOLDS, d, d)), np.zeros((INNER_FOLDS, d))
    for r in tree.collect():  # INNER_FOLDS rows
        s = np.frombuffer(r["sums"]).reshape(d, d + 1)
        a[r["inner"]], b[r["inner"]] = s[:, :d], s[:, d]
    return a, b


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> QualityModel | None:
    """Learn ``labels.quality`` outside the held-out fold; None if there is nothing to learn from.

    Repeated labels of a document count as their mean; null labels and ids are left out.
    """
    y = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").cast("double").alias("y"))
    learn = docs.where("doc_id is not null").where(crc_fold("doc_id", folds) != held_out) \
        .select(F.col("doc_id"), F.pmod(F.xxhash64("text"), F.lit(INNER_FOLDS)).cast("int").alias("inner"), "text")
    train = checkpointed(with_statistics(learn, ["doc_id", "inner"]).join(y, "doc_id").select("stats", "y", "inner"))
    moments = train.agg(F.count(F.lit(1)).alias("n"), *[f(F.col("stats")[i]).alias(f"{f.__name__}{i}") for i in range(N_STATS)
                                                       for f in (F.avg, F.stddev_pop)]).first()
    if not moments["n"]:
        return None
    mean = np.array([moments[f"avg{i}"] for i in range(N_STATS)])
    std = np.maximum(np.array([moments[f"stddev_pop{i}"] for i in range(N_STATS)]), 1e-3)
    model = QualityModel(mean, std, np.zeros(0), np.zeros(0), np.zeros(0))
    a, b = _normal_equations(train, model)
    ridge = RIDGE * np.eye(a.shape[1])
    solve = lambda x, y: np.linalg.solve(x + ridge, y)
    model.weights = solve(a.sum(0), b.sum(0))
    model.by_fold = np.array([solve(a.sum(0) - a[f], b.sum(0) - b[f]) for f in range(INNER_FOLDS)])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, positive = np.zeros(BINS), np.zeros(BINS)
        for p in batches:
            raw = (model.features(_matrix(p.column("stats"))) * model.by_fold[p.column("inner").to_numpy(zero_copy_only=False)]).sum(1)
            at = np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(int)
            total += np.bincount(at, minlength=BINS)
            positive += np.bincount(at, p.column("y").to_numpy(zero_copy_only=False), minlength=BINS)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own]), pa.array(positive[own])], ["bin", "total", "positive"])

    total, positive = np.zeros(BINS), np.zeros(BINS)
    counts = train.select("stats", "y", "inner").mapInArrow(binned, "bin long, total double, positive double")
    for r in counts.groupBy("bin").agg(F.sum("total").alias("total"), F.sum("positive").alias("positive")).collect():  # at most BINS rows
        total[r["bin"]], positive[r["bin"]] = r["total"], r["positive"]
    model.calibrated = pool_adjacent(total, positive)
    return model


def score_quality(docs: DataFrame, model: QualityModel | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with quality_score (0 to 1) and quality_predicted (replacing such columns); whole texts.

    Null and empty texts are scored as texts without words. Without a model nothing is known against a
    document: score 1. Rows and other columns are kept; an empty table gives an empty result.
    """
    kept = [f for f in docs.schema if f.name not in COLUMNS]
    schema = T.StructType([*kept, T.StructField("quality_score", T.DoubleType()), T.StructField("quality_predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = np.array([statistics(t) for t in b.column(text_col).to_pylist()]).reshape(b.num_rows, N_STATS)
            score = np.ones(b.num_rows) if model is None else np.clip(model.scores(stats), 0, 1)
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                                             [f.name for f in schema])

    return small_batches(docs).select(*[F.col(f.name) for f in kept]).mapInArrow(run, schema)
