"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentally.session import ensure_checkpoint_dir, scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: eager ``checkpoint()`` in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Like a checkpoint, but columnar: later passes read only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_fold(id_col: str, folds: int):
    """crc32 of the id's decimal text, modulo ``folds`` (null ids: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are bounded by bytes: texts differ widely in size."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", "8388608"), ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")):
        df.sparkSession.conf.set(key, value)
    return df


def join_skewed(rows: DataFrame, groups: DataFrame, key: str, n: str, total: int, how: str = "left") -> DataFrame:
    """``rows`` joined with ``groups`` (one row a key; column ``n`` counts its rows) on ``key``, hot keys included.

    Keys of more than a thousandth of ``total``, at least the sum of ``n``, are under 1,000: those groups are
    broadcast. The others are joined by a shuffle, in which no key has more than that share.
    """
    hot = groups.where(F.col(n) * 1000 > F.lit(total))
    cold = groups.where(F.col(n) * 1000 <= F.lit(total)).hint("shuffle_merge")
    return rows.join(F.broadcast(hot), key).unionByName(
        rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how))


def gathered(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``values[start:start + length]`` of every range, one behind the other."""
    before = np.cumsum(length) - length
    return values[np.arange(int(length.sum())) + np.repeat(start - before, length)]
