"""Published generations of the curated tables: a reader sees all tables of one build.

A build writes its tables into a folder of its own, ``generations/<token>``, and appends one row to the list
``published`` when all are there. That row is one file, which a job commit renames into place, so a reader finds
it whole or not at all. Readers look the list up once and then read that generation's folders only, whatever is
published meanwhile. A build that fails, or loses its driver, leaves a folder that no row names.
"""

from __future__ import annotations

import os
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentally.sources.tables import Tables, run_all

_PUBLISHED = "version long, generation string, published_at timestamp"
KEEP = 2  # generations that ``expire`` leaves


def published(spark: SparkSession, root: str) -> DataFrame:
    """(version, generation, published_at) of every build under ``root``; none: an empty frame."""
    try:
        return spark.read.schema(_PUBLISHED).parquet(f"{root.rstrip('/')}/published")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _PUBLISHED)


def _newest(rows: DataFrame) -> DataFrame:
    """Newest first. Builds that overlap can share a version; the one published later counts."""
    return rows.orderBy(F.desc("version"), F.desc("published_at"), F.desc("generation"))


def generation_path(root: str, generation: str) -> str:
    return f"{root.rstrip('/')}/generations/{generation}"


def publish(tables: Tables, root: str, rejects: DataFrame | None = None, concurrent: int = 1) -> int:
    """Write all tables (and ``rejects``) as a new generation, then make it the current one; its version."""
    spark, generation = tables.employees.sparkSession, os.urandom(8).hex()
    path = generation_path(root, generation)
    jobs = tables.writers(path)
    if rejects is not None:
        jobs.append(lambda: rejects.write.parquet(f"{path}/rejects"))
    run_all(jobs, concurrent)
    last = _newest(published(spark, root)).first()
    version = last["version"] + 1 if last else 1
    row = spark.createDataFrame([(version, generation, datetime.now(timezone.utc))], _PUBLISHED)
    row.coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/published")
    return version


def read_published(spark: SparkSession, root: str, version: int | None = None, **kw) -> Tables:
    """The tables of the newest generation, or of ``version``; LookupError if there is none."""
    rows = published(spark, root)
    row = _newest(rows if version is None else rows.where(F.col("version") == version)).first()
    if row is None:
        raise LookupError(f"nothing published under {root!r}" if version is None else f"version {version} is not published under {root!r}")
    return Tables.from_parquet(spark, generation_path(root, row["generation"]), **kw)


def expire(spark: SparkSession, root: str, keep: int = KEEP, unfinished_before: datetime | None = None) -> list[str]:
    """Delete the folders of all published generations but the newest ``keep``; the names of those deleted.

    Folders that no row names belong to builds that failed or still run: they go only if last changed before
    ``unfinished_before``. Reads of a deleted version fail, so keep as many as the longest query outlives.
    """
    if keep < 1:
        raise ValueError("keep at least one generation")
    named = [r["generation"] for r in _newest(published(spark, root)).collect()]  # one row a build
    kept, old = set(named[:keep]), set(named[keep:])
    path = spark._jvm.org.apache.hadoop.fs.Path
    folder = path(generation_path(root, ""))
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        name = status.getPath().getName()
        stale = unfinished_before is not None and status.getModificationTime() < unfinished_before.timestamp() * 1000
        if name in old or name not in kept and stale:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)
