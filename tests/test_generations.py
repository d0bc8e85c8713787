import datetime as dt
import os
import tempfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests.test_ingest import SAMPLE, ingest_lines
from tokentally.sources import generations as G
from tokentally.sources.schemas import FACT_SCHEMAS


def rows(tables):
    return {t: tables.fact(t).count() for t in FACT_SCHEMAS} | {"employees": tables.employees.count()}


def test_readers_see_whole_builds_only(spark):
    root = tempfile.mkdtemp(prefix="tt-gen-")
    with pytest.raises(LookupError):
        G.read_published(spark, root)
    res = ingest_lines(spark, SAMPLE)
    counts = res.publish(root)
    assert counts["version"] == 1
    first = G.read_published(spark, root)
    want = rows(first)
    assert want["api_requests"] > 0 and sum(want.values()) > 3
    stops = replace(res.tables, tool_results=res.tables.tool_results.withColumn("session_id", F.raise_error(F.lit("stopped midway"))))
    with pytest.raises(Exception, match="stopped midway"):
        G.publish(stops, root)
    assert G.published(spark, root).count() == 1 and rows(G.read_published(spark, root)) == want
    assert len(os.listdir(f"{root}/generations")) == 2
    twice = replace(res.tables, api_requests=res.tables.api_requests.unionByName(res.tables.api_requests))
    assert G.publish(twice, root, concurrent=3) == 2
    now = rows(G.read_published(spark, root))
    assert now == want | {"api_requests": 2 * want["api_requests"]}
    assert rows(first) == want == rows(G.read_published(spark, root, 1))  # opened before the second build
    with pytest.raises(LookupError, match="version 3"):
        G.read_published(spark, root, 3)


def test_expire_keeps_the_newest_and_running_builds(spark):
    root = tempfile.mkdtemp(prefix="tt-gen-")
    assert G.expire(spark, root) == []
    res = ingest_lines(spark, SAMPLE)
    for _ in range(3):
        G.publish(res.tables, root)
    names = {r["version"]: r["generation"] for r in G.published(spark, root).collect()}
    running = G.generation_path(root, "running")
    res.tables.writers(running)[0]()
    assert G.expire(spark, root, keep=2) == [names[1]]
    assert os.path.isdir(running) and rows(G.read_published(spark, root, 2)) == rows(G.read_published(spark, root))
    later = dt.datetime.now(dt.timezone.utc) + dt.timedelta(minutes=1)
    assert G.expire(spark, root, keep=1, unfinished_before=later) == sorted([names[2], "running"])
    assert rows(G.read_published(spark, root))["api_requests"] > 0
    with pytest.raises(ValueError):
        G.expire(spark, root, keep=0)


def test_overlapping_builds_with_one_version(spark):
    root = tempfile.mkdtemp(prefix="tt-gen-")
    at = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
    both = [(1, "b", at + dt.timedelta(seconds=1)), (1, "a", at)]
    spark.createDataFrame(both, "version long, generation string, published_at timestamp").write.parquet(f"{root}/published")
    assert [r["generation"] for r in G._newest(G.published(spark, root)).collect()] == ["b", "a"]
