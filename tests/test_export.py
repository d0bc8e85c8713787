"""Batches cut along an ordered stream."""

import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tokentally.sources import export as X


def events(spark, n, hot=None, parts=7):
    ms = F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(1_766_000_000_000 + F.col("id") * 7) if hot else 1_766_000_000_000 + F.col("id") * 7
    return spark.range(n).select("id", ms.alias("timestamp"), F.lit("m").alias("message")).repartition(parts, F.hash("id"))


@pytest.mark.parametrize("n, hot", [(0, None), (1, None), (3456, None), (3456, 1_766_000_000_000)])
def test_batches_follow_the_stream(spark, n, hot):
    rows = X.cut_batches(events(spark, n, hot), ["timestamp", "id"]).orderBy("batch_no").collect()
    batches = [json.loads(r["value"])["logEvents"] for r in rows]
    assert all(1 <= len(b) <= 10 for b in batches)
    got = [(e["timestamp"], int(e["id"])) for b in batches for e in b]
    assert got == sorted(got) and len(set(got)) == len(got) == n
    if n > 1000:
        sizes = [len(b) for b in batches]
        assert set(sizes) == set(range(1, 11)) and 4.5 < sum(sizes) / len(sizes) < 6.5


def test_sizes_depend_on_the_seed_and_place_alone(spark):
    cut = lambda parts, seed=42: [len(json.loads(r["value"])["logEvents"]) for r in
                                  X.cut_batches(events(spark, 2500, parts=parts), ["timestamp", "id"], seed=seed).orderBy("batch_no").collect()]
    assert cut(2) == cut(9) != cut(9, seed=7)


def test_hot_timestamp_spreads_over_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # 6,000 rows are one partition otherwise
    try:
        ranked = X.rank_rows(events(spark, 6000, 1_766_000_000_000), ["timestamp", "id"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(r["rank"] for r in ranked.select("rank").collect()) == list(range(6000))
    sizes = [r["count"] for r in ranked.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 3000


def test_a_key_that_gathers_too_much_raises(spark):
    packed = X.pack_batches(events(spark, 100).withColumn("k", F.lit(1)), "k", "id", max_events=99)
    with pytest.raises(Exception, match="finer key"):
        packed.collect()


def test_analytics_queries_survive_a_missing_library():
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as E; q = E.queries(); " \
           "assert len(q) > 70 and not any(n.startswith('op') for n in q); assert set(E.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__file__.rsplit("/", 2)[0])
    assert done.returncode == 0 and "left out" in done.stderr, done.stderr
