"""P1-P9 reshaping operators."""

import numpy as np
import pytest

from tokentally.operators import reshape as R


def test_exact_quantiles_match_numpy_with_a_hot_group(spark):
    rng = np.random.default_rng(7)
    hot = rng.exponential(3.0, 6000)              # one group holds most rows
    rows = [("hot", float(v)) for v in hot] + [("small", float(v)) for v in rng.normal(10, 2, 301)] \
        + [("one", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    out = {r["g"]: r for r in R.exact_quantiles(df, "g", "v").collect()}
    for g, vals in (("hot", hot), ("small", [v for k, v in rows if k == "small"]), ("one", [5.0])):
        for p, col in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
            assert out[g][col] == pytest.approx(float(np.percentile(vals, p * 100)), rel=1e-12), (g, p)
        assert out[g]["n"] == len(vals)


def test_box_stats_whiskers(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([("p", v) for v in vals], "practice string, total_cost double")
    (b,) = R.box_stats(df, "practice", "total_cost").collect()
    assert (b["q1"], b["median"], b["q3"]) == (2.0, 3.0, 4.0)
    assert b["whisker_high"] == 4.0 and b["outliers"] == 1 and b["max"] == 100.0


def test_log_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in [0.0, 1.0, 10.0, 100.0, 1000.0]], "d double")
    out = R.log_histogram(df, "d").collect()
    assert len(out) == 30 and sum(r["count"] for r in out) == 4
    assert out[0]["bin_lo"] == pytest.approx(1.0) and out[-1]["bin_hi"] == pytest.approx(1000.0)
    assert out[-1]["count"] == 1          # the maximum falls into the closed last bin
    one = R.log_histogram(spark.createDataFrame([(2.0,), (2.0,)], "d double"), "d").collect()
    assert len(one) == 1 and one[0]["count"] == 2


def test_status_code_order(spark):
    df = spark.createDataFrame([(c, 1) for c in ["500", "Unknown", "E429x", "401", "400"]],
                               "status_code string, count long")
    assert [r["status_code"] for r in R.status_code_order(df).collect()] == ["400", "401", "500", "E429x", "Unknown"]


def test_heatmap_pivot_fills_zeros_monday_first(spark):
    df = spark.createDataFrame([(10, "Wednesday", 2), (3, "Monday", 1)], "hour long, day_of_week string, session_count long")
    out = R.heatmap_pivot(df).collect()
    assert [r["day_of_week"] for r in out] == ["Monday", "Wednesday"]
    assert out[0]["3"] == 1 and out[0]["10"] == 0 and out[1]["10"] == 2


def test_unpivot_share_and_normalize(spark):
    ar = spark.createDataFrame([("Read", 2, 0), ("Edit", 0, 1)], "tool_name string, accept_count long, reject_count long")
    assert R.accept_reject_long(ar).count() == 4
    sh = {r["m"]: r["share"] for r in R.with_share(spark.createDataFrame([("a", 1), ("b", 3)], "m string, n long"), "n").collect()}
    assert sh == {"a": 0.25, "b": 0.75}
    raw = spark.createDataFrame([("2025-12-02", "1.5"), ("bad", "2"), ("2025-12-01", "x")], "ds string, y string")
    out = R.normalize_series(raw, ["y"]).collect()
    assert [(str(r["ds"]), r["y"]) for r in out] == [("2025-12-02", 1.5)]  # bad dates and bad numbers both drop


def test_hot_value_is_split_over_partitions(spark):
    from pyspark.sql import functions as F
    # a third of all rows share one group AND one value
    rows = [("p", 0.0)] * 3000 + [("p", float(i)) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sorted_ = df.select("g", "v", F.monotonically_increasing_id().alias("tb")).orderBy("g", "v", "tb")
        sizes = sorted_.groupBy(F.spark_partition_id().alias("pid")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(r["count"] for r in sizes) < 3000
    (q,) = R.exact_quantiles(df, "g", "v").collect()
    vals = sorted(v for _, v in rows)
    assert q["q25"] == pytest.approx(float(np.percentile(vals, 25)))
    assert q["q50"] == pytest.approx(float(np.percentile(vals, 50)))


def test_level_order(spark):
    df = spark.createDataFrame([("L10",), ("L2",), ("L1",), ("L9",)], "level string")
    assert [r["level"] for r in R.level_sorted(df).collect()] == ["L1", "L2", "L9", "L10"]


def test_normalize_series_drops_unusable_dates_and_numbers(spark):
    from tokentally.operators import reshape
    df = spark.createDataFrame([("2025-01-02", "1.5"), ("2025-01-01", "x"), ("bad", "2"), ("2025-01-01", "3"), (None, "4"), ("2025-01-03", None)], "ds string, y string")
    assert [(str(r.ds), r.y) for r in reshape.normalize_series(df, ["y"]).collect()] == [("2025-01-01", 3.0), ("2025-01-02", 1.5)]
