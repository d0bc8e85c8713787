"""F1-F6 on the reference's forecast fixtures, for one and several series."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from refit import backtest_refit
from tokentally.operators import forecast as FC

D0 = dt.date(2025, 12, 1)


def series(spark, ys, key=None, start=D0):
    rows = [((key,) if key else ()) + (start + dt.timedelta(days=i), float(y)) for i, y in enumerate(ys)]
    schema = ("k string, " if key else "") + "ds date, y double"
    return spark.createDataFrame(rows, schema)


def test_normalize_fills_gaps(spark):
    df = spark.createDataFrame([(dt.date(2025, 12, 10), 1.5), (dt.date(2025, 12, 12), 2.0)], "ds date, y double")
    out = [(r["ds"], r["y"]) for r in FC.normalize_daily(df).orderBy("ds").collect()]
    assert out == [(dt.date(2025, 12, 10), 1.5), (dt.date(2025, 12, 11), 0.0), (dt.date(2025, 12, 12), 2.0)]


def test_normalize_keeps_leading_zeros_and_clamps_end(spark):
    df = spark.createDataFrame([(dt.date(2025, 12, 10), 1.0), (dt.date(2025, 12, 10), 2.0)], "ds date, y double")
    out = FC.normalize_daily(df, date_start="2025-12-08", date_end="2025-12-31").orderBy("ds").collect()
    assert [r["y"] for r in out] == [0.0, 0.0, 3.0]


def test_normalize_empty_with_dates_is_all_zero(spark):
    df = spark.createDataFrame([], "ds date, y double")
    out = FC.normalize_daily(df, date_start="2025-12-01", date_end="2025-12-03").collect()
    assert [r["y"] for r in out] == [0.0, 0.0, 0.0]
    assert FC.normalize_daily(df).count() == 0
    assert FC.normalize_daily(df, date_start="2025-12-03", date_end="2025-12-01").count() == 0


def test_short_history_is_insufficient(spark):
    s = FC.forecast_summary(series(spark, [1.0] * 7))
    (st,) = s.status.collect()
    assert st["status"] == "insufficient_data" and "14 days" in st["message"]
    assert s.forecast.count() == 0


def test_empty_input_is_insufficient(spark):
    (st,) = FC.forecast_summary(spark.createDataFrame([], "ds date, y double")).status.collect()
    assert st["status"] == "insufficient_data" and st["message"] == FC.MSG_NO_DATA


def test_44_days_ok_with_metrics(spark):
    s = FC.forecast_summary(series(spark, [1.0] * 44))
    (st,) = s.status.collect()
    assert st["status"] == "ok" and st["message"] is None
    fut = s.forecast.orderBy("ds").collect()
    assert len(fut) == 14 and fut[0]["ds"] == D0 + dt.timedelta(days=44)
    assert all(r["yhat"] == pytest.approx(1.0) for r in fut)
    assert s.anomalies.count() == 0
    (m,) = s.metrics.collect()
    assert m["n_cutoffs"] == 1 and m["mae"] == pytest.approx(0.0) and m["coverage"] == 1.0


def test_21_days_ok_without_metrics(spark):
    s = FC.forecast_summary(series(spark, [i % 5 for i in range(21)]))
    (st,) = s.status.collect()
    assert st["status"] == "ok" and st["message"] == FC.MSG_NO_CV
    assert s.forecast.count() == 14 and s.metrics.count() == 0


def test_anomaly_rule(spark):
    df = series(spark, [1, 1, 11, 1, 1]).withColumn("yhat", F.lit(1.0))
    (a,) = FC.detect_anomalies(df).collect()
    assert (a["actual_cost"], a["expected_cost"], a["residual"]) == (11.0, 1.0, 10.0)
    assert FC.detect_anomalies(series(spark, [3, 4, 5]).withColumn("yhat", F.col("y"))).count() == 0


def test_safe_mape_skips_zero_days(spark):
    df = spark.createDataFrame([(10.0, 8.0), (0.0, 1.0), (5.0, 6.0)], "y double, yhat double")
    assert df.agg(FC.safe_mape(F.col("y"), F.col("yhat")).alias("m")).first()["m"] == pytest.approx(0.2)
    z = spark.createDataFrame([(0.0, 1.0)], "y double, yhat double")
    assert z.agg(FC.safe_mape(F.col("y"), F.col("yhat")).alias("m")).first()["m"] is None


def test_trend_and_weekday_are_recovered(spark):
    ys = [10 + 0.5 * i + (3 if (D0 + dt.timedelta(days=i)).weekday() == 0 else 0) for i in range(70)]
    fp = FC.fit_predict(series(spark, ys)).orderBy("ds").collect()
    assert len(fp) == 84
    # two-step fit (line, then weekday means of the residuals): close, not exact
    assert max(abs(r["yhat"] - y) for r, y in zip(fp, ys)) < 0.3
    mondays = [r["yhat"] - (10 + 0.5 * i) for i, r in enumerate(fp) if r["ds"].weekday() == 0]
    assert all(2.5 < m < 3.5 for m in mondays)          # the weekday effect carries into the future


def test_cutoffs_follow_the_rolling_origin_rule(spark):
    c = FC.cutoffs(series(spark, [1.0] * 58).withColumn("_s", F.lit(0)), ["_s"]).orderBy("cutoff").collect()
    # last - 14 - 7k >= first + 29  ->  k = 0, 1, 2
    assert [r["cutoff"] for r in c] == [D0 + dt.timedelta(days=d) for d in (29, 36, 43)]


def test_many_series_at_once(spark):
    df = series(spark, [1.0] * 50, key="a").unionByName(series(spark, [2.0] * 10, key="b"))
    s = FC.forecast_summary(df, ["k"])
    st = {r["k"]: r["status"] for r in s.status.collect()}
    assert st == {"a": "ok", "b": "insufficient_data"}
    assert {r["k"] for r in s.forecast.collect()} == {"a"}
    assert [r["k"] for r in s.metrics.collect()] == ["a"]


def test_running_sum_backtest_equals_refit(spark):
    import random
    rnd = random.Random(3)
    ys_a = [50 + 0.3 * i + rnd.gauss(0, 4) + (8 if i % 7 == 2 else 0) for i in range(90)]
    ys_b = [rnd.choice([0.0, 1.0, 5.0]) for _ in range(60)]
    df = series(spark, ys_a, key="a").unionByName(series(spark, ys_b, key="b"))
    fast = {r["k"]: r for r in FC.backtest(df, ["k"]).collect()}
    slow = {r["k"]: r for r in backtest_refit(df, ["k"]).collect()}
    assert set(fast) == set(slow) == {"a", "b"}
    for key in fast:
        assert fast[key]["n_cutoffs"] == slow[key]["n_cutoffs"]
        for m in ("mae", "mape", "coverage"):
            assert fast[key][m] == pytest.approx(slow[key][m], rel=1e-9, abs=1e-12), (key, m)


def test_degenerate_series_is_a_forecast_error(spark):
    ys = [1.0] * 20
    ys[5] = float("inf")
    (st,) = FC.forecast_summary(series(spark, ys)).status.collect()
    assert st["status"] == "forecast_error" and st["message"].startswith(FC.MSG_FAILED)


def test_nan_cost_counts_as_missing(spark):
    ys = [1.0] * 20
    ys[5] = float("nan")              # a sum skips NaN, as in the reference: the day is 0
    s = FC.forecast_summary(series(spark, ys))
    assert s.status.first()["status"] == "ok"
    assert sorted(r["y"] for r in s.history.collect()) == [0.0] + [1.0] * 19


def test_series_key_may_not_shadow_internal_columns(spark):
    df = series(spark, [1.0] * 20, key="a").withColumnRenamed("k", "sigma")
    with pytest.raises(ValueError, match="sigma"):
        FC.fit_predict(df, ["sigma"])


@pytest.mark.parametrize("level", [1e4, 1e6, 1e8, 1e10])
def test_backtest_equals_refit_on_large_totals(spark, level):
    import random
    rng = random.Random(7)
    df = series(spark, [level + rng.gauss(0, 1) for _ in range(120)])
    (fast,), (slow,) = FC.backtest(df).collect(), backtest_refit(df).collect()
    assert fast["coverage"] == pytest.approx(slow["coverage"], abs=0.02)
    assert fast["mae"] == pytest.approx(slow["mae"], rel=1e-2)


def test_normalize_skips_nan(spark):
    df = spark.createDataFrame([(dt.date(2025, 12, 10), 1.0), (dt.date(2025, 12, 10), float("nan"))], "ds date, y double")
    assert [r["y"] for r in FC.normalize_daily(df).collect()] == [1.0]


@pytest.mark.parametrize("slopes", [(0,), (1e3,), (1e5,), (1e6,), (1e7,), (1e8,), (0, 1e6), (1e7, -1e6)])
def test_backtest_equals_refit_on_steep_trends(spark, slopes):
    """Also where the trend breaks in the middle."""
    import random
    rng = random.Random(11)
    ys, level = [], 0.0
    for i in range(200):
        level += slopes[i * len(slopes) // 200]
        ys.append(level + rng.gauss(0, 1) + (2 if i % 7 == 3 else 0))
    df = series(spark, ys)
    (fast,), (slow,) = FC.backtest(df).collect(), backtest_refit_numpy(ys)
    assert fast["n_cutoffs"] == slow["n_cutoffs"]
    assert fast["coverage"] == pytest.approx(slow["coverage"], abs=1e-6)
    assert fast["mae"] == pytest.approx(slow["mae"], rel=1e-6)


def backtest_refit_numpy(ys):
    """Residuals of every refit by solving for the line on centred days."""
    import numpy as np
    y, first = np.array(ys), D0.weekday()
    misses, inside, n = [], [], 0
    for cut in range(len(ys) - 1 - 14, 28, -7):
        t = np.arange(cut + 1, dtype=float)
        line = np.array([((t - t.mean()) * (y[:cut + 1] - y[:cut + 1].mean())).sum() / ((t - t.mean()) ** 2).sum()])
        r = y[:cut + 1] - y[:cut + 1].mean() - line * (t - t.mean())
        day = (np.arange(len(ys)) + first) % 7
        s = np.array([r[day[:cut + 1] == d].mean() for d in range(7)])
        sigma = (r - s[day[:cut + 1]]).std(ddof=1)
        new = np.arange(cut + 1, cut + 15)
        miss = np.abs(y[new] - (y[:cut + 1].mean() + line * (new - t.mean()) + s[day[new]]))
        misses += miss.tolist()
        inside += (miss <= FC.Z_80 * sigma).tolist()
        n += 1
    return [{"n_cutoffs": n, "mae": float(np.mean(misses)), "coverage": float(np.mean(inside))}]


def test_conformal_bands_hold_what_they_promise(spark):
    import random
    rng = random.Random(5)
    walk, ys = 0.0, []
    for _ in range(1500):  # a slow wander and heavy tails: the normal band is too narrow here
        walk = 0.98 * walk + rng.gauss(0, 3)
        ys.append(100 + walk + rng.choice([1, 1, 1, 6]) * rng.gauss(0, 2))
    df = series(spark, ys, key="a").unionByName(series(spark, ys[:40], key="b"))
    (c,) = FC.conformal_coverage(df, ["k"]).collect()
    assert c["k"] == "a" and 0.77 <= c["coverage"] <= 0.83
    rows = FC.conformal_forecast(df, ["k"]).orderBy("ds").collect()
    assert len(rows) == 14 and {r["k"] for r in rows} == {"a"} and all(r["yhat_lower"] < r["yhat"] < r["yhat_upper"] for r in rows)
    misses = FC.backtest_rows(df, ["k"]).where("datediff(ds, cutoff) = 3").selectExpr("abs(y - yhat) AS m").collect()
    m = sorted(r["m"] for r in misses)
    width = FC.conformal_widths(FC.backtest_rows(df, ["k"]), ["k"]).where("step = 3").first()
    assert width["n"] == len(m) and width["width"] == m[-(-8 * (len(m) + 1) // 10) - 1]


def test_conformal_widths_of_few_cutoffs_and_no_rows(spark):
    (c,) = FC.conformal_widths(FC.backtest_rows(series(spark, [float(i % 9) for i in range(44)]))).where("step = 1").collect()
    assert c["n"] == 1
    assert FC.conformal_forecast(series(spark, [1.0] * 20)).count() == 0
    assert FC.conformal_coverage(series(spark, []).limit(0)).count() == 0
