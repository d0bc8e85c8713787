"""Daily series normalisation, trend + weekday forecast, anomalies,
rolling-origin back-test and the gated summary -- for many series at once.

The reference fits one series with Prophet on one machine.  Here every series
(keyed by any columns, e.g. practice) is fitted by plain aggregates:

    yhat(t) = a + b * t + s[weekday]

with (a, b) the least-squares line of y on t = days since the series' first
day and s the mean detrended value per weekday; the band is yhat +- z * sigma
with sigma the sample std of the in-sample residuals and z = 1.2816 (an 80 %
interval, Prophet's default width).  The numbers are a documented substitute
for Prophet's; gating, gap filling, the anomaly rule, cut-offs and metric
definitions follow the reference.

Series are one row per day, so per-series work is bounded by the date span,
not by the raw data volume.  Joins are on series keys (never cross joins);
with no keys a constant key column stands in.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokentally.session import ensure_checkpoint_dir


# Gating and back-test constants of the reference (days).
HISTORY_MIN_DAYS = 14
CV_MIN_DAYS = 44
CV_INITIAL = 29
CV_PERIOD = 7
CV_HORIZON = 14
PERIODS = 14
SIGMA_THRESHOLD = 2.0
Z_80 = 1.2816

# Status messages.
MSG_NO_DATA = "No daily cost data is available for the selected filters."
MSG_SHORT = "At least 14 days of daily cost history are required for forecasting."
MSG_NO_CV = "Cross-validation metrics require at least 44 days of history."
MSG_FAILED = "Forecasting failed: "

_NOKEY = "_series"


# Column names used inside the forecast operators; series keys must not reuse them.
_RESERVED = {"ds", "y", "yhat", "yhat_lower", "yhat_upper", "cutoff", "start", "last", "t", "dow",
             "a", "b", "sigma", "residual", "sd", "actual_cost", "expected_cost", "history_days",
             "raw_rows", "status", "message", "n_cutoffs", "mae", "mape", "coverage", "lo", "hi", "n",
             "s", "e"} | {f"{p}{d}" for p in ("n", "st", "sy", "stt", "sty", "syy", "s", "")
                                  for d in ("",) + tuple(str(i) for i in range(1, 8))} - {""}


def _keys(keys) -> list[str]:
    out = [keys] if isinstance(keys, str) else (list(keys) if keys else [])
    clash = sorted(set(out) & _RESERVED)
    if clash:
        raise ValueError(f"series key name(s) {clash} are used internally; rename them")
    return out


def _with_key(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    if keys:
        return df, keys
    return df.withColumn(_NOKEY, F.lit(0)), [_NOKEY]


def _drop_key(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.drop(_NOKEY) if keys == [_NOKEY] else df


def _date_lit(d) -> Column:
    if d is None:
        return F.lit(None).cast("date")
    if isinstance(d, str):
        d = _dt.date.fromisoformat(d[:10])
    if isinstance(d, _dt.datetime):
        d = d.date()
    return F.lit(d)


# ---------------------------------------------------------------------------------------
# F1


def normalize_daily(df: DataFrame, keys=(), ds: str = "ds", y: str = "y",
                    date_start=None, date_end=None) -> DataFrame:
    """per series, sum per day and fill every day from ``date_start`` (else the
    first day) to min(``date_end``, last actual day) with 0.0 (K16).  Rows outside
    the range drop.  With no keys and no rows, both dates give an all-zero series
    (K17); otherwise an empty result.  Output: keys..., ds, y.
    """
    keys = _keys(keys)
    return _drop_key(*_fill_days(*_daily_totals(df, keys, ds, y), date_start, date_end))


def _daily_totals(df: DataFrame, keys: list[str], ds: str, y: str) -> tuple[DataFrame, list[str]]:
    """(keys..., ds, y, n): one row per series and day with its sum and its raw row count."""
    value = F.col(y).cast("double")
    d = df.select(*keys, F.to_date(F.col(ds)).alias("ds"), F.when(~F.isnan(value), value).alias("y"))  # NaN counts as missing
    d, k = _with_key(d, keys)
    return d.groupBy(*k, "ds").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")), k


def _fill_days(daily: DataFrame, k: list[str], date_start, date_end) -> tuple[DataFrame, list[str]]:
    """The gap-filled series (keys..., ds, y) of daily totals; see ``normalize_daily``."""
    keys = [] if k == [_NOKEY] else k
    ds0, ds1 = _date_lit(date_start), _date_lit(date_end)
    if keys:
        bounds = daily.groupBy(*k).agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    else:
        # A global aggregate always yields one row, so empty input still has bounds.
        bounds = daily.agg(F.min("ds").alias("lo"), F.max("ds").alias("hi")).withColumn(_NOKEY, F.lit(0))
    both = F.lit(date_start is not None and date_end is not None)
    start = F.coalesce(ds0, F.col("lo"))
    end = F.when(F.col("hi").isNull(), F.when(both, ds1)) \
           .otherwise(F.least(F.coalesce(ds1, F.col("hi")), F.col("hi")))
    spans = bounds.select(*k, start.alias("s"), end.alias("e")) \
                  .where(F.col("s").isNotNull() & F.col("e").isNotNull() & (F.col("s") <= F.col("e")))
    days = spans.select(*k, F.explode(F.sequence("s", "e", F.expr("INTERVAL 1 DAY"))).alias("ds"))
    return days.join(daily, [*k, "ds"], "left").select(*k, "ds", F.coalesce("y", F.lit(0.0)).alias("y")), k


# ---------------------------------------------------------------------------------------
# F2


def _t(ds: Column, start: Column) -> Column:
    return F.datediff(ds, start).cast("double")


def fit_rows(rows: DataFrame, keys: list[str], z: float = Z_80) -> DataFrame:
    """F2 as window functions: ``rows`` (keys..., ds, y) hold every day to fit and
    to predict, with y NULL on days to predict.  Adds yhat, yhat_lower, yhat_upper
    fitted on each series' rows with y.

    All statistics are windows partitioned by the series key (the weekday means
    by key and weekday, which the same hash partitioning satisfies), so the whole
    fit costs one shuffle and no joins.  A series is one row per day, so a
    window partition is bounded by the series' span.
    """
    w = Window.partitionBy(*keys)
    wd = Window.partitionBy(*keys, "_dow")
    hist = F.col("y").isNotNull()
    # Few wide selects rather than a chain of withColumn calls.
    r = rows.select("*", F.dayofweek("ds").alias("_dow"), F.min(F.when(hist, F.col("ds"))).over(w).alias("_start"))
    r = r.select("*", _t(F.col("ds"), F.col("_start")).alias("_t"))
    th = F.when(hist, F.col("_t"))
    r = r.select("*", F.count(th).over(w).cast("double").alias("_n"), F.sum(th).over(w).alias("_st"),
                 F.sum("y").over(w).alias("_sy"), F.sum(th * th).over(w).alias("_stt"),
                 F.sum(th * F.col("y")).over(w).alias("_sty"))
    n, st, sy, stt, sty = (F.col(c) for c in ("_n", "_st", "_sy", "_stt", "_sty"))
    den = n * stt - st * st
    b = F.when(den != 0, (n * sty - st * sy) / den).otherwise(F.lit(0.0))
    r = r.select("*", b.alias("_b"))
    r = r.select("*", ((sy - F.col("_b") * st) / n).alias("_a"))
    r = r.select("*", (F.col("_a") + F.col("_b") * F.col("_t")).alias("_trend"))
    r = r.select("*", F.avg(F.when(hist, F.col("y") - F.col("_trend"))).over(wd).alias("_s"))
    r = r.select("*", (F.col("_trend") + F.coalesce(F.col("_s"), F.lit(0.0))).alias("yhat"))
    r = r.select("*", F.coalesce(F.stddev_samp(F.when(hist, F.col("y") - F.col("yhat"))).over(w),
                                 F.lit(0.0)).alias("_sigma"))
    keep = [c for c in r.columns if not c.startswith("_") or c in keys]
    return r.select(*keep, (F.col("yhat") - F.lit(z) * F.col("_sigma")).alias("yhat_lower"),
                    (F.col("yhat") + F.lit(z) * F.col("_sigma")).alias("yhat_upper"))


def _with_future(h: DataFrame, k: list[str], periods: int) -> DataFrame:
    """History rows plus ``periods`` days after each series' last day (y NULL)."""
    last = h.groupBy(*k).agg(F.max("ds").alias("_last"))
    fut = last.select(*k, F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", periods),
                                               F.expr("INTERVAL 1 DAY"))).alias("ds"),
                      F.lit(None).cast("double").alias("y"))
    return h.select(*k, "ds", F.col("y").cast("double").alias("y")).unionByName(fut)


def fit_predict(history: DataFrame, keys=(), periods: int = PERIODS) -> DataFrame:
    """history and ``periods`` future days per series with yhat and band."""
    keys = _keys(keys)
    h, k = _with_key(history, keys)
    out = fit_rows(_with_future(h, k, periods), k).select(*k, "ds", "yhat", "yhat_lower", "yhat_upper")
    return _drop_key(out, k)


# ---------------------------------------------------------------------------------------
# F3


def detect_anomalies(history_fit: DataFrame, keys=(), sigma_threshold: float = SIGMA_THRESHOLD) -> DataFrame:
    """days whose |y - yhat| exceeds ``sigma_threshold`` sample stds of the
    series' residuals; none when that std is NULL or 0."""
    keys = _keys(keys)
    h, k = _with_key(history_fit, keys)
    r = h.withColumn("residual", F.col("y").cast("double") - F.col("yhat").cast("double"))
    r = r.withColumn("sd", F.stddev_samp("residual").over(Window.partitionBy(*k)))
    out = (r.where(F.col("sd").isNotNull() & (F.col("sd") != 0)
                   & (F.abs("residual") > F.lit(sigma_threshold) * F.col("sd")))
            .select(*k, "ds", F.col("y").cast("double").alias("actual_cost"),
                    F.col("yhat").cast("double").alias("expected_cost"), "residual"))
    return _drop_key(out, k)


# ---------------------------------------------------------------------------------------
# F4 / F5


def cutoffs(history: DataFrame, keys: list[str], initial: int = CV_INITIAL,
            period: int = CV_PERIOD, horizon: int = CV_HORIZON,
            min_days: int = CV_MIN_DAYS) -> DataFrame:
    """Cut-off days last - horizon - period*k that leave ``initial`` days before them,
    for series with at least ``min_days`` days."""
    b = history.groupBy(*keys).agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"),
                                   F.count(F.lit(1)).alias("n"))
    kmax = F.floor((F.datediff("hi", "lo") - F.lit(horizon + initial)) / F.lit(period)).cast("int")
    return (b.where((F.col("n") >= min_days) & (kmax >= 0))
             .select(*keys, "hi", F.explode(F.sequence(F.lit(0), kmax)).alias("_step"))
             .select(*keys, F.date_sub("hi", F.lit(horizon) + F.lit(period) * F.col("_step")).alias("cutoff")))


def safe_mape(actual: Column, predicted: Column) -> Column:
    """F5 (aggregate): mean |y - yhat| / |y| over rows with y != 0; NULL if none."""
    return F.avg(F.when(actual.isNotNull() & predicted.isNotNull() & (actual != 0),
                        F.abs(actual - predicted) / F.abs(actual)))


def _score(scored: DataFrame, k: list[str]) -> DataFrame:
    return scored.groupBy(*k).agg(
        F.countDistinct("cutoff").alias("n_cutoffs"),
        F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("mae"),
        safe_mape(F.col("y"), F.col("yhat")).alias("mape"),
        F.avg(F.when((F.col("y") >= F.col("yhat_lower")) & (F.col("y") <= F.col("yhat_upper")), 1.0)
               .otherwise(0.0)).alias("coverage"))


def backtest_rows(history: DataFrame, keys=(), horizon: int = CV_HORIZON) -> DataFrame:
    """The days that F4 scores: keys..., cutoff, ds, y, yhat, sigma, as fitted on the days up to the cut-off.

    The refits are not recomputed from the raw days: running means and co-moments (Spark's updating
    aggregates), overall and per weekday, hold the line and the weekday effects of every cut-off. The
    residual sum of squares is the running sum of squared recursive residuals: what a day misses the
    line of the days before it by, over its leverage. All its terms are positive, so nothing cancels,
    however steep the trend or large the totals; the whole series' line is taken off first.
    One window per series, one row per day: linear in days instead of days x cut-offs.
    """
    keys = _keys(keys)
    h, k = _with_key(history.select(*keys, "ds", F.col("y").cast("double").alias("y")), keys)
    return _drop_key(_backtest_rows(h, k, horizon), k)


def _backtest_rows(h: DataFrame, k: list[str], horizon: int) -> DataFrame:
    series, run = Window.partitionBy(*k), Window.partitionBy(*k).orderBy("ds")
    upto = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    d = h.select(*k, "ds", "y", F.min("ds").over(series).alias("start"), F.dayofweek("ds").alias("dow"))
    d = d.select("*", _t(F.col("ds"), F.col("start")).alias("t"))
    d = d.select("*", zero(F.regr_slope("y", "t").over(series)).alias("slope"))
    d = d.select("*", F.avg(F.col("y") - F.col("slope") * F.col("t")).over(series).alias("level"))
    d = d.select("*", (F.col("y") - F.col("level") - F.col("slope") * F.col("t")).alias("z"))
    moments = [F.count("z").over(upto).cast("double").alias("n"), F.avg("t").over(upto).alias("mt"), F.avg("z").over(upto).alias("mz"),
               F.var_pop("t").over(upto).alias("vt"), F.covar_pop("t", "z").over(upto).alias("vtz")]
    for dw in range(1, 8):
        own = F.col("dow") == dw
        moments += [F.count(F.when(own, 1)).over(upto).alias(f"n{dw}"), F.avg(F.when(own, F.col("t"))).over(upto).alias(f"mt{dw}"),
                    F.avg(F.when(own, F.col("z"))).over(upto).alias(f"mz{dw}")]
    d = d.select("*", *moments)
    before = {c: F.lag(c).over(run) for c in ("n", "mt", "mz", "vt", "vtz")}
    off = F.col("t") - before["mt"]
    miss = F.col("z") - before["mz"] - before["vtz"] / before["vt"] * off
    leverage = (1 + off * off / before["vt"]) / before["n"]
    d = d.select("*", F.when(before["vt"] > 0, miss * miss / (1 + leverage)).otherwise(F.lit(0.0)).alias("w"))
    d = d.select("*", F.sum("w").over(upto).alias("sse"), F.when(F.col("vt") > 0, F.col("vtz") / F.col("vt")).otherwise(F.lit(0.0)).alias("b"))
    cuts = cutoffs(h, k, horizon=horizon).withColumnRenamed("cutoff", "ds")
    seasons = [zero(F.col(f"mz{dw}") - F.col("mz") - F.col("b") * (F.col(f"mt{dw}") - F.col("mt"))).alias(f"s{dw}") for dw in range(1, 8)]
    p = d.join(cuts, [*k, "ds"], "left_semi").select("*", *seasons)
    rest = F.col("sse") - sum((F.col(f"n{dw}") * F.col(f"s{dw}") * F.col(f"s{dw}") for dw in range(1, 8)), F.lit(0.0))
    sigma = F.when(F.col("n") > 1, F.sqrt(F.greatest(rest, F.lit(0.0)) / (F.col("n") - 1))).otherwise(F.lit(0.0))
    params = p.select(*k, F.col("ds").alias("cutoff"), "start", "slope", "level", "mt", "mz", "b", sigma.alias("sigma"), *[f"s{dw}" for dw in range(1, 8)])
    test = params.select("*", F.explode(F.sequence(F.date_add("cutoff", 1), F.date_add("cutoff", horizon), F.expr("INTERVAL 1 DAY"))).alias("ds")) \
        .join(h, [*k, "ds"])
    t = _t(F.col("ds"), F.col("start"))
    season = F.element_at(F.array(*[F.col(f"s{dw}") for dw in range(1, 8)]), F.dayofweek("ds"))
    yhat = F.col("level") + F.col("slope") * t + (F.col("mz") + F.col("b") * (t - F.col("mt")) + season)
    return test.select(*k, "cutoff", "ds", "y", yhat.alias("yhat"), "sigma")


def backtest(history: DataFrame, keys=(), horizon: int = CV_HORIZON, z: float = Z_80) -> DataFrame:
    """refit at every cut-off on the days up to it, score the next ``horizon``
    days; per series the mean absolute error, zero-safe MAPE and band coverage.
    Output: keys..., n_cutoffs, mae, mape, coverage.
    """
    keys = _keys(keys)
    h, k = _with_key(history.select(*keys, "ds", F.col("y").cast("double").alias("y")), keys)
    rows = _backtest_rows(h, k, horizon)
    width = F.lit(z) * F.col("sigma")
    return _drop_key(_score(rows.select("*", (F.col("yhat") - width).alias("yhat_lower"), (F.col("yhat") + width).alias("yhat_upper")), k), k)


# ---------------------------------------------------------------------------------------
# Bands that hold what they promise


def conformal_widths(rows: DataFrame, keys=(), level: float = 0.8) -> DataFrame:
    """(keys..., step, width, n): per series and days ahead, the conformal quantile of the back-test's |y - yhat|.

    ``rows`` are those of ``backtest_rows``. Of n misses the width is the ceil(level * (n + 1))-th smallest (the
    largest, if there are too few), so a further miss stays within it in ``level`` of all cases if
    misses are exchangeable, whatever their distribution. A group is a series' cut-offs at one step: bounded by its days.
    """
    keys = _keys(keys)
    r, k = _with_key(rows, keys)
    return _drop_key(_widths(r, k, level), k)


def _widths(r: DataFrame, k: list[str], level: float) -> DataFrame:
    r = r.select(*k, F.datediff("ds", "cutoff").alias("step"), F.abs(F.col("y") - F.col("yhat")).alias("width"))
    own = Window.partitionBy(*k, "step")
    r = r.select("*", F.row_number().over(own.orderBy("width")).alias("_nth"), F.count(F.lit(1)).over(own).alias("n"))
    want = F.least(F.ceil(F.lit(level) * (F.col("n") + 1)), F.col("n"))
    return r.where(F.col("_nth") == want).select(*k, "step", "width", "n")


def conformal_forecast(history: DataFrame, keys=(), periods: int = PERIODS, level: float = 0.8) -> DataFrame:
    """F2's future days with conformal bands: keys..., ds, yhat, yhat_lower, yhat_upper.

    Needs the days of one cut-off at least (``CV_MIN_DAYS``); series with fewer have no rows.
    """
    keys = _keys(keys)
    h, k = _with_key(history.select(*keys, "ds", F.col("y").cast("double").alias("y")), keys)
    widths = _widths(_backtest_rows(h, k, periods), k, level)
    future = fit_rows(_with_future(h, k, periods), k).where("y is null").select(
        *k, "ds", "yhat", F.row_number().over(Window.partitionBy(*k).orderBy("ds")).alias("step"))
    out = future.join(widths, [*k, "step"])
    return _drop_key(out.select(*k, "ds", "yhat", (F.col("yhat") - F.col("width")).alias("yhat_lower"), (F.col("yhat") + F.col("width")).alias("yhat_upper")), k)


def conformal_coverage(history: DataFrame, keys=(), horizon: int = CV_HORIZON, level: float = 0.8) -> DataFrame:
    """(keys..., n_days, coverage): share of back-test days within the bands, judged by cut-offs that did not set them.

    Every second cut-off, counted from a series' last, sets the widths; the others are scored.
    """
    keys = _keys(keys)
    h, k = _with_key(history.select(*keys, "ds", F.col("y").cast("double").alias("y")), keys)
    rows = _backtest_rows(h, k, horizon)
    last = F.max("cutoff").over(Window.partitionBy(*k))
    rows = rows.select("*", (F.floor(F.datediff(last, F.col("cutoff")) / F.lit(CV_PERIOD)) % 2 == 0).alias("_sets"))
    widths = _widths(rows.where("_sets"), k, level)
    scored = rows.where("not _sets").withColumn("step", F.datediff("ds", "cutoff")).join(widths.drop("n"), [*k, "step"])
    return _drop_key(scored.groupBy(*k).agg(F.count(F.lit(1)).alias("n_days"),
                                            F.avg(F.when(F.abs(F.col("y") - F.col("yhat")) <= F.col("width"), 1.0).otherwise(0.0)).alias("coverage")), k)


# ---------------------------------------------------------------------------------------
# F6


@dataclass
class ForecastSummary:
    """The outputs of F6; they read small checkpointed frames (daily totals, daily
    history and fitted days), never the raw rows."""

    status: DataFrame      # keys..., status, message, history_days
    history: DataFrame     # keys..., ds, y
    forecast: DataFrame    # keys..., ds, yhat, yhat_lower, yhat_upper (future days of ok series)
    anomalies: DataFrame   # keys..., ds, actual_cost, expected_cost, residual
    metrics: DataFrame     # keys..., n_cutoffs, mae, mape, coverage (series with >= 44 days)


def forecast_summary(df: DataFrame, keys=(), ds: str = "ds", y: str = "y", periods: int = PERIODS,
                     date_start=None, date_end=None) -> ForecastSummary:
    """gate each series on its length, then forecast, flag and back-test.

    insufficient_data: no rows, or fewer than 14 days after F1;
    forecast_error:    the fit is degenerate (non-finite coefficients);
    ok:                message set when there are fewer than 44 days (no metrics); a
                       gap-filled series of 44 days always has a cut-off.
    The raw rows are read once, for the daily totals with their row counts.
    """
    keys = _keys(keys)
    # Daily totals, daily history (days x series rows) and fitted days are small and
    # read several times below: checkpoint them to the shared folder once, which
    # cuts their lineage and keeps the plans of the four outputs short.
    ensure_checkpoint_dir(df.sparkSession)
    totals, k = _daily_totals(df, keys, ds, y)
    totals = totals.checkpoint(eager=True)
    h = _fill_days(totals, k, date_start, date_end)[0].checkpoint(eager=True)
    if not keys:
        return _single_series_summary(totals, h, k, periods)
    n = h.groupBy(*k).agg(F.count(F.lit(1)).alias("history_days"))
    base = totals.groupBy(*k).agg(F.sum("n").alias("raw_rows")).join(n, k, "left").select(
        *k, "raw_rows", F.coalesce("history_days", F.lit(0)).cast("bigint").alias("history_days"))
    ok_h = h.join(base.where(F.col("history_days") >= HISTORY_MIN_DAYS).select(*k), k, "left_semi")
    # One fit per series over history + future days; read by status, forecast and
    # anomalies.
    fitted = fit_rows(_with_future(ok_h, k, periods), k).checkpoint(eager=True)
    bad_fit = fitted.groupBy(*k).agg(
        F.max(F.when(F.col("yhat").isNull() | F.isnan("yhat"), 1).otherwise(0)).alias("_bad"))
    status = base.join(bad_fit, k, "left").select(
        *k, *_status_cols(F.col("raw_rows"), F.col("history_days"), F.coalesce(F.col("_bad") == 1, F.lit(False))))
    good = status.where(F.col("status") == "ok").select(*k)
    anomalies = detect_anomalies(fitted.where(F.col("y").isNotNull()).join(good, k, "left_semi"), k)
    fut = fitted.where(F.col("y").isNull()).join(good, k, "left_semi") \
        .select(*k, "ds", "yhat", "yhat_lower", "yhat_upper")
    long_h = ok_h.join(base.where(F.col("history_days") >= CV_MIN_DAYS).select(*k), k, "left_semi") \
                 .join(good, k, "left_semi")
    metrics = backtest(long_h, k)
    return ForecastSummary(
        status=_drop_key(status.select(*k, "status", "message", "history_days"), k),
        history=_drop_key(h, k), forecast=_drop_key(fut, k),
        anomalies=_drop_key(anomalies, k), metrics=_drop_key(metrics, k))


def _status_cols(raw_rows: Column, days: Column, bad: Column) -> list[Column]:
    return [
        F.when(raw_rows == 0, F.lit("insufficient_data"))
         .when(days < HISTORY_MIN_DAYS, F.lit("insufficient_data"))
         .when(bad, F.lit("forecast_error"))
         .otherwise(F.lit("ok")).alias("status"),
        F.when(raw_rows == 0, F.lit(MSG_NO_DATA))
         .when(days < HISTORY_MIN_DAYS, F.lit(MSG_SHORT))
         .when(bad, F.lit(MSG_FAILED + "degenerate series"))
         .when(days < CV_MIN_DAYS, F.lit(MSG_NO_CV)).alias("message"),
        days.cast("bigint").alias("history_days"),
    ]


def _single_series_summary(totals: DataFrame, h: DataFrame, k: list[str], periods: int) -> ForecastSummary:
    """F6 for one series: the counts and the fit flag are scalar subqueries, so
    no output needs a join (a join on the constant series key would be a cross
    join)."""
    raw_rows = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    days = h.agg(F.count(F.lit(1))).scalar()
    enough = days >= HISTORY_MIN_DAYS
    fitted = fit_rows(_with_future(h.where(enough), k, periods), k).checkpoint(eager=True)
    bad = F.coalesce(fitted.agg(F.max(F.col("yhat").isNull() | F.isnan("yhat"))).scalar(), F.lit(False))
    ok = (raw_rows > 0) & enough & ~bad
    status = h.sparkSession.range(1).select(*_status_cols(raw_rows, days, bad))
    anomalies = detect_anomalies(fitted.where(F.col("y").isNotNull() & ok), k)
    fut = fitted.where(F.col("y").isNull() & ok).select(*k, "ds", "yhat", "yhat_lower", "yhat_upper")
    metrics = backtest(h.where(ok & (days >= CV_MIN_DAYS)), k)
    return ForecastSummary(status=status, history=_drop_key(h, k), forecast=_drop_key(fut, k),
                           anomalies=_drop_key(anomalies, k), metrics=_drop_key(metrics, k))
