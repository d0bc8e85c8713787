"""The forecast fit and its back-test the direct way: each cut-off joined with its training days and refitted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.operators.forecast import CV_HORIZON, Z_80, _drop_key, _keys, _score, _t, _with_key, cutoffs


@dataclass
class Model:
    """Fitted parameters: one row per series (start, a, b, sigma, last) and one row
    per (series, weekday) for the weekday effect."""

    keys: list[str]
    coef: DataFrame
    season: DataFrame


def fit(history: DataFrame, keys: list[str]) -> Model:
    """F2 fit.  Least squares from sums (n, St, Sy, Stt, Sty) in one aggregate."""
    h = history.select(*keys, "ds", F.col("y").cast("double").alias("y"))
    first = h.groupBy(*keys).agg(F.min("ds").alias("start"), F.max("ds").alias("last"))
    h = h.join(first, keys).withColumn("t", _t(F.col("ds"), F.col("start")))
    s = h.groupBy(*keys, "start", "last").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("t").alias("st"), F.sum("y").alias("sy"),
        F.sum(F.col("t") * F.col("t")).alias("stt"), F.sum(F.col("t") * F.col("y")).alias("sty"))
    den = F.col("n") * F.col("stt") - F.col("st") * F.col("st")
    b = F.when(den != 0, (F.col("n") * F.col("sty") - F.col("st") * F.col("sy")) / den).otherwise(F.lit(0.0))
    coef = s.select(*keys, "start", "last", "n", b.alias("b"), "sy", "st")
    coef = coef.select(*keys, "start", "last", "n", "b",
                       ((F.col("sy") - F.col("b") * F.col("st")) / F.col("n")).alias("a"))
    trend = h.join(coef.select(*keys, "a", "b"), keys) \
             .withColumn("r", F.col("y") - (F.col("a") + F.col("b") * F.col("t")))
    season = trend.groupBy(*keys, F.dayofweek("ds").alias("dow")).agg(F.avg("r").alias("s"))
    fitted = _apply(coef, season, keys, h.select(*keys, "ds", "y"))
    sigma = fitted.groupBy(*keys).agg(
        F.coalesce(F.stddev_samp(F.col("y") - F.col("yhat")), F.lit(0.0)).alias("sigma"))
    coef = coef.join(sigma, keys, "left").withColumn("sigma", F.coalesce("sigma", F.lit(0.0)))
    return Model(keys, coef, season)


def _apply(coef: DataFrame, season: DataFrame, keys: list[str], rows: DataFrame) -> DataFrame:
    r = rows.join(coef.select(*keys, "start", "a", "b"), keys) \
            .withColumn("dow", F.dayofweek("ds"))
    r = r.join(season, [*keys, "dow"], "left")
    yhat = F.col("a") + F.col("b") * _t(F.col("ds"), F.col("start")) + F.coalesce(F.col("s"), F.lit(0.0))
    return r.withColumn("yhat", yhat).drop("start", "a", "b", "dow", "s")


def predict(model: Model, rows: DataFrame, z: float = Z_80) -> DataFrame:
    """yhat and the band for arbitrary (keys, ds) rows."""
    k = model.keys
    out = _apply(model.coef, model.season, k, rows)
    out = out.join(model.coef.select(*k, "sigma"), k)
    return (out.withColumn("yhat_lower", F.col("yhat") - F.lit(z) * F.col("sigma"))
               .withColumn("yhat_upper", F.col("yhat") + F.lit(z) * F.col("sigma"))
               .drop("sigma"))


def backtest_refit(history: DataFrame, keys=(), horizon: int = CV_HORIZON, z: float = Z_80) -> DataFrame:
    """F4 the direct way: join each cut-off to its training days and refit.
    Same result as ``backtest``; kept as its reference (work is days x cut-offs)."""
    keys = _keys(keys)
    h, k = _with_key(history.select(*keys, "ds", F.col("y").cast("double").alias("y")), keys)
    cuts = cutoffs(h, k, horizon=horizon)
    sid = [*k, "cutoff"]
    paired = h.join(cuts, k)
    train = paired.where(F.col("ds") <= F.col("cutoff")).select(*sid, "ds", "y")
    test = paired.where((F.col("ds") > F.col("cutoff"))
                        & (F.col("ds") <= F.date_add("cutoff", horizon))).select(*sid, "ds", "y")
    m = fit(train, sid)
    return _drop_key(_score(predict(m, test, z), k), k)
