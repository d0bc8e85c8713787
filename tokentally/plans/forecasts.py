"""Forecast views (F1-F6) over the telemetry daily cost and over long daily series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokentally.operators import forecast as FC
from tokentally.operators.filters import Filters
from tokentally.plans import costs


def practice_daily_cost(tables, filters: Filters) -> DataFrame:
    """Q5 as one (ds, y) series per practice."""
    q = costs.cost_by_practice_over_time(tables, filters)
    return q.select("practice", F.col("date").alias("ds"), F.col("total_cost").alias("y"))


def orders_raw(spark: SparkSession, root: str, nan_rule: tuple[int, int] | None = None) -> DataFrame:
    """Order totals per priority and day (one row per order); ``nan_rule`` (m, r) puts NaN
    where the order key is r modulo m."""
    o = spark.read.parquet(f"{root.rstrip('/')}/orders.parquet")
    total = F.col("o_totalprice").cast("double")
    if nan_rule:
        total = F.when(F.col("o_orderkey") % nan_rule[0] == nan_rule[1], F.lit(float("nan"))).otherwise(total)
    return o.select(F.col("o_orderpriority").alias("priority"), F.to_date("o_orderdate").alias("ds"),
                    total.alias("y"))


def orders_daily(spark: SparkSession, root: str) -> DataFrame:
    """A long daily series per order priority (1995-2001) from the driver's
    ``orders`` table; the telemetry spans only 30 days, the back-test needs 44+."""
    return FC.normalize_daily(orders_raw(spark, root), ["priority"])


STEEP = (0.0, 1e3, 1e5, 1e6, 1e7)


def steep_series(spark: SparkSession, root: str, slopes=STEEP, level: float = 0.0) -> DataFrame:
    """The daily order totals in units of 100,000 on a level and a slope a day, by the priority's leading digit."""
    h = orders_daily(spark, root)
    day = F.datediff("ds", F.min("ds").over(Window.partitionBy("priority"))).cast("double")
    slope = F.element_at(F.array(*[F.lit(s) for s in slopes]), F.substring("priority", 1, 1).cast("int"))
    return h.select("priority", "ds", (F.col("y") / 100_000 + level + slope * day).alias("y"))


def daily_cost_forecast(tables, filters: Filters, periods: int = FC.PERIODS) -> FC.ForecastSummary:
    """The reference's forecast flow: Q9 daily totals under the filter as one
    series, gap-filled over the filter's dates, then F2-F6."""
    q = costs.daily_cost_totals(tables, filters)
    return FC.forecast_summary(q, (), periods=periods, date_start=filters.date_start,
                               date_end=filters.date_end)
