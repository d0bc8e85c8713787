"""Reshaped views of query results (P1-P9), as the dashboard uses them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.operators import reshape as R
from tokentally.operators.filters import Filters
from tokentally.plans import activity, costs, sessions, tools


def heatmap_matrix(tables, filters: Filters) -> DataFrame:
    return R.heatmap_pivot(activity.hourly_heatmap(tables, filters))


def weekday_counts_sorted(tables, filters: Filters) -> DataFrame:
    return R.weekday_sorted(activity.day_of_week_counts(tables, filters))


def accept_reject_long(tables, filters: Filters) -> DataFrame:
    return R.accept_reject_long(tools.tool_accept_reject(tables, filters))


def session_duration_histogram(tables, filters: Filters) -> DataFrame:
    return R.log_histogram(sessions.session_duration_hist(tables, filters), "duration_mins")


def session_cost_box(tables, filters: Filters) -> DataFrame:
    return R.box_stats(sessions.session_cost_by_practice(tables, filters), "practice", "total_cost")


def error_codes_sorted(tables, filters: Filters) -> DataFrame:
    return R.status_code_order(sessions.error_breakdown(tables, filters))


def model_share(tables, filters: Filters) -> DataFrame:
    return R.with_share(costs.model_distribution(tables, filters), "call_count")


def business_hours_share(tables, filters: Filters) -> DataFrame:
    return R.with_share(activity.business_hours_split(tables, filters), "session_count")


def daily_cost_series(tables, filters: Filters) -> DataFrame:
    """Q9 as it arrives over JSON (text values) and is coerced back."""
    raw = costs.daily_cost_totals(tables, filters).select(
        F.col("ds").cast("string").alias("ds"), F.col("y").cast("string").alias("y"))
    return R.normalize_series(raw, ["y"])


RESHAPED = {
    "p1_heatmap_pivot": heatmap_matrix,
    "p2_weekday_sorted": weekday_counts_sorted,
    "p3_accept_reject_unpivot": accept_reject_long,
    "p4_log_histogram": session_duration_histogram,
    "p5_box_stats": session_cost_box,
    "p6_status_code_order": error_codes_sorted,
    "p8_model_share": model_share,
    "p8_business_hours_share": business_hours_share,
    "p9_normalize_series": daily_cost_series,
}
