"""Q16-Q18: activity patterns (UTC wall clock, K11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.functions.columns import hour_of_day, weekday_name
from tokentally.operators.filters import Filters, filtered_fact

# Category labels (the business label uses an en dash; 17:xx is inside, K6).
BUSINESS_HOURS = "Business Hours (9–17)"
AFTER_HOURS = "After Hours"


def hourly_heatmap(tables, filters: Filters) -> DataFrame:
    """Q16: distinct sessions per (hour, weekday); cells do not add up to totals (K5)."""
    up = filtered_fact(tables, "user_prompts", filters)
    return (up.groupBy(hour_of_day("timestamp").alias("hour"),
                       weekday_name("timestamp").alias("day_of_week"))
              .agg(F.countDistinct("session_id").alias("session_count")))


def day_of_week_counts(tables, filters: Filters) -> DataFrame:
    """Q17: distinct sessions per weekday name."""
    up = filtered_fact(tables, "user_prompts", filters)
    return (up.groupBy(weekday_name("timestamp").alias("day_of_week"))
              .agg(F.countDistinct("session_id").alias("session_count")))


def business_hours_split(tables, filters: Filters) -> DataFrame:
    """Q18: distinct sessions inside hours 9..17 inclusive vs outside."""
    up = filtered_fact(tables, "user_prompts", filters)
    cat = F.when(F.hour("timestamp").between(9, 17), F.lit(BUSINESS_HOURS)).otherwise(F.lit(AFTER_HOURS))
    return up.groupBy(cat.alias("category")).agg(F.countDistinct("session_id").alias("session_count"))
