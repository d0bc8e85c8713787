"""Q1-Q4: overview KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.functions.columns import event_day, minutes_between, safe_ratio
from tokentally.operators.filters import Filters, filtered_fact

# Cache saving per cache-read token = (input 3.00 - cache read 0.30) $/MTok,
# one price for all models.
CACHE_SAVINGS_PER_TOKEN = (3.00 - 0.30) / 1_000_000


def kpi_metrics(tables, filters: Filters) -> DataFrame:
    """Q1: sessions, engineers and cost from requests; error rate = errors / requests (K4, K9).

    Requests and errors are stacked into one frame and aggregated once, so the
    two facts never meet in a join (no fan-out) and no cross join is needed.
    """
    ar = filtered_fact(tables, "api_requests", filters).select(
        "session_id", "user_email", "cost_usd",
        F.lit(1).alias("is_request"), F.lit(0).alias("is_error"))
    ae = filtered_fact(tables, "api_errors", filters).select(
        F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("string").alias("user_email"),
        F.lit(None).cast("double").alias("cost_usd"),
        F.lit(0).alias("is_request"), F.lit(1).alias("is_error"))
    agg = ar.unionByName(ae).agg(
        F.countDistinct("session_id").alias("total_sessions"),
        F.countDistinct("user_email").alias("active_engineers"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost"),
        F.coalesce(F.sum("is_request"), F.lit(0)).cast("bigint").alias("total_requests"),
        F.coalesce(F.sum("is_error"), F.lit(0)).cast("bigint").alias("total_errors"),
    )
    return agg.select(
        "total_sessions", "active_engineers", "total_cost",
        safe_ratio("total_errors", "total_requests", 0.0).alias("error_rate"),
    )


def daily_sessions(tables, filters: Filters) -> DataFrame:
    """Q2: distinct prompt sessions per day (a session counts on each day it is active, K5)."""
    up = filtered_fact(tables, "user_prompts", filters)
    return (up.groupBy(event_day("timestamp").alias("date"))
              .agg(F.countDistinct("session_id").alias("session_count"))
              .orderBy("date"))


def session_kpis(tables, filters: Filters) -> DataFrame:
    """Q3: mean session span (minutes, from requests) and prompts per session; 0.0 when empty."""
    durations = (filtered_fact(tables, "api_requests", filters)
                 .groupBy("session_id")
                 .agg(minutes_between(F.min("timestamp"), F.max("timestamp")).alias("dur"))
                 .select("dur", F.lit(None).cast("string").alias("prompt_session")))
    prompts = filtered_fact(tables, "user_prompts", filters).select(
        F.lit(None).cast("double").alias("dur"), F.col("session_id").alias("prompt_session"))
    agg = durations.unionByName(prompts).agg(
        F.avg("dur").alias("avg_dur"),
        F.count("prompt_session").alias("n_prompts"),
        F.countDistinct("prompt_session").alias("n_sessions"),
    )
    return agg.select(
        F.coalesce(F.col("avg_dur"), F.lit(0.0)).alias("avg_duration_mins"),
        safe_ratio("n_prompts", "n_sessions", 0.0).alias("avg_prompts_per_session"),
    )


def cache_savings(tables, filters: Filters, per_token: float = CACHE_SAVINGS_PER_TOKEN) -> DataFrame:
    """Q4: cache-read tokens x one saving price."""
    ar = filtered_fact(tables, "api_requests", filters)
    return ar.agg(
        (F.coalesce(F.sum("cache_read_tokens"), F.lit(0)).cast("double") * F.lit(per_token))
        .alias("cache_savings_usd"))
