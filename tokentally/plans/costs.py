"""Q5-Q11: cost and token queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.functions.columns import event_day, level_rank, safe_ratio
from tokentally.operators.filters import Filters, filtered_fact
from tokentally.operators.rollups import prompts_with_session_cost, weighted_cost_sum

# Token types in display order.
TOKEN_TYPES = ["Input", "Output", "Cache Read", "Cache Creation"]


def cost_by_practice_over_time(tables, filters: Filters) -> DataFrame:
    """Q5: daily cost per practice."""
    ar = filtered_fact(tables, "api_requests", filters)
    return (ar.groupBy(event_day("timestamp").alias("date"), "practice")
              .agg(F.sum("cost_usd").alias("total_cost"))
              .orderBy("date", "practice"))


def cost_by_level_over_time(tables, filters: Filters) -> DataFrame:
    """Q6: daily cost per level, ordered by numeric level (L10 after L9) then date."""
    ar = filtered_fact(tables, "api_requests", filters)
    return (ar.groupBy(event_day("timestamp").alias("date"), "level")
              .agg(F.sum("cost_usd").alias("total_cost"))
              .orderBy(level_rank("level"), "date", "level"))


def token_breakdown(tables, filters: Filters) -> DataFrame:
    """Q7: four token totals as four rows in fixed order; zeros when empty."""
    ar = filtered_fact(tables, "api_requests", filters)
    sums = ar.agg(*[
        F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
        for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
    ])
    pairs = ", ".join(f"'{t}', {c}" for t, c in zip(
        TOKEN_TYPES, ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")))
    return sums.selectExpr(f"stack(4, {pairs}) AS (token_type, total)")


def avg_cost_per_session_over_time(tables, filters: Filters) -> DataFrame:
    """Q8: per day, prompt-weighted lifetime session cost / distinct sessions (K1, K3)."""
    up = filtered_fact(tables, "user_prompts", filters).select(
        "session_id", event_day("timestamp").alias("date"))
    j = prompts_with_session_cost(up, tables.session_cost(), ["date"])
    return (j.groupBy("date")
              .agg((F.coalesce(weighted_cost_sum(), F.lit(0.0)) / F.count(F.lit(1)))
                   .alias("avg_cost_per_session"))
              .orderBy("date"))


def daily_cost_totals(tables, filters: Filters) -> DataFrame:
    """Q9: the (ds, y) daily series used by forecasting."""
    ar = filtered_fact(tables, "api_requests", filters)
    return (ar.groupBy(event_day("timestamp").alias("ds"))
              .agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("y"))
              .orderBy("ds"))


def model_distribution(tables, filters: Filters) -> DataFrame:
    """Q10: calls and cost per model, most calls first."""
    ar = filtered_fact(tables, "api_requests", filters)
    return (ar.groupBy("model")
              .agg(F.count(F.lit(1)).alias("call_count"), F.sum("cost_usd").alias("total_cost"))
              .orderBy(F.desc("call_count"), "model"))


def cache_hit_rate(tables, filters: Filters) -> DataFrame:
    """Q11: cache reads / (input + cache read + cache creation); 0.0 if empty or zero."""
    ar = filtered_fact(tables, "api_requests", filters)
    total = (F.col("input_tokens").cast("bigint") + F.col("cache_read_tokens").cast("bigint")
             + F.col("cache_creation_tokens").cast("bigint"))
    agg = ar.agg(F.sum("cache_read_tokens").alias("reads"), F.sum(total).alias("total"))
    return agg.select(safe_ratio("reads", "total", 0.0).alias("cache_hit_rate"))
