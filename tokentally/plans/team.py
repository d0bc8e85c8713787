"""Q12-Q15: team and engineer queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.functions.columns import level_rank
from tokentally.operators.filters import Filters, filtered_fact
from tokentally.session import ensure_checkpoint_dir
from tokentally.operators.rollups import (
    favourite_model,
    prompts_with_session_cost,
    weighted_cost_sum,
)

MAX_TOP = 100_000
TOP_ENGINEERS = 10


def usage_by_practice(tables, filters: Filters) -> DataFrame:
    """Q12: distinct prompt sessions and prompt-weighted session cost per practice (K1, K3)."""
    up = filtered_fact(tables, "user_prompts", filters).select("session_id", "practice")
    j = prompts_with_session_cost(up, tables.session_cost(), ["practice"])
    return (j.groupBy("practice")
              .agg(F.count(F.lit(1)).alias("session_count"),
                   F.coalesce(weighted_cost_sum(), F.lit(0.0)).alias("total_cost"))
              .orderBy(F.desc("session_count"), "practice"))


def usage_by_level(tables, filters: Filters) -> DataFrame:
    """Q13: distinct prompt sessions per level, numeric level order."""
    up = filtered_fact(tables, "user_prompts", filters)
    return (up.groupBy("level").agg(F.countDistinct("session_id").alias("session_count"))
              .orderBy(level_rank("level"), "level"))


def top_engineers(tables, filters: Filters, k: int = TOP_ENGINEERS) -> DataFrame:
    """Q14: top-k engineers by distinct sessions, with cost and favourite model.

    Ties at rank k go to the lower email (K8).  The favourite model ignores the
    filters (K7) and is computed only for the k winners: their emails are a
    bounded broadcast semi-join into ``api_requests``.
    """
    if k > MAX_TOP:
        raise ValueError(f"k = {k}: the k winners are broadcast, at most {MAX_TOP}")
    up = filtered_fact(tables, "user_prompts", filters).select(
        "session_id", "email", "full_name", "practice", "level")
    j = prompts_with_session_cost(up, tables.session_cost(),
                                  ["email", "full_name", "practice", "level"])
    per_engineer = (j.groupBy("full_name", "practice", "level", "email")
                     .agg(F.count(F.lit(1)).alias("session_count"),
                          F.coalesce(weighted_cost_sum(), F.lit(0.0)).alias("total_cost")))
    top = (per_engineer
           .withColumn("avg_cost_per_session",
                       F.try_divide(F.col("total_cost"), F.col("session_count").cast("double")))
           .orderBy(F.desc("session_count"), "email")
           .limit(k))
    # The k winners are used twice (output and favourite-model semi-join): write
    # them once to the shared checkpoint folder instead of ranking prompts twice.
    ensure_checkpoint_dir(tables.employees.sparkSession)
    top = top.checkpoint(eager=True)
    fav = favourite_model(tables.api_requests, top.select("email"))
    # fav has at most k rows (one per winner)
    out = top.join(F.broadcast(fav), top["email"] == fav["user_email"], "left")
    return (out.select("full_name", "practice", "level", "session_count", "total_cost",
                       "avg_cost_per_session", "preferred_model", "email")
               .orderBy(F.desc("session_count"), "email")
               .drop("email"))


def usage_by_location(tables, filters: Filters) -> DataFrame:
    """Q15: distinct prompt sessions per location."""
    up = filtered_fact(tables, "user_prompts", filters)
    return (up.groupBy("location").agg(F.countDistinct("session_id").alias("session_count"))
              .orderBy(F.desc("session_count"), "location"))
