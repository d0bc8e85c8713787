"""Q23-Q27: session intelligence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.functions.columns import level_rank, minutes_between
from tokentally.operators.filters import Filters, filtered_fact
from tokentally.operators.rollups import prompts_with_session_cost, weighted_cost_sum


def session_duration_hist(tables, filters: Filters) -> DataFrame:
    """Q23: raw per-session span in minutes (first to last request in range)."""
    ar = filtered_fact(tables, "api_requests", filters)
    return (ar.groupBy("session_id")
              .agg(minutes_between(F.min("timestamp"), F.max("timestamp")).alias("duration_mins")))


PIECE_ROWS = 10_000


def session_cost_by_practice(tables, filters: Filters, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Q24: one row per prompt (not per session, K2) with its session's lifetime cost.

    Prompts are counted per (session, practice) before the join, as in J2, and the
    counts are turned back into rows after it.  A session with very many prompts is
    cut into pieces of ``PIECE_ROWS`` rows that are spread over the tasks first, so
    a hot session is neither shuffled row by row nor written by one task.
    """
    up = filtered_fact(tables, "user_prompts", filters).select("session_id", "practice")
    per_session = prompts_with_session_cost(up, tables.session_cost(), ["practice"])
    pieces = per_session.select(
        "session_id", "practice", F.coalesce("session_cost", F.lit(0.0)).alias("total_cost"), "n_prompts",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_prompts") - 1, F.lit(piece_rows).cast("bigint"))).alias("first"))
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.least(F.col("n_prompts") - F.col("first"), F.lit(piece_rows)).cast("int")
    return (pieces.repartition(tasks)
                  .select("session_id", "practice", "total_cost", F.explode(F.array_repeat(F.lit(0), size)).alias("row"))
                  .drop("row"))


def api_latency_by_model(tables, filters: Filters) -> DataFrame:
    """Q25: mean request duration per model, slowest first."""
    ar = filtered_fact(tables, "api_requests", filters)
    return (ar.groupBy("model").agg(F.avg("duration_ms").alias("avg_duration_ms"))
              .orderBy(F.desc("avg_duration_ms"), "model"))


def error_breakdown(tables, filters: Filters) -> DataFrame:
    """Q26: errors per status code, 'undefined' shown as 'Unknown'."""
    ae = filtered_fact(tables, "api_errors", filters)
    code = F.when(F.col("status_code") == "undefined", F.lit("Unknown")).otherwise(F.col("status_code"))
    return (ae.groupBy(code.alias("status_code")).agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.desc("count"), "status_code"))


def level_cost_correlation(tables, filters: Filters) -> DataFrame:
    """Q27: prompt-weighted session cost / distinct sessions per level (an average, K1)."""
    up = filtered_fact(tables, "user_prompts", filters).select("session_id", "level")
    j = prompts_with_session_cost(up, tables.session_cost(), ["level"])
    return (j.groupBy("level")
              .agg((F.coalesce(weighted_cost_sum(), F.lit(0.0)) / F.count(F.lit(1)))
                   .alias("avg_cost_per_session"))
              .orderBy(level_rank("level"), "level"))
