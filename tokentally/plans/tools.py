"""Q19-Q22: tool behaviour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.operators.filters import Filters, filtered_fact


def tool_frequency(tables, filters: Filters) -> DataFrame:
    """Q19: decisions per tool."""
    td = filtered_fact(tables, "tool_decisions", filters)
    return (td.groupBy("tool_name").agg(F.count(F.lit(1)).alias("call_count"))
              .orderBy(F.desc("call_count"), "tool_name"))


def tool_accept_reject(tables, filters: Filters) -> DataFrame:
    """Q20: accept and reject counts per tool, by their sum descending."""
    td = filtered_fact(tables, "tool_decisions", filters)
    return (td.groupBy("tool_name")
              .agg(F.count_if(F.col("decision") == "accept").alias("accept_count"),
                   F.count_if(F.col("decision") == "reject").alias("reject_count"))
              .orderBy(F.desc(F.col("accept_count") + F.col("reject_count")), "tool_name"))


def tool_success_rate(tables, filters: Filters) -> DataFrame:
    """Q21: share of successful results per tool, lowest first."""
    tr = filtered_fact(tables, "tool_results", filters)
    return (tr.groupBy("tool_name").agg(F.avg(F.col("success").cast("int")).alias("success_rate"))
              .orderBy("success_rate", "tool_name"))


def tool_execution_time(tables, filters: Filters) -> DataFrame:
    """Q22: mean result duration per tool, slowest first."""
    tr = filtered_fact(tables, "tool_results", filters)
    return (tr.groupBy("tool_name").agg(F.avg("duration_ms").alias("avg_duration_ms"))
              .orderBy(F.desc("avg_duration_ms"), "tool_name"))
