"""Stable IDs of the 27 analytics queries (used as registry keys)."""

from __future__ import annotations

from tokentally.plans import activity, costs, overview, sessions, team, tools

QUERIES = {
    "q1_kpi_metrics": overview.kpi_metrics,
    "q2_daily_sessions": overview.daily_sessions,
    "q3_session_kpis": overview.session_kpis,
    "q4_cache_savings": overview.cache_savings,
    "q5_cost_by_practice_over_time": costs.cost_by_practice_over_time,
    "q6_cost_by_level_over_time": costs.cost_by_level_over_time,
    "q7_token_breakdown": costs.token_breakdown,
    "q8_avg_cost_per_session_over_time": costs.avg_cost_per_session_over_time,
    "q9_daily_cost_totals": costs.daily_cost_totals,
    "q10_model_distribution": costs.model_distribution,
    "q11_cache_hit_rate": costs.cache_hit_rate,
    "q12_usage_by_practice": team.usage_by_practice,
    "q13_usage_by_level": team.usage_by_level,
    "q14_top_engineers": team.top_engineers,
    "q15_usage_by_location": team.usage_by_location,
    "q16_hourly_heatmap": activity.hourly_heatmap,
    "q17_day_of_week_counts": activity.day_of_week_counts,
    "q18_business_hours_split": activity.business_hours_split,
    "q19_tool_frequency": tools.tool_frequency,
    "q20_tool_accept_reject": tools.tool_accept_reject,
    "q21_tool_success_rate": tools.tool_success_rate,
    "q22_tool_execution_time": tools.tool_execution_time,
    "q23_session_duration_hist": sessions.session_duration_hist,
    "q24_session_cost_by_practice": sessions.session_cost_by_practice,
    "q25_api_latency_by_model": sessions.api_latency_by_model,
    "q26_error_breakdown": sessions.error_breakdown,
    "q27_level_cost_correlation": sessions.level_cost_correlation,
}


def run(query_id: str, tables, filters, domains=None):
    """Run one query.  ``filters`` is a ``Filters`` or a dict with date_start,
    date_end and optional practices / levels / locations, validated against ``domains``
    (default: the reference's lists)."""
    from tokentally.operators.filters import Filters
    if isinstance(filters, dict):
        filters = Filters.from_dict(filters, domains)
    if query_id not in QUERIES:
        raise ValueError(f"Unknown query: {query_id!r}")
    return QUERIES[query_id](tables, filters)
