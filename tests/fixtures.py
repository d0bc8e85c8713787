"""In-memory curated tables: the reference's query fixture plus extra rows."""

from __future__ import annotations

import datetime as dt

from tokentally.sources.schemas import TABLE_SCHEMAS
from tokentally.sources.tables import Tables

T = dt.datetime.fromisoformat

EMPLOYEES = [
    ("alice@example.com", "Alice Smith", "Backend Engineering", "L5", "Germany"),
    ("bob@example.com", "Bob Jones", "Frontend Engineering", "L3", "Poland"),
]
API_REQUESTS = [
    ("s1", "alice@example.com", T("2025-12-10 10:00:00"), "claude-sonnet-4-6", 100, 200, 500, 0, 0.01, 9000, "vscode"),
    ("s1", "alice@example.com", T("2025-12-10 10:05:00"), "claude-haiku-4-5-20251001", 50, 100, 0, 0, 0.001, 2000, "vscode"),
    ("s2", "bob@example.com", T("2025-12-11 20:00:00"), "claude-opus-4-6", 0, 300, 1000, 0, 0.05, 15000, "iterm"),
]
USER_PROMPTS = [
    ("s1", "alice@example.com", T("2025-12-10 10:00:00"), 300, "vscode"),
    ("s2", "bob@example.com", T("2025-12-11 20:00:00"), 500, "iterm"),
]
TOOL_DECISIONS = [
    ("s1", "alice@example.com", T("2025-12-10 10:01:00"), "Read", "accept", "config", "vscode"),
    ("s1", "alice@example.com", T("2025-12-10 10:02:00"), "Edit", "reject", "user_reject", "vscode"),
    ("s2", "bob@example.com", T("2025-12-11 20:01:00"), "Read", "accept", "config", "iterm"),
]
TOOL_RESULTS = [
    ("s1", "alice@example.com", T("2025-12-10 10:01:01"), "Read", "accept", "config", True, 61, 2048, "vscode"),
    ("s2", "bob@example.com", T("2025-12-11 20:01:01"), "Read", "accept", "config", True, 120, None, "iterm"),
]
API_ERRORS = [
    ("s2", "bob@example.com", T("2025-12-11 20:00:30"), "claude-opus-4-6", "Token expired", "401", 1, 500, "iterm"),
]
FILTER = dict(date_start="2025-12-01", date_end="2026-02-28")


def make_tables(spark, employees=None, api_requests=None, user_prompts=None, tool_decisions=None,
                tool_results=None, api_errors=None) -> Tables:
    rows = dict(employees=EMPLOYEES if employees is None else employees,
                api_requests=API_REQUESTS if api_requests is None else api_requests,
                user_prompts=USER_PROMPTS if user_prompts is None else user_prompts,
                tool_decisions=TOOL_DECISIONS if tool_decisions is None else tool_decisions,
                tool_results=TOOL_RESULTS if tool_results is None else tool_results,
                api_errors=API_ERRORS if api_errors is None else api_errors)
    return Tables(**{k: spark.createDataFrame(v, TABLE_SCHEMAS[k]) for k, v in rows.items()})
