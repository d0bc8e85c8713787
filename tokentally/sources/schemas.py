"""Typed schemas of the curated tables (one dimension, five facts) and of the raw batches."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _D, _B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_TS = T.TimestampNTZType()


def _common() -> list[T.StructField]:
    return [
        T.StructField("session_id", _S, False),
        T.StructField("user_email", _S, False),
        T.StructField("timestamp", _TS, False),
    ]


_TERMINAL = T.StructField("terminal_type", _S, False)

EMPLOYEES = T.StructType([
    T.StructField("email", _S, False),
    T.StructField("full_name", _S, False),
    T.StructField("practice", _S, False),
    T.StructField("level", _S, False),
    T.StructField("location", _S, False),
])

USER_PROMPTS = T.StructType(_common() + [
    T.StructField("prompt_length", _I, False),
    _TERMINAL,
])

API_REQUESTS = T.StructType(_common() + [
    T.StructField("model", _S, False),
    T.StructField("input_tokens", _I, False),
    T.StructField("output_tokens", _I, False),
    T.StructField("cache_read_tokens", _I, False),
    T.StructField("cache_creation_tokens", _I, False),
    T.StructField("cost_usd", _D, False),
    T.StructField("duration_ms", _I, False),
    _TERMINAL,
])

TOOL_DECISIONS = T.StructType(_common() + [
    T.StructField("tool_name", _S, False),
    T.StructField("decision", _S, False),
    T.StructField("source", _S, False),
    _TERMINAL,
])

TOOL_RESULTS = T.StructType(_common() + [
    T.StructField("tool_name", _S, False),
    T.StructField("decision_type", _S, False),
    T.StructField("decision_source", _S, False),
    T.StructField("success", _B, False),
    T.StructField("duration_ms", _I, False),
    T.StructField("result_size_bytes", _I, True),
    _TERMINAL,
])

API_ERRORS = T.StructType(_common() + [
    T.StructField("model", _S, False),
    T.StructField("error", _S, False),
    T.StructField("status_code", _S, False),
    T.StructField("attempt", _I, False),
    T.StructField("duration_ms", _I, False),
    _TERMINAL,
])

FACT_SCHEMAS: dict[str, T.StructType] = {
    "user_prompts": USER_PROMPTS,
    "api_requests": API_REQUESTS,
    "tool_decisions": TOOL_DECISIONS,
    "tool_results": TOOL_RESULTS,
    "api_errors": API_ERRORS,
}

TABLE_SCHEMAS: dict[str, T.StructType] = {"employees": EMPLOYEES, **FACT_SCHEMAS}

# Raw CloudWatch-style batch: one JSON object per line.
LOG_EVENT = T.StructType([
    T.StructField("id", _S),
    T.StructField("timestamp", T.LongType()),
    T.StructField("message", _S),
])
BATCH = T.StructType([T.StructField("logEvents", T.ArrayType(LOG_EVENT))])

# The decoded ``message`` of one event.  scope/resource are not used.
MESSAGE = T.StructType([
    T.StructField("body", _S),
    T.StructField("attributes", T.MapType(_S, _S)),
])
