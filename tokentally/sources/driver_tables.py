"""Deterministic mapping from the driver's test tables to the curated model.

The driver ships TPC-H-like tables plus an ``events`` stream, none of which is
telemetry.  These views derive the six curated tables from them with plain
column expressions (no UDFs, no shuffles except the tiny nation/region joins),
so every query's work grows with ``events`` and ``customer``.

employees      customer x nation x region (one employee per customer)
user_prompts   events of type signup        api_requests   purchase
tool_decisions click                         tool_results   view
api_errors     error

``telemetry_lines`` goes the other way: it renders ``events`` as raw
CloudWatch-style JSONL batches (with a few deterministic faults) so that the
ingest path can be tested end to end against SQL computed from ``events``.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentally.sources.export import pack_batches, render_message
from tokentally.sources.schemas import TABLE_SCHEMAS
from tokentally.sources.tables import Tables

# event_type of the driver table -> fact table.
EVENT_TYPE_TABLE = {
    "signup": "user_prompts",
    "purchase": "api_requests",
    "click": "tool_decisions",
    "view": "tool_results",
    "error": "api_errors",
}
# Status codes cycled through by event_id.
STATUS_CODES = ["400", "401", "429", "500", "undefined"]
SESSION_EPOCH = "2024-01-01"   # weekly sessions are counted from this day
BATCH_EVENTS = 7               # events per packed batch (event_id div 7)


def read_driver(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def employees_view(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    # nation (25 rows) and region (5 rows) are fixed-size TPC-H tables: safe to broadcast.
    n = F.broadcast(nation.select("n_nationkey", "n_regionkey"))
    r = F.broadcast(region.select("r_regionkey", "r_name"))
    c = customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return (c.join(n, c.c_nationkey == n.n_nationkey)
             .join(r, F.col("n_regionkey") == r.r_regionkey)
             .select(
                 F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"),
                 F.col("c_name").alias("full_name"),
                 F.col("c_mktsegment").alias("practice"),
                 F.concat(F.lit("L"), (F.lit(1) + F.col("c_custkey") % 10).cast("string")).alias("level"),
                 F.col("r_name").alias("location"),
             ))


def _event_columns(events: DataFrame) -> DataFrame:
    """Common derived columns of every event (weekly sessions per user)."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    week = F.datediff(F.to_date("ts"), F.lit(SESSION_EPOCH).cast("date")).cast("bigint")
    week = F.floor(week / 7).cast("bigint")
    return events.select(
        "event_id", "event_type", "value", "user_id",
        F.col("ts").alias("timestamp"),
        k.alias("k"),
        F.concat(F.col("user_id").cast("string"), F.lit("-w"), week.cast("string")).alias("session_id"),
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("user_email"),
        F.concat(F.lit("term-"), (F.col("user_id") % 4).cast("string")).alias("terminal_type"),
    )


def _status_code() -> Column:
    idx = (F.col("event_id") % len(STATUS_CODES)).cast("int")
    expr = None
    for i, code in enumerate(STATUS_CODES):
        expr = (F.when(idx == i, F.lit(code)) if expr is None else expr.when(idx == i, F.lit(code)))
    return expr


def _decision() -> Column:
    return F.when(F.col("event_id") % 10 == 0, F.lit("reject")).otherwise(F.lit("accept"))


def _source() -> Column:
    return F.when(F.col("event_id") % 10 == 0, F.lit("user_reject")).otherwise(F.lit("config"))


def fact_columns(table: str) -> dict[str, Column]:
    """Typed columns of one fact table, from the derived event columns."""
    k = F.col("k")
    i = lambda c: c.cast("int")
    if table == "user_prompts":
        return {"prompt_length": i(k * 10)}
    if table == "api_requests":
        return {
            "model": F.concat(F.lit("model-"), (F.col("event_id") % 5).cast("string")),
            "input_tokens": i(k * 10),
            "output_tokens": i(F.col("event_id") % 500),
            "cache_read_tokens": i((F.col("event_id") * 37) % 5000),
            "cache_creation_tokens": i((k % 7) * 100),
            "cost_usd": (F.col("value") / 100).cast("double"),
            "duration_ms": i(k * 100),
        }
    if table == "tool_decisions":
        return {
            "tool_name": F.concat(F.lit("tool-"), (F.col("event_id") % 7).cast("string")),
            "decision": _decision(),
            "source": _source(),
        }
    if table == "tool_results":
        return {
            "tool_name": F.concat(F.lit("tool-"), (F.col("event_id") % 7).cast("string")),
            "decision_type": _decision(),
            "decision_source": _source(),
            "success": k % 9 != 0,
            "duration_ms": i(k * 100),
            "result_size_bytes": F.when(F.col("event_id") % 3 == 0, i(k * 64)),
        }
    if table == "api_errors":
        return {
            "model": F.concat(F.lit("model-"), (F.col("event_id") % 5).cast("string")),
            "error": F.concat(F.lit("error-"), _status_code()),
            "status_code": _status_code(),
            "attempt": i(F.lit(1) + F.col("event_id") % 3),
            "duration_ms": i(k * 100),
        }
    raise ValueError(f"Unknown table: {table!r}")


def fact_view(events: DataFrame, table: str) -> DataFrame:
    etype = {v: k for k, v in EVENT_TYPE_TABLE.items()}[table]
    ev = _event_columns(events.where(F.col("event_type") == etype))
    cols = fact_columns(table)
    out = [F.col(c) if c not in cols else cols[c].alias(c)
           for c in TABLE_SCHEMAS[table].fieldNames()]
    return ev.select(*out)


_TABLES: dict[tuple[str, str], Tables] = {}


def driver_tables(spark: SparkSession, root: str, **kw) -> Tables:
    """The six views over one driver data root.

    DataFrames are immutable lazy plans, so the views (and the directory's
    row count used by the broadcast check) are built once per data root and
    Spark application and shared by every query.
    """
    key = (spark.sparkContext.applicationId, root.rstrip("/"))
    if kw or key not in _TABLES:
        events = read_driver(spark, root, "events")
        emp = employees_view(read_driver(spark, root, "customer"), read_driver(spark, root, "nation"),
                             read_driver(spark, root, "region"))
        facts = {t: fact_view(events, t) for t in EVENT_TYPE_TABLE.values()}
        tables = Tables(employees=emp, **facts, **kw)
        tables.employee_rows()
        if kw:
            return tables
        _TABLES[key] = tables
    return _TABLES[key]


# ---------------------------------------------------------------------------------------
# events -> raw telemetry (for the ingest round trip)

# event_type -> event body.
EVENT_BODIES = {
    "signup": "claude_code.user_prompt",
    "purchase": "claude_code.api_request",
    "click": "claude_code.tool_decision",
    "view": "claude_code.tool_result",
    "error": "claude_code.api_error",
}
# Deterministic faults so every reject class occurs (rules on event_id / batch id).
FAULT_BAD_MESSAGE = (83, 5)     # event_id % 83 == 5: text after the message object -> missing_fields
FAULT_UNKNOWN_BODY = (97, 11)   # event_id % 97 == 11: unknown body -> unknown_types
FAULT_DROP_FIELD = (89, 7)      # event_id % 89 == 7: no terminal.type -> missing_fields
FAULT_BAD_INT = (79, 3)         # event_id % 79 == 3, requests: duration_ms '12.5' -> missing_fields
FAULT_BAD_LINE = (61, 3)        # batch % 61 == 3: text after the batch object -> malformed line
UNKNOWN_BODY = "claude_code.unknown_future_event"


def _is(rule: tuple[int, int], col: str = "event_id") -> Column:
    return F.col(col) % rule[0] == rule[1]


def _attributes(table: str) -> Column:
    """All event attributes as strings, like the telemetry exporter sends them."""
    cols = fact_columns(table)
    extra_keys = {"result_size_bytes": "tool_result_size_bytes"}
    pairs = []
    for name in TABLE_SCHEMAS[table].fieldNames():
        if name in ("session_id", "user_email", "timestamp", "terminal_type"):
            continue
        c = cols[name]
        if name == "success":
            c = F.when(c, F.lit("true")).otherwise(F.lit("false"))
        if table == "api_requests" and name == "duration_ms":
            c = F.when(_is(FAULT_BAD_INT), F.lit("12.5")).otherwise(c.cast("string"))
        pairs += [F.lit(extra_keys.get(name, name)), c.cast("string")]
    return F.create_map(*pairs)


def telemetry_events(events: DataFrame) -> DataFrame:
    """One raw telemetry event per driver event: event_id, epoch ms, message JSON."""
    ev = _event_columns(events)
    common = F.create_map(
        F.lit("session.id"), F.col("session_id"),
        F.lit("user.email"), F.col("user_email"),
        F.lit("event.timestamp"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
        F.lit("terminal.type"), F.col("terminal_type"),
        F.lit("event.name"), F.regexp_replace(
            F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in EVENT_BODIES.items()]),
            r"^claude_code\.", ""),
    )
    specific = None
    for etype, table in EVENT_TYPE_TABLE.items():
        cond = F.col("event_type") == etype
        specific = (F.when(cond, _attributes(table)) if specific is None
                    else specific.when(cond, _attributes(table)))
    body = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in EVENT_BODIES.items()])
    # Built in steps so that each map / JSON text is computed once per row.
    step = ev.select(
        "event_id", "timestamp",
        F.map_filter(F.map_concat(common, specific), lambda k, v: v.isNotNull()).alias("attrs"),
        F.when(_is(FAULT_UNKNOWN_BODY), F.lit(UNKNOWN_BODY)).otherwise(body).alias("body"))
    step = step.select(
        "event_id", "timestamp", "body",
        F.when(_is(FAULT_DROP_FIELD), F.map_filter("attrs", lambda k, v: k != "terminal.type"))
         .otherwise(F.col("attrs")).alias("attrs"))
    step = step.select("event_id", "timestamp",
                       render_message(F.col("body"), F.col("attrs")).alias("message"))
    msg = F.when(_is(FAULT_BAD_MESSAGE), F.concat(F.col("message"), F.lit(" trailing"))) \
           .otherwise(F.col("message"))
    return step.select(
        "event_id",
        (F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                          F.col("timestamp"))).alias("epoch_ms"),
        msg.alias("message"),
        F.expr(f"event_id div {BATCH_EVENTS}").alias("batch_id"))


def telemetry_lines(events: DataFrame) -> DataFrame:
    """events -> packed JSONL batch lines (``batch_id``, ``value``), some lines broken."""
    packed = pack_batches(telemetry_events(events), "batch_id", "event_id",
                          id_col="event_id", epoch_ms_col="epoch_ms")
    broken = F.concat(F.col("value"), F.lit(" }"))
    # Range-sorted by batch (= time): each output file then covers a contiguous
    # stretch of time, as exported log files do.
    return packed.select("batch_id", F.when(_is(FAULT_BAD_LINE, "batch_id"), broken)
                         .otherwise(F.col("value")).alias("value")).orderBy("batch_id")


# Messages whose envelope lacks a body or attributes, by event_id % 10.
ENVELOPE_FAULTS = ('{"attributes":{"a":"b"}}', '{"body":"","attributes":{"a":"b"}}', '{"body":"claude_code.api_request"}',
                   '{"body":"claude_code.api_request","attributes":{}}', '{"body":null,"attributes":null}')


def envelope_lines(events: DataFrame) -> DataFrame:
    """events -> packed JSONL batch lines, half of the messages without a whole envelope."""
    message = F.col("message")
    for i, text in enumerate(ENVELOPE_FAULTS):
        message = F.when(F.col("event_id") % 10 == i, F.lit(text)).otherwise(message)
    return pack_batches(telemetry_events(events).withColumn("message", message), "batch_id", "event_id", id_col="event_id", epoch_ms_col="epoch_ms")


def ingest_roundtrip(spark: SparkSession, root: str, persist: bool = False):
    """events -> JSONL batches written under the shared checkpoint folder -> S1 text
    scan -> ingest.  Returns the ``IngestResult`` (tables, rejects, counts)."""
    from tokentally.session import scratch_path
    from tokentally.sources.export import write_lines
    from tokentally.sources.ingest import ingest, read_batch_lines

    path = scratch_path(spark, "telemetry-jsonl")
    write_lines(telemetry_lines(read_driver(spark, root, "events")), path)
    emp = employees_view(read_driver(spark, root, "customer"), read_driver(spark, root, "nation"),
                         read_driver(spark, root, "region"))
    return ingest(read_batch_lines(spark, path), emp, persist=persist)


PART_BATCHES = 1000


def reject_summary_by_part(spark: SparkSession, root: str) -> DataFrame:
    """S15 over input of a known layout: one file per ``PART_BATCHES`` batches, in order,
    so that every location can be told from the event id.  Columns: reason, count,
    locations (text)."""
    from tokentally.session import scratch_path
    from tokentally.sources.ingest import ingest, read_batch_lines, reject_summary

    path = scratch_path(spark, "telemetry-parts")
    lines = telemetry_lines(read_driver(spark, root, "events"))
    (lines.withColumn("part", F.expr(f"batch_id div {PART_BATCHES}"))
          .repartition("part").sortWithinPartitions("part", "batch_id")
          .select("part", "value").write.partitionBy("part").text(path))
    emp = employees_view(read_driver(spark, root, "customer"), read_driver(spark, root, "nation"),
                         read_driver(spark, root, "region"))
    summary = reject_summary(ingest(read_batch_lines(spark, path), emp, stage="table").rejects)
    place = lambda x: F.regexp_replace(x, r"^.*(part=\d+)/\S* (Line \d+(?: \(event index \d+\))?).*$", "$1 $2")
    return summary.select("reason", "count", F.array_join(F.transform("first_locations", place), "; ").alias("locations"))


def employee_number(col: str = "email") -> Column:
    """The customer key in an employee's email."""
    return F.regexp_extract(col, r"(\d+)", 1).cast("bigint")


def without_employees(tables: Tables, rule: tuple[int, int]) -> Tables:
    """The same facts over a directory that lacks the employees matching the rule."""
    emp = tables.employees.where(~(employee_number() % rule[0] == rule[1]))
    return replace(tables, employees=emp, _employee_rows=None)


def employees_csv_roundtrip(spark: SparkSession, root: str, full_name: Column | None = None) -> DataFrame:
    """S21 write then S2 read of the employee directory (with ``full_name`` in place of its own)."""
    from tokentally.session import scratch_path
    from tokentally.sources.export import write_employees_csv
    from tokentally.sources.ingest import read_employees_csv

    emp = employees_view(read_driver(spark, root, "customer"), read_driver(spark, root, "nation"),
                         read_driver(spark, root, "region"))
    if full_name is not None:
        emp = emp.withColumn("full_name", full_name)
    path = scratch_path(spark, "employees-csv")
    write_employees_csv(emp, path)
    return read_employees_csv(spark, path)
