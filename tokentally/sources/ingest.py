"""Raw JSONL batches + employee CSV -> five typed facts, one dimension, rejects.

Parsing, classification and the five projections are narrow (per line, per
event) -- no shuffle; only the small per-split line-number table and the
reject summary aggregate.  Bad records never fail the load; they land in
``rejects`` with a reason and a location ("Line n (event index i): ..."):

malformed       the line is not exactly one JSON object
missing_fields  message not JSON / no body or attributes / a required field
                absent, null or unparsable (also the reference's crashes, K13/K14)
unknown_types   body is not one of the five event types
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tokentally.functions.columns import parse_utc_timestamp
from tokentally.session import compilable
from tokentally.sources.schemas import BATCH, EMPLOYEES, FACT_SCHEMAS, MESSAGE
from tokentally.sources.tables import Tables, run_all

# Event bodies and the table each one feeds.
EVENT_TABLES = {
    "claude_code.user_prompt": "user_prompts",
    "claude_code.api_request": "api_requests",
    "claude_code.tool_decision": "tool_decisions",
    "claude_code.tool_result": "tool_results",
    "claude_code.api_error": "api_errors",
}

# Reject message texts (the location "Line n (event index i): " is prefixed).
MSG_MALFORMED_LINE = "malformed JSON line"
MSG_BAD_MESSAGE = "failed to parse message JSON"
MSG_NO_ENVELOPE = "missing 'body' or 'attributes'"
MSG_UNKNOWN_TYPE = "unknown type '{body}'"
MSG_BAD_FIELD = "missing or invalid field in '{body}': '{field}'"

# Fixed values: (column, attribute key, parse kind) per event body.
# Kinds: str = required text; int / float / ts = required and must parse;
# true = required, value == "true"; opt_int = may be absent, must parse if present.
COMMON_FIELDS = [
    ("session_id", "session.id", "str"),
    ("user_email", "user.email", "str"),
    ("timestamp", "event.timestamp", "ts"),
    ("terminal_type", "terminal.type", "str"),
]
EVENT_FIELDS = {
    "claude_code.user_prompt": [("prompt_length", "prompt_length", "int")],
    "claude_code.api_request": [
        ("model", "model", "str"),
        ("input_tokens", "input_tokens", "int"),
        ("output_tokens", "output_tokens", "int"),
        ("cache_read_tokens", "cache_read_tokens", "int"),
        ("cache_creation_tokens", "cache_creation_tokens", "int"),
        ("cost_usd", "cost_usd", "float"),
        ("duration_ms", "duration_ms", "int"),
    ],
    "claude_code.tool_decision": [
        ("tool_name", "tool_name", "str"),
        ("decision", "decision", "str"),
        ("source", "source", "str"),
    ],
    "claude_code.tool_result": [
        ("tool_name", "tool_name", "str"),
        ("decision_type", "decision_type", "str"),
        ("decision_source", "decision_source", "str"),
        ("success", "success", "true"),
        ("duration_ms", "duration_ms", "int"),
        ("result_size_bytes", "tool_result_size_bytes", "opt_int"),
    ],
    "claude_code.api_error": [
        ("model", "model", "str"),
        ("error", "error", "str"),
        ("status_code", "status_code", "str"),
        ("attempt", "attempt", "int"),
        ("duration_ms", "duration_ms", "int"),
    ],
}


def _attr(key: str) -> Column:
    return F.try_element_at(F.col("attributes"), F.lit(key))


def _has(key: str) -> Column:
    return F.map_contains_key(F.col("attributes"), F.lit(key))


def parsed_value(kind: str, key: str) -> Column:
    v = _attr(key)
    if kind == "str":
        return v
    if kind in ("int", "opt_int"):
        return v.try_cast("int")
    if kind == "float":
        return v.try_cast("double")
    if kind == "ts":
        return parse_utc_timestamp(v)
    if kind == "true":
        return F.coalesce(v == F.lit("true"), F.lit(False))
    raise ValueError(kind)


def _all_fields() -> dict[str, tuple[str, str]]:
    """Every output column once: column -> (attribute key, parse kind)."""
    out: dict[str, tuple[str, str]] = {}
    for specs in [COMMON_FIELDS] + list(EVENT_FIELDS.values()):
        for col, key, kind in specs:
            prev = out.setdefault(col, (key, kind))
            if prev != (key, kind):
                raise ValueError(f"column {col!r} parsed two ways")
    return out


def _presence_col(key: str) -> str:
    return "has_" + key.replace(".", "_")


def _typed_ok(col: str, key: str, kind: str) -> Column:
    """Field check on the already typed column."""
    if kind == "true":
        return F.col(_presence_col(key))
    if kind == "opt_int":
        return ~F.col(_presence_col(key)) | F.col(col).isNotNull()
    return F.col(col).isNotNull()


def _first_bad_field(body: str) -> Column:
    """Name of the first failing field of one event body (NULL when all are fine)."""
    expr = None
    for col, key, kind in COMMON_FIELDS + EVENT_FIELDS[body]:
        bad = ~_typed_ok(col, key, kind)
        expr = F.when(bad, F.lit(key)) if expr is None else expr.when(bad, F.lit(key))
    return expr


# ---------------------------------------------------------------------------------------
# S1/S2 scans


def read_batch_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """S1 scan: one row per line with its file, the start of its split and a row id
    that increases through each split (text scans split large files)."""
    return with_positions(spark.read.text(paths))


def with_positions(text: DataFrame) -> DataFrame:
    """Add source_file, block_start and row_id to a batch text scan."""
    return file_columns(text).withColumn("row_id", F.monotonically_increasing_id())


def file_columns(text: DataFrame) -> DataFrame:
    """value, source_file, block_start of a text scan (batch or streaming)."""
    return text.select("value", F.col("_metadata.file_path").alias("source_file"),
                       F.col("_metadata.file_block_start").alias("block_start"))


def line_offsets(classified: DataFrame) -> DataFrame:
    """Exact 1-based line numbers without a pass through one task or the driver.

    Works on the classified frame (every line leaves at least one row there), so
    the raw text is not read again.  Per (file, split): first and last row id --
    one small row per split; ``row_id`` increases by one per line through a
    split, so the split holds last - first + 1 lines.  Lines before a split =
    running sum over the file's earlier splits.  A line's number is then
    lines_before + (row_id - first_row_id) + 1.
    """
    blocks = classified.where(F.col("row_id").isNotNull()).groupBy("source_file", "block_start").agg(
        F.min("row_id").alias("first_id"), F.max("row_id").alias("last_id"))
    w = Window.partitionBy("source_file").orderBy("block_start") \
              .rowsBetween(Window.unboundedPreceding, -1)
    n = F.col("last_id") - F.col("first_id") + 1
    return blocks.select("source_file", "block_start", "first_id",
                         F.coalesce(F.sum(n).over(w), F.lit(0)).alias("before"))


def read_employees_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV, columns chosen by name (all text; no positional schema)."""
    # Standard quoting: a doubled quote inside quotes, line breaks inside fields.
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    return raw.select(*EMPLOYEES.fieldNames())


def split_employees(employees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S18 NOT NULL: rows with a missing or empty field go to rejects (reason
    ``constraint``) instead of aborting the load.  Returns (valid, rejects)."""
    cols = EMPLOYEES.fieldNames()
    ok = None
    for c in cols:
        cond = F.col(c).isNotNull() & (F.trim(F.col(c)) != "")
        ok = cond if ok is None else ok & cond
    valid = employees.where(ok)
    bad = employees.where(~ok).select(
        F.lit("constraint").alias("reason"),
        F.lit("employee row with a missing field").alias("detail"),
        F.lit(None).cast("string").alias("source_file"), F.lit(None).cast("long").alias("line"),
        F.lit(None).cast("long").alias("line_hash"),
        F.lit(None).cast("int").alias("event_idx"), F.to_json(F.struct(*cols)).alias("raw"))
    return valid, bad


def check_employee_keys(employees: DataFrame) -> None:
    """The directory must have a unique, non-null email (raises otherwise)."""
    dup = employees.groupBy("email").count().where((F.col("count") > 1) | F.col("email").isNull())
    first = dup.limit(1).collect()
    if first:
        raise ValueError(f"Duplicate or missing employee email: {first[0]['email']!r}")


# ---------------------------------------------------------------------------------------
# S1-S13 classification


def classify_lines(lines: DataFrame) -> DataFrame:
    """One row per malformed line or per event, with ``status`` and its ``detail``.

    Strict JSON: each line is wrapped as ``[line]`` and parsed as an array of
    batches; it is valid iff exactly one non-null object came out (garbage,
    trailing text, blank lines, top-level arrays and ``{},{}`` all fail).
    """
    lines = compilable(lines)
    for c, t in (("source_file", "string"), ("block_start", "long"), ("row_id", "long")):
        if c not in lines.columns:
            lines = lines.withColumn(c, F.lit(None).cast(t))
    arr = F.from_json(F.concat(F.lit("["), F.col("value"), F.lit("]")), T.ArrayType(BATCH))
    pos = ["source_file", "block_start", "row_id"]
    parsed = lines.select(*pos, F.xxhash64("value").alias("line_hash"), "value", arr.alias("arr"))
    parsed = parsed.select(*pos, "line_hash", "value",
                           F.when(F.size("arr") == 1, F.get(F.col("arr"), 0)).alias("batch"))
    # Each event's message is parsed inside the array, before the explode: filters
    # on the classification (e.g. one table's rows) cannot be pushed below the
    # explode, so the JSON is parsed once per event whatever the consumer.
    msg_type = T.ArrayType(MESSAGE)
    item_type = T.StructType([T.StructField("message", T.StringType()),
                              T.StructField("marr", msg_type)])
    # A line without events (empty or missing logEvents) keeps one placeholder row
    # (status "empty") so that every line is present for line numbering.
    no_events = F.coalesce(F.size("batch.logEvents"), F.lit(0)) <= 0
    items = F.when(F.col("batch").isNull() | no_events, F.array(F.lit(None).cast(item_type))).otherwise(
        F.transform("batch.logEvents", lambda e: F.struct(
            e["message"].alias("message"),
            F.from_json(F.concat(F.lit("["), e["message"], F.lit("]")), msg_type).alias("marr"))))
    exploded = parsed.select(
        *pos, "line_hash", F.col("batch").isNull().alias("malformed"),
        (F.col("batch").isNotNull() & no_events).alias("empty"),
        F.when(F.col("batch").isNull(), F.col("value")).alias("line"),
        F.posexplode(items).alias("event_idx", "item"))
    marr = F.col("item.marr")
    events = exploded.select(
        *pos, "line_hash", "malformed", "empty",
        F.when(~F.col("malformed"), F.col("event_idx").cast("int")).alias("event_idx"),
        F.coalesce(F.col("line"), F.col("item.message")).alias("raw"),
        F.when(~F.col("malformed") & (F.size(marr) == 1), F.get(marr, 0)).alias("msg"))
    events = events.select(*pos, "line_hash", "event_idx", "raw", "malformed", "empty",
                           F.col("msg.body").alias("body"), F.col("msg.attributes").alias("attributes"),
                           F.col("msg").isNull().alias("bad_message"))
    # Each attribute is looked up and typed once; checks and projections reuse it.
    fields = _all_fields()
    presence = sorted({key for key, kind in fields.values() if kind in ("true", "opt_int")})
    events = events.select(
        "*", *[parsed_value(kind, key).alias(col) for col, (key, kind) in fields.items()],
        *[_has(key).alias(_presence_col(key)) for key in presence])

    known = F.col("body").isin(list(EVENT_TABLES))
    bad_field = None
    for body in EVENT_TABLES:
        cond = F.col("body") == F.lit(body)
        bad_field = (F.when(cond, _first_bad_field(body)) if bad_field is None
                     else bad_field.when(cond, _first_bad_field(body)))
    no_envelope = (F.col("body").isNull() | (F.col("body") == "")
                   | F.col("attributes").isNull() | (F.size("attributes") == 0))
    events = events.withColumn("bad_field", F.when(~F.col("malformed") & known & ~F.col("bad_message")
                                                   & ~no_envelope, bad_field))
    status = (F.when(F.col("malformed"), F.lit("malformed"))
               .when(F.col("empty"), F.lit("empty"))
               .when(F.col("bad_message"), F.lit("missing_fields"))
               .when(no_envelope, F.lit("missing_fields"))
               .when(~known, F.lit("unknown_types"))
               .when(F.col("bad_field").isNotNull(), F.lit("missing_fields"))
               .otherwise(F.lit("ingested")))
    def fmt(template: str, **cols) -> Column:
        """Fill a fixed message template with columns (the text around them stays literal)."""
        parts, rest = [], template
        while "{" in rest:
            head, tail = rest.split("{", 1)
            name, rest = tail.split("}", 1)
            parts += [F.lit(head), cols[name]]
        return F.concat(*parts, F.lit(rest))

    detail = (F.when(F.col("malformed"), F.lit(MSG_MALFORMED_LINE))
               .when(F.col("bad_message"), F.lit(MSG_BAD_MESSAGE))
               .when(no_envelope, F.lit(MSG_NO_ENVELOPE))
               .when(~known, fmt(MSG_UNKNOWN_TYPE, body=F.col("body")))
               .when(F.col("bad_field").isNotNull(),
                     fmt(MSG_BAD_FIELD, body=F.col("body"), field=F.col("bad_field"))))
    table = None
    for body, tname in EVENT_TABLES.items():
        cond = F.col("body") == F.lit(body)
        table = F.when(cond, F.lit(tname)) if table is None else table.when(cond, F.lit(tname))
    out = events.select(status.alias("status"), F.when(~F.col("malformed"), table).alias("table"),
                        detail.alias("detail"), *pos, "line_hash", "event_idx", "raw",
                        *fields)
    # Raw text is kept for rejects only; typed values for ingested events only.
    ok = F.col("status") == "ingested"
    return out.select("status", "table", "detail", *pos, "line_hash", "event_idx",
                      F.when(~ok, F.col("raw")).alias("raw"),
                      *[F.when(ok, F.col(c)).alias(c) for c in fields])


def project_table(classified: DataFrame, table: str) -> DataFrame:
    """Typed columns of one fact, in DDL order, from its ingested events."""
    schema = FACT_SCHEMAS[table]
    rows = classified.where((F.col("table") == table) & (F.col("status") == "ingested"))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def rejects_of(classified: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """The reject table (reason, detail with location, file, line, raw text).

    With ``offsets`` (from ``line_offsets`` of the same scan) each reject gets its
    1-based line number and the detail reads "Line n (event index i): ...".
    """
    bad = classified.where(~F.col("status").isin("ingested", "empty"))
    if offsets is not None:
        bad = bad.join(offsets, ["source_file", "block_start"], "left")
        line = F.col("before") + F.col("row_id") - F.col("first_id") + F.lit(1)
    else:
        line = F.lit(None).cast("long")
    bad = bad.withColumn("line", line)
    idx = F.concat(F.lit("event index "), F.col("event_idx").cast("string"))
    loc = F.when(F.col("line").isNotNull(), F.concat(
        F.lit("Line "), F.col("line").cast("string"),
        F.when(F.col("event_idx").isNotNull(), F.concat(F.lit(" ("), idx, F.lit(")"))).otherwise(F.lit(""))
    )).otherwise(F.coalesce(idx, F.lit("line")))
    return bad.select(F.col("status").alias("reason"), F.concat(loc, F.lit(": "), F.col("detail")).alias("detail"),
                      "source_file", "line", "line_hash", "event_idx", "raw")


def ingest_counts(classified: DataFrame) -> DataFrame:
    """One row {ingested, malformed, missing_fields, unknown_types}; zeros kept."""
    return classified.agg(*[
        F.count_if(F.col("status") == s).alias(s)
        for s in ("ingested", "malformed", "missing_fields", "unknown_types")
    ])


def reject_summary(rejects: DataFrame, first_n: int = 10) -> DataFrame:
    """For each of the three reasons its count and first ``first_n`` locations
    (zero and none where nothing was rejected), then ``total_skipped``, their sum.

    Each reason's first locations come from a distributed top-n
    (``orderBy().limit()``), so no reason's rejects are gathered in one task.
    """
    reasons = ("malformed", "missing_fields", "unknown_types")
    order = ["source_file", "line", "line_hash", "event_idx"]
    firsts = None
    for r in reasons:
        top = (rejects.where(F.col("reason") == r).orderBy(*order).limit(first_n)
               .select("reason", F.struct(*order, "detail").alias("loc")))
        firsts = top if firsts is None else firsts.unionByName(top)
    locs = firsts.groupBy("reason").agg(F.sort_array(F.collect_list("loc")).alias("first_locations"))
    counts = rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("count"))
    where = lambda x: F.concat_ws(" ", F.coalesce(x["source_file"], F.lit("")), x["detail"])
    listed = rejects.sparkSession.createDataFrame([(r,) for r in reasons], "reason string")
    per_reason = listed.join(counts, "reason", "left").join(locs, "reason", "left").select(
        "reason", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
        F.coalesce(F.transform("first_locations", where), F.array().cast("array<string>")).alias("first_locations"))
    total = counts.where(F.col("reason").isin(*reasons)).agg(
        F.lit("total_skipped").alias("reason"), F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("count"),
        F.array().cast("array<string>").alias("first_locations"))
    return per_reason.unionByName(total)


# ---------------------------------------------------------------------------------------
# S16/S17 result


@dataclass
class IngestResult:
    tables: Tables
    classified: DataFrame
    rejects: DataFrame
    counts: DataFrame

    def write(self, root: str, concurrent: int = 4) -> dict:
        """Overwrite all tables + rejects; return the counts as a dict.

        The counts run first (that fills the cache of classified events); the
        seven independent writes then run as concurrent Spark jobs.
        """
        check_employee_keys(self.tables.employees)
        row = self.counts.first()
        jobs = self.tables.writers(root) + [
            lambda: self.rejects.write.mode("overwrite").parquet(f"{root.rstrip('/')}/rejects")]
        run_all(jobs, concurrent)
        return row.asDict()

    def publish(self, root: str, concurrent: int = 4) -> dict:
        """As ``write``, but as a new generation that readers see whole or not at all; counts and ``version``."""
        from tokentally.sources.generations import publish
        check_employee_keys(self.tables.employees)
        row = self.counts.first()
        return row.asDict() | {"version": publish(self.tables, root, self.rejects, concurrent)}

    def unpersist(self) -> None:
        self.classified.unpersist()


def ingest(lines: DataFrame, employees: DataFrame, persist: bool = True,
           stage: str | None = None) -> IngestResult:
    """Classify every line/event once; the five facts, rejects and counts read it.

    How the classified events are kept for their six readers:

    * ``persist=True`` (default): cached in memory, spilling to disk; lost blocks
      are recomputed from the source files, so a lost executor costs time, not
      results.  Best when the data fits the cluster comfortably.
    * ``stage="table"``: written once as Parquet under the shared checkpoint
      folder, partitioned by target table.  Each fact then reads only its own
      partition and columns, and nothing depends on executors staying alive --
      the choice for very large loads.
    * neither: every reader re-parses the input.
    """
    classified = classify_lines(lines)
    if stage == "table":
        from tokentally.session import scratch_path
        path = scratch_path(lines.sparkSession, "ingest-classified")
        classified.withColumn("part", F.coalesce(F.col("table"), F.col("status"))) \
                  .write.mode("overwrite").partitionBy("part").parquet(path)
        classified = lines.sparkSession.read.parquet(path).drop("part")
        persist = False
    elif stage is not None:
        raise ValueError(f"Unknown stage: {stage!r}")
    if persist:
        classified = classified.persist(StorageLevel.MEMORY_AND_DISK)
    facts = {t: project_table(classified, t) for t in FACT_SCHEMAS}
    valid_emp, bad_emp = split_employees(employees)
    tables = Tables(employees=valid_emp, **facts)
    offsets = line_offsets(classified) if "row_id" in lines.columns else None
    rejects = rejects_of(classified, offsets).unionByName(bad_emp)
    return IngestResult(tables, classified, rejects, ingest_counts(classified))


def run_ingest(spark: SparkSession, telemetry_path: str, employees_path: str,
               output_root: str | None = None, stage: str | None = None) -> IngestResult | dict:
    """End to end: read both inputs, classify, and (with ``output_root``) write.
    ``stage="table"`` for very large loads, see ``ingest``."""
    res = ingest(read_batch_lines(spark, telemetry_path), read_employees_csv(spark, employees_path), stage=stage)
    if output_root is None:
        return res
    try:
        return res.write(output_root)
    finally:
        res.unpersist()
