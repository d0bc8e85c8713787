"""Raw JSONL ingest, reject classes, packing and CSV sinks."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tokentally.sources import export as X
from tokentally.sources import ingest as I

BASE = {"session.id": "sess-1", "user.email": "alice@example.com", "terminal.type": "vscode"}
SPECIFIC = {
    "claude_code.user_prompt": {"prompt_length": "420"},
    "claude_code.api_request": {"model": "claude-sonnet-4-6", "input_tokens": "100", "output_tokens": "200",
                                "cache_read_tokens": "0", "cache_creation_tokens": "0",
                                "cost_usd": "0.005", "duration_ms": "9078"},
    "claude_code.tool_decision": {"tool_name": "Edit", "decision": "reject", "source": "user_reject"},
    "claude_code.tool_result": {"tool_name": "Read", "decision_type": "accept", "decision_source": "config",
                                "success": "true", "duration_ms": "61", "tool_result_size_bytes": "2048"},
    "claude_code.api_error": {"model": "claude-opus-4-6", "error": "Token expired", "status_code": "401",
                              "attempt": "1", "duration_ms": "500"},
}


def event(body, second=0, drop=(), **override):
    attrs = {**BASE, "event.timestamp": f"2025-12-10T10:00:{second:02d}.000Z",
             "event.name": body.split(".")[-1], **SPECIFIC.get(body, {}), **override}
    for k in drop:
        attrs.pop(k)
    return {"id": str(second), "timestamp": 1765360800000 + second * 1000,
            "message": json.dumps({"body": body, "attributes": attrs})}


def batch(*events):
    return json.dumps({"messageType": "DATA_MESSAGE", "logEvents": list(events)})


def write(lines):
    d = tempfile.mkdtemp(prefix="tt-jsonl-")
    with open(os.path.join(d, "telemetry.jsonl"), "w") as f:
        f.write("\n".join(lines) + "\n")
    return d


def employees_csv(rows=(("alice@example.com", "Alice Smith", "Backend Engineering", "L5", "Germany"),
                        ("bob@example.com", "Bob Jones", "Frontend Engineering", "L3", "Poland"))):
    d = tempfile.mkdtemp(prefix="tt-csv-")
    with open(os.path.join(d, "employees.csv"), "w") as f:
        f.write("email,full_name,practice,level,location\n")
        f.writelines(",".join(r) + "\n" for r in rows)
    return d


def ingest_lines(spark, lines):
    return I.ingest(I.read_batch_lines(spark, write(lines)), I.read_employees_csv(spark, employees_csv()),
                    persist=False)


def counts(res):
    return res.counts.first().asDict()


SAMPLE = [batch(*[event(b, i) for i, b in enumerate(list(SPECIFIC)[:3])]),
          batch(*[event(b, 10 + i) for i, b in enumerate(list(SPECIFIC)[3:])])]


def test_sample_file_fills_each_table_once(spark):
    res = ingest_lines(spark, SAMPLE)
    assert counts(res) == {"ingested": 5, "malformed": 0, "missing_fields": 0, "unknown_types": 0}
    for t in ("user_prompts", "api_requests", "tool_decisions", "tool_results", "api_errors"):
        assert res.tables.fact(t).count() == 1, t
    r = res.tables.api_requests.first()
    assert r["cost_usd"] == 0.005 and r["input_tokens"] == 100
    assert str(r["timestamp"]) == "2025-12-10 10:00:01"
    assert res.tables.employees.count() == 2


def test_malformed_line(spark):
    assert counts(ingest_lines(spark, ["this is not json"]))["malformed"] == 1


@pytest.mark.parametrize("line", ["", "   ", '{"logEvents": []} trailing', "[1]", "null", "{},{}", "12"])
def test_more_malformed_lines(spark, line):
    c = counts(ingest_lines(spark, [line, SAMPLE[0]]))
    assert c["malformed"] == 1 and c["ingested"] == 3


def test_unknown_type(spark):
    c = counts(ingest_lines(spark, [batch(event("claude_code.unknown_future_event"))]))
    assert c == {"ingested": 0, "malformed": 0, "missing_fields": 0, "unknown_types": 1}


def test_missing_field_names_event_and_field(spark):
    res = ingest_lines(spark, [batch(event("claude_code.api_request", 0),
                                     event("claude_code.user_prompt", 1, drop=["prompt_length"]))])
    assert counts(res)["missing_fields"] == 1
    (rej,) = res.rejects.collect()
    assert rej["reason"] == "missing_fields" and rej["line"] == 1
    assert rej["detail"] == ("Line 1 (event index 1): missing or invalid field in "
                             "'claude_code.user_prompt': 'prompt_length'")
    assert rej["source_file"].endswith("telemetry.jsonl")


def test_tool_result_without_size_is_kept_with_null(spark):
    res = ingest_lines(spark, [batch(event("claude_code.tool_result", drop=["tool_result_size_bytes"]))])
    (r,) = res.tables.tool_results.collect()
    assert r["result_size_bytes"] is None and r["success"] is True


@pytest.mark.parametrize("make", [
    lambda: {"id": "1", "timestamp": 1},                                        # no message
    lambda: {"id": "1", "timestamp": 1, "message": "{not json"},                # bad message
    lambda: {"id": "1", "timestamp": 1, "message": json.dumps({"body": "claude_code.user_prompt",
                                                              "attributes": {}})},   # empty attributes
    lambda: {"id": "1", "timestamp": 1, "message": json.dumps({"attributes": {"a": "b"}})},  # no body
    lambda: event("claude_code.api_request", model=None),                       # JSON null value
    lambda: event("claude_code.user_prompt", prompt_length="12.5"),             # not an int
    lambda: event("claude_code.user_prompt", **{"event.timestamp": "yesterday"}),  # bad timestamp
    lambda: event("claude_code.tool_result", tool_result_size_bytes="big"),     # bad optional int
])
def test_bad_events_are_missing_fields(spark, make):
    c = counts(ingest_lines(spark, [batch(make(), event("claude_code.user_prompt", 5))]))
    assert c == {"ingested": 1, "malformed": 0, "missing_fields": 1, "unknown_types": 0}


def test_lenient_numbers_and_zone_offsets(spark):
    res = ingest_lines(spark, [batch(
        event("claude_code.user_prompt", 0, prompt_length=" 42 "),
        event("claude_code.user_prompt", 1, **{"event.timestamp": "2025-12-10T12:00:00+02:00"}))])
    got = sorted((r["prompt_length"], str(r["timestamp"])) for r in res.tables.user_prompts.collect())
    assert got == [(42, "2025-12-10 10:00:00"), (420, "2025-12-10 10:00:00")]


def test_success_other_than_true_is_false(spark):
    res = ingest_lines(spark, [batch(event("claude_code.tool_result", success="yes"))])
    assert res.tables.tool_results.first()["success"] is False


def test_reject_summary_keeps_counts_and_first_locations(spark):
    lines = ["bad"] * 12 + [batch(event("claude_code.unknown_x", i)) for i in range(3)]
    s = {r["reason"]: r for r in I.reject_summary(ingest_lines(spark, lines).rejects).collect()}
    assert s["malformed"]["count"] == 12 and len(s["malformed"]["first_locations"]) == 10
    assert s["unknown_types"]["count"] == 3
    assert s["missing_fields"]["count"] == 0 and s["missing_fields"]["first_locations"] == []
    assert s["total_skipped"]["count"] == 15


def test_duplicate_employee_email_fails(spark):
    emp = I.read_employees_csv(spark, employees_csv((("a@x", "A", "P", "L1", "C"), ("a@x", "B", "P", "L1", "C"))))
    with pytest.raises(ValueError, match="a@x"):
        I.check_employee_keys(emp)


def test_write_overwrites_tables(spark):
    res = ingest_lines(spark, SAMPLE)
    out = tempfile.mkdtemp(prefix="tt-out-")
    assert res.write(out)["ingested"] == 5
    assert res.write(out)["ingested"] == 5       # idempotent rebuild
    assert spark.read.parquet(f"{out}/api_requests").count() == 1
    assert "event_date" in spark.read.parquet(f"{out}/user_prompts").columns


def test_pack_then_ingest_round_trip(spark):
    rows = [(i, 1765360800000 + i * 1000,
             event(list(SPECIFIC)[i % 5], i % 60)["message"]) for i in range(40)]
    ev = spark.createDataFrame(rows, "id long, ts long, message string") \
              .withColumn("b", F.expr("id div 7"))
    lines = X.pack_batches(ev, "b", "id", id_col="id", epoch_ms_col="ts")
    assert lines.count() == 6
    d = tempfile.mkdtemp(prefix="tt-pack-")
    X.write_lines(lines, d + "/lines")
    res = I.ingest(I.read_batch_lines(spark, d + "/lines"), I.read_employees_csv(spark, employees_csv()),
                   persist=False)
    assert counts(res)["ingested"] == 40
    first = lines.orderBy("b").first()["value"]
    assert json.loads(first)["logEvents"][0]["id"] == "0"
    assert json.loads(first)["year"] == 2025


def test_employee_csv_round_trip(spark):
    emp = I.read_employees_csv(spark, employees_csv())
    d = tempfile.mkdtemp(prefix="tt-emp-")
    X.write_employees_csv(emp, d + "/e")
    back = I.read_employees_csv(spark, d + "/e")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, emp.collect()))


def test_employee_row_with_missing_field_is_a_constraint_reject(spark):
    d = employees_csv((("a@x", "A", "P", "L1", "C"), ("b@x", "", "P", "L2", "C")))
    res = I.ingest(I.read_batch_lines(spark, write(SAMPLE)), I.read_employees_csv(spark, d), persist=False)
    assert [r["email"] for r in res.tables.employees.collect()] == ["a@x"]
    (rej,) = res.rejects.where("reason = 'constraint'").collect()
    assert '"b@x"' in rej["raw"]


def test_k15_redelivered_batches_count_twice(spark):
    c = counts(ingest_lines(spark, SAMPLE + SAMPLE))
    assert c["ingested"] == 10


def test_curated_tables_read_back_and_prune_by_event_date(spark):
    import contextlib
    import io

    from tokentally.operators.filters import Filters
    from tokentally.plans import catalog
    from tokentally.sources.tables import Tables
    res = ingest_lines(spark, SAMPLE)
    out = tempfile.mkdtemp(prefix="tt-cur-")
    res.write(out)
    t = Tables.from_parquet(spark, out)
    f = Filters(date_start="2025-12-01", date_end="2025-12-31")
    (r,) = catalog.run("q1_kpi_metrics", t, f).collect()
    assert r["total_sessions"] == 1 and r["total_cost"] == 0.005
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        catalog.run("q5_cost_by_practice_over_time", t, f).explain("formatted")
    assert "PartitionFilters: [isnotnull(event_date" in buf.getvalue()


def test_reject_line_numbers_are_exact_across_splits(spark):
    # one file cut into many splits: numbering must still count every line
    lines = [SAMPLE[i % 2] for i in range(200)]
    bad_at = {7, 64, 133, 199}
    for i in bad_at:
        lines[i - 1] = "not json " + str(i)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        res = ingest_lines(spark, lines)
        got = sorted(r["line"] for r in res.rejects.collect())
        assert I.read_batch_lines(spark, write(lines)).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted(bad_at)
    s = {r["reason"]: r for r in I.reject_summary(res.rejects).collect()}
    assert [d.split(" ", 1)[1] for d in s["malformed"]["first_locations"]] == [
        f"Line {i}: malformed JSON line" for i in sorted(bad_at)]


def test_lines_without_events_are_counted_for_numbering_only(spark):
    lines = [batch(), json.dumps({"messageType": "CONTROL_MESSAGE"}), "bad", SAMPLE[0]]
    res = ingest_lines(spark, lines)
    assert counts(res) == {"ingested": 3, "malformed": 1, "missing_fields": 0, "unknown_types": 0}
    (rej,) = res.rejects.collect()
    assert rej["line"] == 3 and rej["detail"] == "Line 3: malformed JSON line"


def test_run_ingest_end_to_end(spark):
    out = tempfile.mkdtemp(prefix="tt-run-")
    c = I.run_ingest(spark, write(SAMPLE + ["broken"]), employees_csv(), output_root=out)
    assert c == {"ingested": 5, "malformed": 1, "missing_fields": 0, "unknown_types": 0}
    rej = spark.read.parquet(f"{out}/rejects").collect()
    assert [r["detail"] for r in rej] == ["Line 3: malformed JSON line"]


def test_staged_table_gives_the_same_result(spark):
    lines = SAMPLE + ["broken", batch(event("claude_code.unknown_x", 3))]
    emp = I.read_employees_csv(spark, employees_csv())
    a = I.ingest(I.read_batch_lines(spark, write(lines)), emp, persist=False)
    b = I.ingest(I.read_batch_lines(spark, write(lines)), emp, stage="table")
    assert counts(a) == counts(b)
    for t in ("user_prompts", "api_requests", "tool_results"):
        assert sorted(map(tuple, a.tables.fact(t).collect())) == sorted(map(tuple, b.tables.fact(t).collect()))
    assert sorted(r["detail"] for r in a.rejects.collect()) == sorted(r["detail"] for r in b.rejects.collect())


def test_employee_csv_standard_quoting_both_ways(spark):
    import csv
    rows = [("a@x.com", 'Ann "Bo" Lee', "P, Q", "L1", "Line one\nline two"), ("b@x.com", "plain", "P", "L2", 'back\\slash "q"')]
    cols = ["email", "full_name", "practice", "level", "location"]
    path = tempfile.mkdtemp(prefix="tt-csv-") + "/in.csv"
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows([cols, *rows])
    assert sorted(tuple(r) for r in I.read_employees_csv(spark, path).collect()) == rows
    from tokentally.sources import export
    out = tempfile.mkdtemp(prefix="tt-csv-") + "/out"
    export.write_employees_csv(spark.createDataFrame(rows, cols).coalesce(1), out)
    import glob
    with open(glob.glob(out + "/part-*")[0], newline="") as f:
        assert sorted(map(tuple, list(csv.reader(f))[1:])) == rows
