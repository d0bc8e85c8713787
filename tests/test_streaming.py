"""Streaming ingest equals the batch ingest; reruns of a batch do not duplicate."""

import tempfile

import pytest

from tokentally.sources import driver_tables as D
from tokentally.sources import export as X
from tokentally.sources import ingest as I
from tokentally.streaming import ingest_stream as S

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    src = tempfile.mkdtemp(prefix="tt-src-") + "/in"
    X.write_lines(D.telemetry_lines(D.read_driver(spark, SF, "events")), src)
    out, ck = tempfile.mkdtemp(prefix="tt-out-"), tempfile.mkdtemp(prefix="tt-ck-")
    S.start_ingest_stream(spark, src, out, ck, max_files_per_trigger=1).awaitTermination()
    batch = I.ingest(I.read_batch_lines(spark, src), D.employees_view(
        *[D.read_driver(spark, SF, n) for n in ("customer", "nation", "region")]), persist=False)
    for t in ("user_prompts", "api_requests", "tool_results"):
        a = sorted(map(tuple, S.read_stream_table(spark, out, t).collect()))
        b = sorted(map(tuple, batch.tables.fact(t).collect()))
        assert a == b, t
    # a restart with the same checkpoint finds nothing new
    S.start_ingest_stream(spark, src, out, ck).awaitTermination()
    assert S.read_stream_table(spark, out, "api_requests").count() == batch.tables.api_requests.count()


def test_watermarked_daily_cost_emits_closed_days(spark):
    import datetime as dt

    from pyspark.sql import functions as F
    src = tempfile.mkdtemp(prefix="tt-src2-") + "/in"
    X.write_lines(D.telemetry_lines(D.read_driver(spark, SF, "events")), src)
    out, ck = tempfile.mkdtemp(prefix="tt-out2-"), tempfile.mkdtemp(prefix="tt-ck2-")
    S.start_ingest_stream(spark, src, out, ck).awaitTermination()
    emp = D.employees_view(*[D.read_driver(spark, SF, n) for n in ("customer", "nation", "region")])
    res, ck2 = tempfile.mkdtemp(prefix="tt-res-") + "/r", tempfile.mkdtemp(prefix="tt-ck3-")
    S.start_daily_cost_stream(spark, f"{out}/api_requests", emp, res, ck2).awaitTermination()
    got = {(r["date"], r["practice"]): r["total_cost"] for r in spark.read.parquet(res).collect()}
    ar = S.read_stream_table(spark, out, "api_requests")
    last = ar.agg(F.max("timestamp")).first()[0]
    j = ar.join(emp, ar.user_email == emp.email)
    exp = {(r["d"], r["practice"]): r["c"] for r in
           j.groupBy(F.to_date("timestamp").alias("d"), "practice").agg(F.sum("cost_usd").alias("c")).collect()
           if dt.datetime.combine(r["d"], dt.time()) + dt.timedelta(days=2) <= last}
    assert set(got) == set(exp) and len(got) > 0
    for key, v in exp.items():
        assert got[key] == pytest.approx(v)


def test_redelivered_batches_can_be_dropped(spark):
    import shutil
    src = tempfile.mkdtemp(prefix="tt-src3-")
    X.write_lines(D.telemetry_lines(D.read_driver(spark, SF, "events")), src + "/a")
    files = sorted(f for f in __import__("os").listdir(src + "/a") if f.startswith("part-"))
    feed = src + "/feed"
    __import__("os").makedirs(feed)
    for f in files:
        shutil.copy(f"{src}/a/{f}", f"{feed}/{f}")
    shutil.copy(f"{src}/a/{files[0]}", f"{feed}/again-{files[0]}")      # one file delivered twice
    out, ck = tempfile.mkdtemp(prefix="tt-out4-"), tempfile.mkdtemp(prefix="tt-ck4-")
    S.start_ingest_stream(spark, feed, out, ck, dedupe_within="1 day").awaitTermination()
    batch = I.ingest(I.read_batch_lines(spark, src + "/a"), D.employees_view(
        *[D.read_driver(spark, SF, n) for n in ("customer", "nation", "region")]), persist=False)
    assert S.read_stream_table(spark, out, "api_requests").count() == batch.tables.api_requests.count()


def test_dedupe_never_drops_a_first_delivery(spark):
    """Late first-time lines, malformed lines and empty batches reach tables or rejects with their line numbers."""
    import json
    import os
    import time

    def line(day, n):
        attrs = {"session.id": f"s{n}", "user.email": "a@x.com", "event.timestamp": f"2025-12-{day:02d}T10:00:00.{n:03d}Z", "prompt_length": "5",
                 "terminal.type": "t", "event.name": "user_prompt"}
        message = json.dumps({"body": "claude_code.user_prompt", "attributes": attrs})
        return json.dumps({"logEvents": [{"id": str(n), "timestamp": 1_766_000_000_000 + n, "message": message}]})

    src, out, ck = (tempfile.mkdtemp(prefix=p) for p in ("tt-src5-", "tt-out5-", "tt-ck5-"))
    feeds = [[line(20, n) for n in range(30)],
             [line(20, n) for n in range(30, 40)] + ["not json"] * 5 + ['{"logEvents": []}'],
             [line(5, n) for n in range(40, 50)],
             [line(20, n) for n in range(30)] + ["again not json"]]  # the first file once more
    for i, own in enumerate(feeds):
        with open(f"{src}/f{i}.jsonl", "w") as f:
            f.write("\n".join(own) + "\n")
        os.utime(f"{src}/f{i}.jsonl", (time.time() - 100 + i, time.time() - 100 + i))
    S.start_ingest_stream(spark, src, out, ck, max_files_per_trigger=1, dedupe_within="1 day").awaitTermination()
    assert S.read_stream_table(spark, out, "user_prompts").count() == 50
    rejects = S.read_stream_table(spark, out, "rejects").where("reason = 'malformed'")
    assert sorted((os.path.basename(r.source_file), r.line) for r in rejects.collect()) == \
        [("f1.jsonl", n) for n in range(11, 16)] + [("f3.jsonl", 31)]


def _telemetry_line(day, n, cost=None):
    import json
    attrs = {"session.id": f"s{n}", "user.email": "a@x.com", "event.timestamp": f"2025-12-{day:02d}T10:00:00.{n % 1000:03d}Z", "terminal.type": "t"}
    if cost is None:
        attrs |= {"event.name": "user_prompt", "prompt_length": "5"}
        body = "claude_code.user_prompt"
    else:
        attrs |= {"event.name": "api_request", "model": "m", "cost_usd": str(cost), "duration_ms": "1", "input_tokens": "1", "output_tokens": "1",
                  "cache_read_tokens": "0", "cache_creation_tokens": "0"}
        body = "claude_code.api_request"
    return json.dumps({"logEvents": [{"id": str(n), "timestamp": 1_766_000_000_000 + n, "message": json.dumps({"body": body, "attributes": attrs})}]})


def test_seen_lines_stay_bounded(spark):
    """Over 25 micro-batches, a line comes again after 1, 9 and 20 of them; folders, files and manifests stay level."""
    import os
    import time
    src, out, ck = (tempfile.mkdtemp(prefix=p) for p in ("tt-src6-", "tt-out6-", "tt-ck6-"))
    for i in range(25):
        own = [_telemetry_line(20, 10 * i + k) for k in range(3)] + [_telemetry_line(20, 10 * (i - back)) for back in (1, 9, 20) if i >= back]
        with open(f"{src}/f{i:02d}.jsonl", "w") as f:
            f.write("\n".join(own) + "\n")
        os.utime(f"{src}/f{i:02d}.jsonl", (time.time() - 100 + i, time.time() - 100 + i))
    S.start_ingest_stream(spark, src, out, ck, max_files_per_trigger=1, dedupe_within="1 day").awaitTermination()
    assert S.read_stream_table(spark, out, "user_prompts").count() == 75
    folders = os.listdir(f"{out}/seen_lines/lines")
    assert len(folders) <= S.MAX_SEEN_FOLDERS + 2
    assert sorted(os.listdir(f"{out}/seen_lines/manifest")) == ["batch_id=23", "batch_id=24"]


def test_expired_and_retried_lines(spark):
    """Past the delay a line counts anew; a micro-batch that runs twice has one outcome."""
    from pyspark.sql import functions as F
    root = tempfile.mkdtemp(prefix="tt-seen-")
    spark.createDataFrame([], S._MANIFEST).write.parquet(f"{root}/manifest/batch_id=-1")
    rows = spark.createDataFrame([(_telemetry_line(20, n),) for n in (1, 2, 2)], "value string").coalesce(1) \
        .withColumn("row_id", F.monotonically_increasing_id())
    for _ in range(2):
        assert S._drop_redelivered(rows, 0, root, "1 hour").count() == 2
    assert S._drop_redelivered(rows, 1, root, "1 hour").count() == 0
    assert S._drop_redelivered(rows, 2, root, "0 seconds").count() == 2


def test_late_requests_correct_their_day(spark):
    import datetime as dt
    import os
    import time

    from tokentally.sources.schemas import API_REQUESTS
    src, res, ck = (tempfile.mkdtemp(prefix=p) for p in ("tt-src7-", "tt-res7-", "tt-ck7-"))
    emp = spark.createDataFrame([("a@x.com", "P"), ("b@x.com", "Q")], "email string, practice string")
    feeds = [[(1, "a", 1.0), (1, "b", 2.0), (2, "a", 4.0)], [(20, "a", 8.0)], [(1, "a", 16.0), (3, "b", 32.0), (3, "c", 64.0)]]
    for i, feed in enumerate(feeds):  # the third file is nineteen days late
        rows = [{**dict.fromkeys(API_REQUESTS.fieldNames()), "user_email": f"{u}@x.com", "cost_usd": c, "timestamp": dt.datetime(2025, 12, d, 23)} for d, u, c in feed]
        names = API_REQUESTS.fieldNames()
        nullable = type(API_REQUESTS)([type(f)(f.name, f.dataType, True) for f in API_REQUESTS.fields])
        spark.createDataFrame([tuple(r[n] for n in names) for r in rows], nullable).coalesce(1).write.mode("append").parquet(src)
        for f in os.listdir(src):
            if f.endswith(".parquet") and not os.path.exists(f"{src}/.seen-{f}"):
                os.utime(f"{src}/{f}", (time.time() - 100 + i, time.time() - 100 + i))
                open(f"{src}/.seen-{f}", "w").close()
        S.start_daily_cost_upserts(spark, src, emp, res, ck, max_files_per_trigger=1).awaitTermination()
    got = {(r.date.day, r.practice): (r.total_cost, r.n_requests, r.corrections) for r in S.read_daily_cost(spark, res).collect()}
    assert got == {(1, "P"): (17.0, 2, 1), (1, "Q"): (2.0, 1, 0), (2, "P"): (4.0, 1, 0), (3, "Q"): (32.0, 1, 0), (20, "P"): (8.0, 1, 0)}
    assert {r.date.day for r in S.read_daily_cost(spark, res, "2025-12-02", "2025-12-03").collect()} == {2, 3}


def test_dropping_lines_moves_only_their_ids(spark, monkeypatch):
    """The lines stay in their partitions; beyond the broadcast bound the shuffled join keeps the same ones."""
    from pyspark.sql import functions as F
    lines = [_telemetry_line(20, n % 40) for n in range(60)] + ["not json"] * 3
    rows = spark.createDataFrame([(v,) for v in lines], "value string").repartition(3).withColumn("row_id", F.monotonically_increasing_id()).persist()
    got = []
    for bound in (S.DEFAULT_BROADCAST_MAX_ROWS, 0):
        monkeypatch.setattr(S, "DEFAULT_BROADCAST_MAX_ROWS", bound)
        root = tempfile.mkdtemp(prefix="tt-seen-")
        spark.createDataFrame([], S._MANIFEST).write.parquet(f"{root}/manifest/batch_id=-1")
        out = S._drop_redelivered(rows, 0, root, "1 hour")
        got.append(sorted(map(tuple, out.collect())))
        assert out.columns == rows.columns
        if bound:
            assert out.rdd.getNumPartitions() == 3
    rows.unpersist()
    assert got[0] == got[1] and len(got[0]) == 43 and sum(v == "not json" for v, _ in got[0]) == 3


def test_classification_leaves_no_method_too_long_to_compile(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.unset(key)
    I.classify_lines(spark.createDataFrame([("x",)], "value string"))
    assert spark.conf.get(key) == "8000"
