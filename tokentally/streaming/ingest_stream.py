"""The ingest and the daily cost as Structured Streaming jobs.

E1 runs the batch ingest's transforms (S1-S13) on every micro-batch of new
JSONL files.  Each micro-batch overwrites its own ``batch_id=<n>`` folder, so a
batch retried after a failure replaces its earlier output instead of adding to
it (exactly-once with the checkpointed file source).  Like the reference, events
re-delivered in *different* files are not deduplicated (K15).

E2 keeps a per-(day, practice) running cost with a one-day watermark and
appends each day once it is closed; it equals Q5 on closed days. Its upserting form emits every
change instead, late requests included, and equals Q5 on all days.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tokentally.functions.columns import event_day
from tokentally.sources.ingest import (
    classify_lines,
    file_columns,
    line_offsets,
    project_table,
    rejects_of,
)
from tokentally.sources.schemas import API_REQUESTS, FACT_SCHEMAS
from tokentally.sources.tables import DEFAULT_BROADCAST_MAX_ROWS


_SEEN = "line_sha string, seen_at timestamp"
_MANIFEST = "folder string, newest timestamp"
MAX_SEEN_FOLDERS = 8


def _drop_redelivered(batch: DataFrame, batch_id: int, seen_root: str, within: str) -> DataFrame:
    """Rows of the micro-batch that were not delivered before (same text, within the delay).

    Only lines that hold an event can be redeliveries; malformed and empty ones always pass.

    The seen lines are a few folders that the manifest of the micro-batch before names; this one adds
    a folder and writes its own manifest last. A retried micro-batch starts from the same manifest
    and overwrites what it left, so it never meets its own lines. Folders whose newest line is past the delay
    are dropped unread; beyond ``MAX_SEEN_FOLDERS`` the live lines are merged into one. State and files read
    are bounded by the delay, not by the stream's age.
    """
    spark = batch.sparkSession
    has_event = F.get_json_object("value", "$.logEvents[0]").isNotNull()
    rows = batch.withColumn("line_sha", F.when(has_event, F.sha2("value", 256)))
    first = rows.where("line_sha is not null").groupBy("line_sha").agg(F.min("row_id").alias("first_row"))
    limit = F.current_timestamp() - F.expr(f"INTERVAL {within}")
    folders = spark.read.schema(_MANIFEST).parquet(f"{seen_root}/manifest/batch_id={batch_id - 1}").where(F.col("newest") >= limit).collect()
    live = spark.read.schema(_SEEN).parquet(*[r["folder"] for r in folders]) if folders else spark.createDataFrame([], _SEEN)
    live = live.where(F.col("seen_at") >= limit)
    new = first.join(live, "line_sha", "left_anti")
    added = f"{seen_root}/lines/batch_id={batch_id}"
    fresh = first.select("line_sha", F.current_timestamp().alias("seen_at"))
    merge = len(folders) >= MAX_SEEN_FOLDERS
    (fresh.unionByName(live) if merge else fresh).write.mode("overwrite").parquet(added)
    newest = spark.range(1).select(F.lit(added).alias("folder"), F.current_timestamp().alias("newest"))
    kept = spark.createDataFrame([] if merge else folders, _MANIFEST)
    kept.unionByName(newest).coalesce(1).write.mode("overwrite").parquet(f"{seen_root}/manifest/batch_id={batch_id}")
    _remove_unnamed(spark, seen_root, batch_id)
    kept = new.select(F.col("first_row").alias("row_id"), F.lit(True).alias("is_new"))
    # Only ids move if they are few: shuffled lines would leave one file per shuffle partition and day in every table.
    if batch.count() <= DEFAULT_BROADCAST_MAX_ROWS:
        kept = F.broadcast(kept)
    out = rows.join(kept, "row_id", "left").where(F.col("line_sha").isNull() | F.col("is_new"))
    return out.drop("line_sha", "is_new").select(*batch.columns).persist(StorageLevel.MEMORY_AND_DISK)


def _remove_unnamed(spark: SparkSession, seen_root: str, batch_id: int) -> None:
    """Delete folders and manifests that neither this micro-batch nor a retry of it needs."""
    named = {r["folder"] for b in (batch_id, batch_id - 1)
             for r in spark.read.schema(_MANIFEST).parquet(f"{seen_root}/manifest/batch_id={b}").collect()}
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(seen_root).getFileSystem(spark._jsc.hadoopConfiguration())
    for kind, needed in (("lines", lambda p: p in named), ("manifest", lambda p: p.rsplit("=", 1)[1] in (str(batch_id), str(batch_id - 1)))):
        if fs.exists(path(f"{seen_root}/{kind}")):
            for status in fs.listStatus(path(f"{seen_root}/{kind}")):
                name = status.getPath().getName()
                if name.startswith("batch_id=") and not needed(f"{seen_root}/{kind}/{name}"):
                    fs.delete(status.getPath(), True)


def _write_batch(output_root: str, dedupe_within: str | None = None):
    root = output_root.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        # row ids are per micro-batch (a plain DataFrame here), given before any line is dropped
        batch = batch.withColumn("row_id", F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
        lines = _drop_redelivered(batch, batch_id, f"{root}/seen_lines", dedupe_within) if dedupe_within else batch
        classified = classify_lines(lines).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for t in FACT_SCHEMAS:
                (project_table(classified, t).withColumn("event_date", event_day("timestamp"))
                 .write.mode("overwrite").partitionBy("event_date")
                 .parquet(f"{root}/{t}/batch_id={batch_id}"))
            # every file lies wholly inside one micro-batch, so line numbers are exact
            rejects_of(classified, line_offsets(batch)).write.mode("overwrite") \
                .parquet(f"{root}/rejects/batch_id={batch_id}")
        finally:
            classified.unpersist()
            lines.unpersist()
            batch.unpersist()
    return write


def start_ingest_stream(spark: SparkSession, source_dir: str, output_root: str, checkpoint: str,
                        available_now: bool = True, max_files_per_trigger: int | None = None,
                        processing_time: str = "1 minute",
                        dedupe_within: str | None = None) -> StreamingQuery:
    """Watch ``source_dir`` for JSONL batch files and ingest each new file once.

    ``dedupe_within`` (e.g. "1 hour"): drop a batch line delivered again (same
    text) within that time of an earlier delivery.  Lines are compared with a
    table of seen lines under ``output_root``; a line never seen is never
    dropped, however late its events, and malformed or empty lines always reach
    the rejects.  Off by default, as in the batch ingest (K15).
    """
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    lines = file_columns(reader.load(source_dir))
    if dedupe_within:
        # an empty manifest, which the first micro-batch starts from
        spark.createDataFrame([], _MANIFEST).coalesce(1).write.mode("overwrite") \
            .parquet(f"{output_root.rstrip('/')}/seen_lines/manifest/batch_id=-1")
    w = lines.writeStream.foreachBatch(_write_batch(output_root, dedupe_within)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


def read_stream_table(spark: SparkSession, output_root: str, table: str) -> DataFrame:
    """A table written by E1 (all micro-batches), in DDL column order."""
    df = spark.read.parquet(f"{output_root.rstrip('/')}/{table}")
    return df.select(*FACT_SCHEMAS[table].fieldNames()) if table in FACT_SCHEMAS else df


def daily_cost_stream(requests: DataFrame, employees: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Streaming api_requests -> (date, practice, total_cost) per closed day.

    A stream-static join to the directory (broadcast under the counted bound), then a tumbling
    one-day window; with the watermark each day is emitted once, in append mode.
    """
    # Watermarks need an instant (TIMESTAMP); the facts hold the UTC wall clock
    # (TIMESTAMP_NTZ).  Epoch microseconds convert it without the session zone.
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    instant = F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col("timestamp")))
    j = _with_practice(requests.withColumn("event_time", instant).withWatermark("event_time", watermark), employees)
    agg = j.groupBy(F.window("event_time", "1 day").alias("w"), "practice") \
           .agg(F.sum("cost_usd").alias("total_cost"))
    day = F.date_from_unix_date(F.floor(F.unix_micros(F.col("w.start")) / F.lit(86_400_000_000)).cast("int"))
    return agg.select(day.alias("date"), "practice", "total_cost")


def _with_practice(requests: DataFrame, employees: DataFrame) -> DataFrame:
    emp = employees.select("email", "practice")
    # broadcast only a directory under the checked row bound (counted once here)
    if emp.count() <= DEFAULT_BROADCAST_MAX_ROWS:
        emp = F.broadcast(emp)
    return requests.join(emp, F.col("user_email") == F.col("email"))


def start_daily_cost_upserts(spark: SparkSession, requests_dir: str, employees: DataFrame, output_root: str, checkpoint: str,
                             max_files_per_trigger: int | None = None, state_partitions: int | None = None) -> StreamingQuery:
    """E2 without a closing day: totals per (date, practice) that late requests correct.

    Update mode keeps one sum per day and practice, however old, and emits those that a micro-batch changed; the
    sink writes them as that micro-batch's version, by day. A retried micro-batch overwrites its own version.
    Work per micro-batch follows its changed days. ``read_daily_cost`` takes each key's latest version.
    """
    reader = spark.readStream.schema(T.StructType(API_REQUESTS.fields + [T.StructField("event_date", T.DateType())]))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    totals = _with_practice(reader.parquet(requests_dir), employees).groupBy(event_day("timestamp").alias("date"), "practice") \
        .agg(F.sum("cost_usd").alias("total_cost"), F.count(F.lit(1)).alias("n_requests"))

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.repartition("date").write.mode("overwrite").partitionBy("date").parquet(f"{output_root.rstrip('/')}/version={batch_id}")

    query = totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return _start(spark, query, state_partitions)


def read_daily_cost(spark: SparkSession, output_root: str, date_start=None, date_end=None) -> DataFrame:
    """(date, practice, total_cost, n_requests, corrections): the latest version of each key; earlier ones were corrected.

    Date bounds prune the folders of other days.
    """
    versions = spark.read.schema("practice string, total_cost double, n_requests bigint, version bigint, date date").parquet(output_root)
    if date_start is not None:
        versions = versions.where(F.col("date") >= F.lit(date_start).cast("date"))
    if date_end is not None:
        versions = versions.where(F.col("date") <= F.lit(date_end).cast("date"))
    return versions.groupBy("date", "practice").agg(
        F.max_by("total_cost", "version").alias("total_cost"), F.max_by("n_requests", "version").alias("n_requests"),
        (F.count(F.lit(1)) - 1).alias("corrections"))


def _start(spark: SparkSession, query, state_partitions: int | None) -> StreamingQuery:
    """Start with the state spread over ``state_partitions`` (default: the cluster's parallelism).

    Spark fixes that number when a query first starts from a checkpoint, so it is set only around ``start()``.
    """
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(state_partitions or spark.sparkContext.defaultParallelism))
    try:
        return query.start()
    finally:
        spark.conf.set(key, before)


def start_daily_cost_stream(spark: SparkSession, requests_dir: str, employees: DataFrame,
                            output_dir: str, checkpoint: str, watermark: str = "1 day",
                            state_partitions: int | None = None) -> StreamingQuery:
    """E2 as a running query (append mode, one row per closed day and practice).

    ``state_partitions`` sets how many partitions hold the aggregation state.
    """
    schema = T.StructType(API_REQUESTS.fields + [T.StructField("event_date", T.DateType())])
    daily_cost = daily_cost_stream(spark.readStream.schema(schema).parquet(requests_dir), employees, watermark)
    return _start(spark, daily_cost.writeStream.outputMode("append").format("parquet").option("path", output_dir)
                  .option("checkpointLocation", checkpoint).trigger(availableNow=True), state_partitions)
