"""S20/S21 sinks: pack events into CloudWatch-style JSONL batches; write the employee CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentally.session import ensure_checkpoint_dir
from tokentally.sources.schemas import EMPLOYEES

# Batch envelope fields (not read by ingest).
MESSAGE_TYPE = "DATA_MESSAGE"
OWNER = "123456789012"
LOG_GROUP = "/claude-code/telemetry"
LOG_STREAM = "otel-collector"
SUBSCRIPTION_FILTERS = ["logs-to-s3"]

MAX_BATCH = 10       # events in a batch of the ordered stream
STRETCH = 1000       # consecutive events that are cut together
MAX_GROUP = 100_000  # events that a ready batch key may gather


def render_message(body: Column, attributes: Column) -> Column:
    """The double-encoded event: a JSON object text with body and attributes."""
    return F.to_json(F.struct(body.alias("body"), attributes.alias("attributes")))


def pack_batches(events: DataFrame, batch_key: str, order_key: str,
                 id_col: str = "id", epoch_ms_col: str = "timestamp",
                 message_col: str = "message", max_events: int = MAX_GROUP) -> DataFrame:
    """S20 with a ready key: one JSON line per batch, events ordered inside it, plus the
    year/month/day (UTC) of the batch's first event.

    ``batch_key`` must bound the events per batch by construction (for example
    ``event_id div 7``); a batch of more than ``max_events`` raises. ``cut_batches`` needs no key.
    Output: ``batch_key``, ``value`` (the line).
    """
    item = _item(F.col(order_key), id_col, epoch_ms_col, message_col)
    grouped = events.groupBy(batch_key).agg(F.sort_array(F.collect_list(item)).alias("evs"))
    too_many = F.raise_error(F.concat(F.lit("batch of more than "), F.lit(str(max_events)), F.lit(" events: choose a finer key"))).cast("string")
    return grouped.select(batch_key, F.when(F.size("evs") > max_events, too_many).otherwise(_line(F.col("evs"))).alias("value"))


def cut_batches(events: DataFrame, order_cols: list[str], seed: int = 42, max_size: int = MAX_BATCH,
                id_col: str = "id", epoch_ms_col: str = "timestamp", message_col: str = "message") -> DataFrame:
    """The events in the order of ``order_cols`` (unique together), cut into batches of 1 to ``max_size`` events.

    Every event gets its rank in the whole stream: range partitions are sorted and numbered, and the counts of
    the partitions before are added. Ranks, not times, are then grouped in stretches of 1,000, so a hot
    timestamp spreads and batches cross partition ends. A stretch is cut by sizes that follow from ``seed`` and
    the place in the stream alone; its last batch ends with it.
    Output: ``batch_no`` (increasing along the stream), ``value`` (the line as in ``pack_batches``).
    """
    ranked = rank_rows(events, order_cols)
    item = _item(F.col("rank"), id_col, epoch_ms_col, message_col)
    stretches = ranked.groupBy(F.floor(F.col("rank") / F.lit(STRETCH)).alias("stretch")).agg(F.sort_array(F.collect_list(item)).alias("evs"))
    size = lambda j: batch_size(F.col("stretch") * STRETCH + j, seed, max_size)
    none = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    cuts = F.aggregate(F.sequence(F.lit(0), F.lit(STRETCH - 1)), none, lambda acc, j: F.when(
        acc["at"] < F.size("evs"), F.struct((acc["at"] + size(j)).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts"))).otherwise(acc))
    batches = stretches.select("stretch", "evs", F.posexplode(cuts["starts"]).alias("j", "start"))
    own = F.slice("evs", (F.col("start") + 1).cast("int"), size(F.col("j")).cast("int"))
    return batches.select((F.col("stretch") * STRETCH + F.col("j")).alias("batch_no"), _line(own).alias("value"))


def batch_size(place: Column, seed: int, max_size: int) -> Column:
    """1 to ``max_size``, from a linear congruence of the place in the stream."""
    x = F.pmod(place.cast("bigint") + F.lit(seed), F.lit(1 << 31)) * F.lit(1_103_515_245) + F.lit(12_345)
    return F.floor(F.pmod(x, F.lit(1 << 31)) / F.lit(1 << 16)).cast("bigint") % max_size + 1


def rank_rows(rows: DataFrame, order_cols: list[str]) -> DataFrame:
    """``rows`` with ``rank``, their place (from 0) in the order of ``order_cols``, without a window over all rows.

    The ordered rows are checkpointed, so both passes see the same partitions.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    ordered = rows.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols) \
        .withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}).checkpoint(eager=True)
    parts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_row0"))  # one row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("_part", (before - F.col("_row0")).alias("_shift"))
    return ordered.join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


def _item(order: Column, id_col: str, epoch_ms_col: str, message_col: str) -> Column:
    return F.struct(order.alias("o"), F.col(id_col).cast("string").alias("id"),
                    F.col(epoch_ms_col).cast("bigint").alias("timestamp"), F.col(message_col).alias("message"))


def _line(evs: Column) -> Column:
    """The JSON line of a batch of ordered events."""
    first_day = F.date_from_unix_date(F.floor(F.get(evs, 0)["timestamp"] / F.lit(86_400_000)).cast("int"))
    log_events = F.transform(evs, lambda x: F.struct(x["id"].alias("id"), x["timestamp"].alias("timestamp"), x["message"].alias("message")))
    return F.to_json(F.struct(
        F.lit(MESSAGE_TYPE).alias("messageType"), F.lit(OWNER).alias("owner"),
        F.lit(LOG_GROUP).alias("logGroup"), F.lit(LOG_STREAM).alias("logStream"),
        F.array(*[F.lit(s) for s in SUBSCRIPTION_FILTERS]).alias("subscriptionFilters"),
        log_events.alias("logEvents"),
        F.year(first_day).alias("year"), F.month(first_day).alias("month"),
        F.dayofmonth(first_day).alias("day")))


def write_lines(lines: DataFrame, path: str) -> None:
    """Write the ``value`` column as text (one batch per line)."""
    lines.select("value").write.mode("overwrite").text(path)


def write_employees_csv(employees: DataFrame, path: str) -> None:
    """Header + the five columns in order."""
    (employees.select(*EMPLOYEES.fieldNames())
     .write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path))
