"""Reshaping and distribution operators over query results.

All of them work on DataFrames and stay distributed; none gathers a group in one
task.  Inputs are usually small aggregates, but the box-plot statistics (P5)
and the histogram (P4) read per-session rows and are written for any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokentally.functions.columns import level_rank, weekday_rank
from tokentally.session import ensure_checkpoint_dir

HOURS = list(range(24))
LOG_BINS = 30
WHISKER = 1.5


def heatmap_pivot(heatmap: DataFrame) -> DataFrame:
    """Weekday rows x 24 hour columns of session counts, 0 where missing,
    Monday first, only weekdays present.  Pivot values are fixed (0-23), so
    Spark needs no extra pass to find them."""
    wide = (heatmap.groupBy("day_of_week").pivot("hour", HOURS)
                   .agg(F.sum("session_count")))
    wide = wide.na.fill(0, [str(h) for h in HOURS])
    return wide.withColumn("day_rank", weekday_rank("day_of_week")).orderBy("day_rank")


def weekday_sorted(day_counts: DataFrame) -> DataFrame:
    """Weekday rows in calendar order (Monday = 0)."""
    return day_counts.withColumn("day_rank", weekday_rank("day_of_week")).orderBy("day_rank")


def accept_reject_long(accept_reject: DataFrame) -> DataFrame:
    """Wide accept/reject counts -> (tool_name, decision, count)."""
    return accept_reject.unpivot(["tool_name"], ["accept_count", "reject_count"], "decision", "count")


def log_histogram(values: DataFrame, col: str, bins: int = LOG_BINS) -> DataFrame:
    """Histogram on ``bins`` log-spaced bins from min to max of the positive
    values; the last bin is closed; empty bins are kept with count 0.

    Columns: bin, bin_lo, bin_hi, bin_center (geometric mean), count.  With a
    single distinct value there is one bin; with no positive value, no rows.
    The bounds are scalar subqueries (one small aggregate, no driver round trip,
    no join); counting is a partial aggregate on at most ``bins`` keys.
    """
    pos = values.select(F.col(col).cast("double").alias("v")).where(F.col("v") > 0)
    # one subquery (Spark reuses it for every reference)
    bounds = pos.agg(F.struct(F.log10(F.min("v")).alias("a"), F.log10(F.max("v")).alias("b"))).scalar()
    a, b = bounds["a"], bounds["b"]
    n = F.when(b > a, F.lit(bins)).otherwise(F.lit(1))
    w = F.when(b > a, (b - a) / F.lit(bins)).otherwise(F.lit(0.0))
    idx = F.when(w > 0, F.least(n - 1, F.floor((F.log10("v") - a) / w).cast("int"))).otherwise(F.lit(0))
    counts = pos.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")) \
                  .where(a.isNotNull() & (F.col("bin") < n))
    lo = F.pow(F.lit(10.0), a + F.col("bin") * w)
    hi = F.when(F.col("bin") == n - 1, F.pow(F.lit(10.0), b)) \
          .otherwise(F.pow(F.lit(10.0), a + (F.col("bin") + 1) * w))
    return (edges.join(counts, "bin", "left")
                 .select("bin", lo.alias("bin_lo"), hi.alias("bin_hi"),
                         F.sqrt(lo * hi).alias("bin_center"),
                         F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"))
                 .orderBy("bin"))


def _ranked(df: DataFrame, group: str, value: str) -> DataFrame:
    """(g, v, pid, rid): the rows globally sorted on (group, value), checkpointed.

    Range partitioning samples the keys, so a group holding a third of all rows
    is split over many tasks; ``tb`` breaks ties so that rows sharing one
    (group, value) spread too.  The result is written once to the shared
    checkpoint folder: every later pass sees the same partitions, and retries
    do not redo the sort.
    """
    d = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"),
                  F.monotonically_increasing_id().alias("tb")) \
          .where(F.col("v").isNotNull())
    ensure_checkpoint_dir(df.sparkSession)
    return d.orderBy("g", "v", "tb").select(
        "g", "v", F.spark_partition_id().alias("pid"),
        F.monotonically_increasing_id().alias("rid")).checkpoint(eager=True)


def _quantiles(ranked: DataFrame, probs: tuple[float, ...]) -> DataFrame:
    """Quantiles from ranked rows: per (partition, group) row counts and first row
    ids (a small table) give each row its rank; only rows at wanted ranks remain."""
    blocks = ranked.groupBy("g", "pid").agg(F.count(F.lit(1)).alias("cnt"), F.min("rid").alias("rid0"))
    w = Window.partitionBy("g").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("g", "pid", "rid0",
                           F.coalesce(F.sum("cnt").over(w), F.lit(0)).alias("before"),
                           F.sum("cnt").over(Window.partitionBy("g")).alias("n"))
    pos = ranked.join(blocks, ["g", "pid"]).select(
        "g", "v", "n", (F.col("before") + F.col("rid") - F.col("rid0")).alias("rank"))
    targets = []
    for p in probs:
        h = (F.col("n") - 1) * F.lit(float(p))
        targets.append(F.struct(F.lit(float(p)).alias("p"), F.floor(h).alias("lo"),
                                F.ceil(h).alias("hi"), h.alias("h")))
    wanted = pos.select("g", "v", "n", "rank", F.explode(F.array(*targets)).alias("t")) \
                .where((F.col("rank") == F.col("t.lo")) | (F.col("rank") == F.col("t.hi")))
    per = wanted.groupBy("g", "n", F.col("t.p").alias("p"), F.col("t.h").alias("h"),
                         F.col("t.lo").alias("lo")) \
                .agg(F.min("v").alias("v_lo"), F.max("v").alias("v_hi"))
    q = per.select("g", "n", "p",
                   (F.col("v_lo") + (F.col("h") - F.col("lo")) * (F.col("v_hi") - F.col("v_lo"))).alias("q"))
    out = q.groupBy("g", "n").pivot("p", [float(p) for p in probs]).agg(F.first("q"))
    return out.select("g", "n", *[F.col(f"`{float(p)}`").alias(_qname(p)) for p in probs])


def _qname(p: float) -> str:
    return f"q{round(p * 100):d}"


def exact_quantiles(df: DataFrame, group: str, value: str,
                    probs: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Exact linear-interpolation quantiles per group without gathering a group.
    Columns: group, n, q<p*100> for each p (e.g. q25, q50, q75)."""
    q = _quantiles(_ranked(df, group, value), probs)
    return q.withColumnRenamed("g", group)


GROUP_BROADCAST_MAX = 1_000_000


def box_stats(df: DataFrame, group: str, value: str, whisker: float = WHISKER) -> DataFrame:
    """P5: per group n, min, q1, median, q3, max, whisker ends (most extreme values
    within ``whisker`` x IQR of the quartiles) and outlier count.

    The input is sorted and checkpointed once; quartiles and the whisker pass
    both read that copy.  The per-group fences (one row per group) are
    broadcast only after counting them under ``GROUP_BROADCAST_MAX``.
    """
    ranked = _ranked(df, group, value)
    q = _quantiles(ranked, (0.25, 0.5, 0.75))
    fences = q.select("g", "n", "q25", "q50", "q75",
                      (F.col("q25") - whisker * (F.col("q75") - F.col("q25"))).alias("lf"),
                      (F.col("q75") + whisker * (F.col("q75") - F.col("q25"))).alias("uf")) \
              .checkpoint(eager=True)
    side = F.broadcast(fences) if fences.count() <= GROUP_BROADCAST_MAX else fences
    agg = ranked.select("g", "v").join(side.select("g", "lf", "uf"), "g").groupBy("g").agg(
        F.min("v").alias("min"), F.max("v").alias("max"),
        F.min(F.when(F.col("v") >= F.col("lf"), F.col("v"))).alias("whisker_low"),
        F.max(F.when(F.col("v") <= F.col("uf"), F.col("v"))).alias("whisker_high"),
        F.count_if((F.col("v") < F.col("lf")) | (F.col("v") > F.col("uf"))).alias("outliers"))
    return fences.join(agg, "g").select(
        F.col("g").alias(group), "n", "min", F.col("q25").alias("q1"), F.col("q50").alias("median"),
        F.col("q75").alias("q3"), "max", "whisker_low", "whisker_high", "outliers")


def status_code_order(errors: DataFrame, col: str = "status_code") -> DataFrame:
    """All-digit codes numerically first, mixed codes next by their digits,
    'unknown' (any case) last.  Adds the sort keys and orders by them."""
    c = F.col(col).cast("string")
    digits = F.regexp_replace(c, r"\D", "")
    klass = (F.when(c.rlike(r"^[0-9]+$"), F.lit(0))
              .when(F.lower(c) == "unknown", F.lit(2)).otherwise(F.lit(1)))
    number = F.when(klass == 2, F.lit(0)).otherwise(F.coalesce(digits.try_cast("bigint"), F.lit(0)))
    return (errors.withColumn("code_class", klass).withColumn("code_number", number)
                  .orderBy("code_class", "code_number", col))


def level_sorted(df: DataFrame, col: str = "level") -> DataFrame:
    """L1 ... L10 in numeric order."""
    return df.orderBy(level_rank(col), col)


def with_share(df: DataFrame, value: str, share_col: str = "share") -> DataFrame:
    """Value / total of value (pie shares) of a query result with one row per
    category.  The total is a window over those few rows, so the facts are read once."""
    total = F.sum(F.col(value)).over(Window.partitionBy()).cast("double")
    return df.withColumn(share_col, F.try_divide(F.col(value).cast("double"), total))


def normalize_series(df: DataFrame, numeric: list[str], ds: str = "ds") -> DataFrame:
    """Coerce ``ds`` to DATE and ``numeric`` to DOUBLE, drop rows with an
    unusable date or number, order by date."""
    cols = [F.col(c) for c in df.columns if c not in numeric and c != ds]
    return (df.select(F.col(ds).cast("string").try_cast("date").alias(ds),
                      *[F.col(c).cast("string").try_cast("double").alias(c) for c in numeric], *cols)
              .dropna(subset=[ds, *numeric])
              .orderBy(ds))

