"""

``queries()`` maps a stable ID (SURVEY section 2) to ``(spark, sf_dir) -> DataFrame``.
Every query reads the driver's parquet tables through the mapping in
``tokentally.sources.driver_tables`` and runs over the whole tables.
``oracle_sql()`` gives independent DuckDB SQL over the same parquet views
(the training-data queries only where SQL can express them).
DOUBLE results are rounded on both sides the same way -- shortest decimal text,
12 places, then 6 (cents for forecast money values) -- because summation order differs between
engines in the last bits.
"""

from __future__ import annotations

import datetime as _dt
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentally.functions.columns import event_day, level_rank
from tokentally.operators import forecast as FC
from tokentally.operators.filters import Domains, Filters, invalid_values
from tokentally.operators.reshape import level_sorted, normalize_series
from tokentally.plans import catalog
from tokentally.plans import forecasts as FP
from tokentally.plans import oracle as O
from tokentally.plans.reshaped import RESHAPED
from tokentally.session import scratch_path
from tokentally.sources import driver_tables as D
from tokentally.sources import export as X
from tokentally.sources import generations as G
from tokentally.sources import ingest as I
from tokentally.sources.driver_tables import driver_tables
from tokentally.sources.schemas import FACT_SCHEMAS
from tokentally.sources.tables import Tables
from tokentally.streaming import ingest_stream as S

# The training-data operators (subpackage llm) and their pipeline are optional: without them, or without a library
# that they need, the analytics queries stay.
try:
    import corpus_pipeline
    from tokentally.llm import queries as LLM
except ImportError as missing:
    logging.getLogger(__name__).warning("training-data queries left out: %s", missing)
    corpus_pipeline = LLM = None

SMOKE_DIR = "/root/testdata/sf0.001"

# Registered queries cover the whole driver data: no date bounds, no lists.
FULL: dict = {}
# Filter features: a window that cuts weekly sessions (K3) and the three list filters.
WINDOW = dict(date_start=_dt.date(2024, 1, 5), date_end=_dt.date(2024, 1, 20))
LISTS = dict(practices=("AUTOMOBILE", "BUILDING", "MACHINERY"),
             levels=("L1", "L2", "L5", "L9", "L10"),
             locations=("AMERICA", "ASIA", "EUROPE"))

ROUND = {
    "q1_kpi_metrics": ["total_cost", "error_rate"],
    "q3_session_kpis": ["avg_duration_mins", "avg_prompts_per_session"],
    "q4_cache_savings": ["cache_savings_usd"],
    "q5_cost_by_practice_over_time": ["total_cost"],
    "q6_cost_by_level_over_time": ["total_cost"],
    "q8_avg_cost_per_session_over_time": ["avg_cost_per_session"],
    "q9_daily_cost_totals": ["y"],
    "q10_model_distribution": ["total_cost"],
    "q11_cache_hit_rate": ["cache_hit_rate"],
    "q12_usage_by_practice": ["total_cost"],
    "q14_top_engineers": ["total_cost", "avg_cost_per_session"],
    "q21_tool_success_rate": ["success_rate"],
    "q22_tool_execution_time": ["avg_duration_ms"],
    "q23_session_duration_hist": ["duration_mins"],
    "q24_session_cost_by_practice": ["total_cost"],
    "q25_api_latency_by_model": ["avg_duration_ms"],
    "q27_level_cost_correlation": ["avg_cost_per_session"],
}

# (registered id, base query id, filter arguments)
FILTERED = [
    ("d1_window_usage_by_practice", "q12_usage_by_practice", WINDOW),
    ("d1_window_avg_cost_per_session", "q8_avg_cost_per_session_over_time", WINDOW),
    ("d4_lists_cost_by_practice", "q5_cost_by_practice_over_time", {**FULL, **LISTS}),
    ("d4_lists_window_top_engineers", "q14_top_engineers", {**WINDOW, **LISTS}),
    ("d4_lists_kpi_metrics", "q1_kpi_metrics", {**WINDOW, **LISTS}),
]


def round_doubles(df: DataFrame, digits: int = 6, per_col: dict | None = None) -> DataFrame:
    """Round DOUBLE columns in two decimal steps (12 places, then ``digits``).

    A value that is no finite decimal(38,12) raises (ANSI cast) instead of turning NULL.
    The first step absorbs last-bit noise of summation order, so values that sit
    exactly on a rounding tie (averages of cent amounts) round the same way in
    every engine; the oracle SQL does the same.
    """
    per_col = per_col or {}
    return df.select(*[
        F.round(F.col(f.name).cast("decimal(38,12)"), per_col.get(f.name, digits)).cast("double").alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


def _filters(args: dict) -> Filters:
    # Driver domains (market segments, regions) differ from the reference's fixed
    # lists, so validation against the fixed domains is off here.
    return Filters(**args, domains=None)


def _analytics(query_id: str, args: dict) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = driver_tables(spark, sf_dir)
        return round_doubles(catalog.run(query_id, tables, _filters(args)))
    run.__name__ = query_id
    return run


ROUND.update({
    "p4_log_histogram": ["bin_lo", "bin_hi", "bin_center"],
    "p5_box_stats": ["min", "q1", "median", "q3", "max", "whisker_low", "whisker_high"],
    "p8_model_share": ["total_cost", "share"],
    "p8_business_hours_share": ["share"],
    "p9_normalize_series": ["y"],
})


def _reshaped(rid: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(RESHAPED[rid](driver_tables(spark, sf_dir), _filters(FULL)))
    run.__name__ = rid
    return run


F1_RANGE = dict(date_start=_dt.date(2023, 12, 28), date_end=_dt.date(2024, 2, 10))
# Forecast values are money totals (up to millions at larger scales): cents.
# Ratios (MAPE, coverage) keep 6 decimals; F1's sums of cent-based costs keep 4.
_MONEY = ("yhat", "yhat_lower", "yhat_upper", "actual_cost", "expected_cost", "residual", "mae")
FORECAST_ROUND = {
    "f1_normalize_daily": {"y": 4},
    "f1_nan_totals": {"y": 2},
    "f6_summary_anomalies": {c: 2 for c in _MONEY[3:6]},
    "f6_summary_metrics": {"mae": 2, "mape": 6, "coverage": 6},
    "f2_fit_predict": {c: 2 for c in _MONEY[:3]},
    "f3_anomalies": {c: 2 for c in _MONEY[3:6]},
    "f4_backtest": {"mae": 2, "mape": 6, "coverage": 6},
    "f6_forecast_future": {c: 2 for c in _MONEY[:3]},
    "f6_daily_cost_forecast": {c: 2 for c in _MONEY[:3]},
    "f4_steep_trend": {"mae": 2, "mape": 6, "coverage": 6},
    "f4_shifted_series": {"mae": 2, "mape": 6, "coverage": 6},
    "f2_conformal_forecast": {c: 2 for c in _MONEY[:3]},
    "f4_conformal_coverage": {"coverage": 6},
}


def _f1(spark, sf_dir):
    s = FP.practice_daily_cost(driver_tables(spark, sf_dir), _filters(FULL))
    return round_doubles(FC.normalize_daily(s, ["practice"], **F1_RANGE), per_col=FORECAST_ROUND["f1_normalize_daily"])


def _f2(spark, sf_dir):
    return round_doubles(FC.fit_predict(FP.orders_daily(spark, sf_dir), ["priority"]), per_col=FORECAST_ROUND["f2_fit_predict"])


def _f3(spark, sf_dir):
    h = FP.orders_daily(spark, sf_dir)
    fitted = FC.fit_predict(h, ["priority"]).join(h, ["priority", "ds"])
    return round_doubles(FC.detect_anomalies(fitted, ["priority"]), per_col=FORECAST_ROUND["f3_anomalies"])


def _f4(spark, sf_dir):
    return round_doubles(FC.backtest(FP.orders_daily(spark, sf_dir), ["priority"]), per_col=FORECAST_ROUND["f4_backtest"])


def _f4_steep(spark, sf_dir):
    """F4 where totals of about one grow by 0 to ten million a day."""
    return round_doubles(FC.backtest(FP.steep_series(spark, sf_dir), ["priority"]), per_col=FORECAST_ROUND["f4_steep_trend"])


def _f4_shifted(spark, sf_dir):
    """F4 where totals of about one lie on a level of a hundred million."""
    h = FP.steep_series(spark, sf_dir, slopes=[0.0] * 5, level=1e8)
    return round_doubles(FC.backtest(h, ["priority"]), per_col=FORECAST_ROUND["f4_shifted_series"])


def _f2_conformal(spark, sf_dir):
    return round_doubles(FC.conformal_forecast(FP.orders_daily(spark, sf_dir), ["priority"]), per_col=FORECAST_ROUND["f2_conformal_forecast"])


def _f4_conformal(spark, sf_dir):
    return round_doubles(FC.conformal_coverage(FP.orders_daily(spark, sf_dir), ["priority"]), per_col=FORECAST_ROUND["f4_conformal_coverage"])


def _f6_status(spark, sf_dir):
    s = FP.practice_daily_cost(driver_tables(spark, sf_dir), _filters(FULL))
    return FC.forecast_summary(s, ["practice"]).status


def _f6_future(spark, sf_dir):
    s = FP.practice_daily_cost(driver_tables(spark, sf_dir), _filters(FULL))
    return round_doubles(FC.forecast_summary(s, ["practice"]).forecast, per_col=FORECAST_ROUND["f6_forecast_future"])


def _f6_daily_status(spark, sf_dir):
    return FP.daily_cost_forecast(driver_tables(spark, sf_dir), _filters(FULL)).status


def _f6_daily_forecast(spark, sf_dir):
    return round_doubles(FP.daily_cost_forecast(driver_tables(spark, sf_dir), _filters(FULL)).forecast, per_col=FORECAST_ROUND["f6_daily_cost_forecast"])


def _f1_nan(spark, sf_dir):
    """F1 where every 11th order total is NaN: it counts as missing, not as a NaN day."""
    o = FP.orders_raw(spark, sf_dir, nan_rule=(11, 3))
    return round_doubles(FC.normalize_daily(o, ["priority"]), per_col=FORECAST_ROUND["f1_nan_totals"])


def _f6_orders(output: str, key: str):
    def run(spark, sf_dir):
        out = getattr(FC.forecast_summary(FP.orders_raw(spark, sf_dir), ["priority"]), output)
        return round_doubles(out, per_col=FORECAST_ROUND[key])
    return run


FORECAST = {
    "f1_nan_totals": _f1_nan,
    "f6_summary_anomalies": _f6_orders("anomalies", "f3_anomalies"),
    "f6_summary_metrics": _f6_orders("metrics", "f4_backtest"),
    "f1_normalize_daily": _f1,
    "f2_fit_predict": _f2,
    "f3_anomalies": _f3,
    "f4_backtest": _f4,
    "f6_forecast_status": _f6_status,
    "f6_forecast_future": _f6_future,
    "f6_daily_cost_status": _f6_daily_status,
    "f6_daily_cost_forecast": _f6_daily_forecast,
    "f4_steep_trend": _f4_steep,
    "f4_shifted_series": _f4_shifted,
    "f2_conformal_forecast": _f2_conformal,
    "f4_conformal_coverage": _f4_conformal,
}


def _ingest_table(table: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return D.ingest_roundtrip(spark, sf_dir).tables.fact(table)
    return run


def _ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.ingest_roundtrip(spark, sf_dir).counts


def _reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rej = D.ingest_roundtrip(spark, sf_dir).rejects
    return rej.groupBy("reason").agg(F.count(F.lit(1)).alias("count"))


def _pack_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S20 output parsed back: per batch its size, first/last event and date parts."""
    lines = D.pack_batches(D.telemetry_events(D.read_driver(spark, sf_dir, "events")),
                           "batch_id", "event_id", id_col="event_id", epoch_ms_col="epoch_ms")
    return _parsed_batches(lines, "batch_id")


def _cut_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S20 over the events in time order, batches of 1 to 10 cut along the stream, parsed back."""
    events = D.telemetry_events(D.read_driver(spark, sf_dir, "events"))
    return _parsed_batches(X.cut_batches(events, ["epoch_ms", "event_id"], id_col="event_id", epoch_ms_col="epoch_ms"), "batch_no")


def _parsed_batches(lines: DataFrame, key: str) -> DataFrame:
    schema = "logEvents array<struct<id string, timestamp bigint, message string>>, " \
             "year int, month int, day int"
    b = lines.select(key, F.from_json("value", schema).alias("b"))
    ids = F.transform("b.logEvents", lambda x: x["id"].cast("bigint"))
    return b.select(key, F.size("b.logEvents").cast("bigint").alias("n_events"),
                    F.array_min(ids).alias("first_event_id"), F.array_max(ids).alias("last_event_id"),
                    "b.year", "b.month", "b.day")


def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose message has no body or no attributes, in every way a producer can leave them out."""
    found = I.classify_lines(D.envelope_lines(D.read_driver(spark, sf_dir, "events")))
    no_envelope = F.coalesce(F.col("detail") == I.MSG_NO_ENVELOPE, F.lit(False)).alias("no_envelope")
    return found.groupBy("status", no_envelope).agg(F.count(F.lit(1)).alias("count"))


def _configured_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5 through the dict form: a company's own practices, levels and locations are the valid ones."""
    own = Domains(practices=LISTS["practices"], levels=LISTS["levels"], locations=LISTS["locations"])
    asked = {**WINDOW, "practices": ["BUILDING"], "locations": ["ASIA", "EUROPE"]}
    return round_doubles(catalog.run("q12_usage_by_practice", driver_tables(spark, sf_dir), asked, own))


def _stream_ingest(spark: SparkSession, sf_dir: str, again: bool = False, within: str | None = None) -> str:
    """JSONL files -> streaming ingest (several micro-batches) -> the folder of its tables.

    ``again`` delivers every third line a second time, in later files.
    """
    src = scratch_path(spark, "stream-src")
    lines = D.telemetry_lines(D.read_driver(spark, sf_dir, "events"))
    X.write_lines(lines, f"{src}/feed=1")
    if again:
        X.write_lines(lines.where("batch_id % 3 = 1"), f"{src}/feed=2")
    out, ck = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ck")
    S.start_ingest_stream(spark, f"{src}/*", out, ck, max_files_per_trigger=2, dedupe_within=within).awaitTermination()
    return out


def _e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read_stream_table(spark, _stream_ingest(spark, sf_dir), "api_requests")


def _e1_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 with lines delivered twice, each counted once."""
    return S.read_stream_table(spark, _stream_ingest(spark, sf_dir, again=True, within="1 day"), "api_requests")


def _directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.employees_view(*[D.read_driver(spark, sf_dir, t) for t in ("customer", "nation", "region")])


def _e2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watermarked daily cost per practice over the streamed requests."""
    out = _stream_ingest(spark, sf_dir)
    res, ck = scratch_path(spark, "daily-cost"), scratch_path(spark, "daily-cost-ck")
    S.start_daily_cost_stream(spark, f"{out}/api_requests", _directory(spark, sf_dir), res, ck).awaitTermination()
    return round_doubles(spark.read.parquet(res))


def _e2_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2 in upserting form: every day and practice, whichever micro-batch its requests came in."""
    out = _stream_ingest(spark, sf_dir)
    res, ck = scratch_path(spark, "daily-upserts"), scratch_path(spark, "daily-upserts-ck")
    S.start_daily_cost_upserts(spark, f"{out}/api_requests", _directory(spark, sf_dir), res, ck, max_files_per_trigger=40).awaitTermination()
    return round_doubles(S.read_daily_cost(spark, res).drop("corrections"))


def _csv_quoting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S21 then S2 with quotes, commas and line breaks in every name."""
    name = F.concat(F.lit('Ann "Bo", '), F.col("full_name"), F.lit("\nJr. \"X\""))
    return D.employees_csv_roundtrip(spark, sf_dir, name)


def _tables_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S16/S17 write, S19 read: rows per table and day, and rows under a wrong day."""
    path = scratch_path(spark, "curated")
    D.driver_tables(spark, sf_dir).write_parquet(path)
    return _rows_by_day(Tables.from_parquet(spark, path))


def _rows_by_day(back: Tables) -> DataFrame:
    out = back.employees.agg(F.lit("employees").alias("table_name"), F.lit(None).cast("date").alias("day"),
                             F.count(F.lit(1)).alias("n_rows"), F.lit(0).cast("bigint").alias("misplaced"))
    for t in FACT_SCHEMAS:
        out = out.unionByName(back.fact(t).groupBy(F.lit(t).alias("table_name"), F.col("event_date").alias("day")).agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_if(event_day("timestamp") != F.col("event_date")).alias("misplaced")))
    return out


def _published_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S16/S19 by generations: a first build without some employees, a whole one, then one that stops
    after three tables. Rows of both published versions; the third is never seen."""
    root, tables = scratch_path(spark, "published"), D.driver_tables(spark, sf_dir)
    G.publish(D.without_employees(tables, (7, 3)), root)
    G.publish(tables, root)
    for write in tables.writers(G.generation_path(root, "stopped"))[:3]:
        write()
    now = _rows_by_day(G.read_published(spark, root)).withColumn("version", F.lit("current"))
    return now.unionByName(_rows_by_day(G.read_published(spark, root, 1)).withColumn("version", F.lit("1")))


def _bad_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Employees with an empty name or no practice go to the rejects, the others stay."""
    emp, n = D.driver_tables(spark, sf_dir).employees, D.employee_number()
    valid, bad = I.split_employees(
        emp.withColumn("full_name", F.when(n % 11 == 4, F.lit(" ")).otherwise(F.col("full_name")))
           .withColumn("practice", F.when(n % 13 != 5, F.col("practice"))))
    return valid.select("email", F.lit("kept").alias("outcome")).unionByName(
        bad.select(F.get_json_object("raw", "$.email").alias("email"), F.col("reason").alias("outcome")))


def _unknown_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 with users missing from the directory: their events drop out."""
    tables = D.without_employees(D.driver_tables(spark, sf_dir), (7, 3))
    return round_doubles(catalog.run("q12_usage_by_practice", tables, _filters(FULL)))


def _invalid_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requested values that the directory does not have."""
    return invalid_values(_filters(dict(practices=("BUILDING", "Alchemy"), levels=("L1", "L11"), locations=("ASIA", "asia"))),
                          D.driver_tables(spark, sf_dir).employees)


def _level_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7 over the session counts per level."""
    counts = catalog.run("q13_usage_by_level", driver_tables(spark, sf_dir), _filters(FULL))
    return level_sorted(counts.withColumn("rank", level_rank("level")))


def _dirty_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9 where some days and numbers are no longer usable text."""
    q = catalog.run("q9_daily_cost_totals", driver_tables(spark, sf_dir), _filters(FULL))
    day = F.dayofmonth("ds")
    raw = q.select(F.when(day % 7 == 3, F.lit("no date")).otherwise(F.col("ds").cast("string")).alias("ds"),
                   F.when(day % 5 == 0, F.lit("x")).otherwise(F.col("y").cast("string")).alias("y"))
    return round_doubles(normalize_series(raw, ["y"]))


# Cases that the clean tables don't show: dirty text, bad directories, unknown users, tables written and read back.
CASES = {
    "d5_configured_domains": _configured_domains,
    "d5_invalid_values": _invalid_values,
    "j1_unknown_users": _unknown_users,
    "p7_level_sorted": _level_sorted,
    "p9_dirty_series": _dirty_series,
    "s16_tables_roundtrip": _tables_roundtrip,
    "s16_published_generations": _published_generations,
    "s18_bad_directory": _bad_directory,
    "s21_employees_csv_quoting": _csv_quoting,
}

INGEST = {
    "e1_stream_ingest_api_requests": (_e1, "api_requests"),
    "e1_stream_dedupe": (_e1_dedupe, "api_requests"),
    "e2_stream_daily_cost": (_e2, "stream_daily_cost"),
    "e2_stream_daily_upserts": (_e2_upserts, "stream_daily_upserts"),
    "s5_envelope_faults": (_envelopes, "envelopes"),
    "s8_ingest_user_prompts": (_ingest_table("user_prompts"), "user_prompts"),
    "s9_ingest_api_requests": (_ingest_table("api_requests"), "api_requests"),
    "s10_ingest_tool_decisions": (_ingest_table("tool_decisions"), "tool_decisions"),
    "s11_ingest_tool_results": (_ingest_table("tool_results"), "tool_results"),
    "s12_ingest_api_errors": (_ingest_table("api_errors"), "api_errors"),
    "s14_ingest_counts": (_ingest_counts, "counts"),
    "s13_reject_counts": (_reject_counts, "reject_counts"),
    "s15_reject_summary": (D.reject_summary_by_part, "reject_summary"),
    "s20_pack_batches": (_pack_batches, "pack"),
    "s20_cut_batches": (_cut_batches, "cut"),
    "s21_employees_csv_roundtrip": (D.employees_csv_roundtrip, "employees"),
}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: Q14 top engineers (fact/dimension join, session-cost roll-up, top-k,
    favourite model) on the sf0.001 tables."""
    return queries()["q14_top_engineers"](spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for qid in catalog.QUERIES:
        out[qid] = _analytics(qid, FULL)
    for rid, qid, args in FILTERED:
        out[rid] = _analytics(qid, args)
    for rid, (fn, _) in INGEST.items():
        out[rid] = fn
    for rid in RESHAPED:
        out[rid] = _reshaped(rid)
    out.update(FORECAST)
    out.update(CASES)
    if LLM is not None:
        out.update(LLM.LLM_QUERIES)
        out["pipeline"] = corpus_pipeline.run
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    full = O.query_sql(O.SqlFilter(**FULL))
    for qid in catalog.QUERIES:
        out[qid] = O.round_cols(full[qid], ROUND.get(qid, []))
    for rid, qid, args in FILTERED:
        sql = O.query_sql(O.SqlFilter(**args))[qid]
        out[rid] = O.round_cols(sql, ROUND.get(qid, []))
    for rid, sql in O.reshape_sql(O.SqlFilter(**FULL)).items():
        out[rid] = O.round_cols(sql, ROUND.get(rid, []))
    fsql = O.forecast_sql(O.SqlFilter(**FULL), 1.2816, 14, F1_RANGE["date_start"], F1_RANGE["date_end"])
    for rid, sql in fsql.items():
        out[rid] = O.round_cols(sql, FORECAST_ROUND.get(rid, {}))
    ing = O.ingest_sql()
    for rid, (_, key) in INGEST.items():
        out[rid] = ing[key]
    out.update(O.case_sql())
    if LLM is not None:
        out.update(LLM.LLM_SQL)
        if corpus_pipeline.ORACLE_SQL is not None:
            out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
