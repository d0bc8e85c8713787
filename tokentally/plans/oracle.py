"""Independent DuckDB SQL for every registered query (the correctness oracle).

The driver registers its parquet tables as views; ``MAPPING_CTES`` derives the
six curated tables from them exactly as ``sources.driver_tables`` does in Spark.
Queries affected by the prompt fan-out (K1) are written here the direct way
(one joined row per prompt), which checks the pre-aggregated Spark plans.
"""

from __future__ import annotations

import datetime as _dt

MAPPING_CTES = """
employees AS (
  SELECT 'user' || CAST(c.c_custkey AS VARCHAR) || '@example.com' AS email,
         c.c_name AS full_name, c.c_mktsegment AS practice,
         'L' || CAST(1 + c.c_custkey % 10 AS VARCHAR) AS level, r.r_name AS location
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey),
ev AS (
  SELECT event_id, event_type, value, user_id, ts AS "timestamp",
         TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(user_id AS VARCHAR) || '-w' ||
           CAST(CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) AS BIGINT) AS VARCHAR)
           AS session_id,
         'user' || CAST(user_id AS VARCHAR) || '@example.com' AS user_email,
         'term-' || CAST(user_id % 4 AS VARCHAR) AS terminal_type
  FROM events),
__EV_OK__user_prompts AS (
  SELECT session_id, user_email, "timestamp", CAST(k * 10 AS INTEGER) AS prompt_length, terminal_type
  FROM ev WHERE event_type = 'signup'),
api_requests AS (
  SELECT session_id, user_email, "timestamp", 'model-' || CAST(event_id % 5 AS VARCHAR) AS model,
         CAST(k * 10 AS INTEGER) AS input_tokens, CAST(event_id % 500 AS INTEGER) AS output_tokens,
         CAST((event_id * 37) % 5000 AS INTEGER) AS cache_read_tokens,
         CAST((k % 7) * 100 AS INTEGER) AS cache_creation_tokens,
         value / 100 AS cost_usd, CAST(k * 100 AS INTEGER) AS duration_ms, terminal_type
  FROM ev WHERE event_type = 'purchase'),
tool_decisions AS (
  SELECT session_id, user_email, "timestamp", 'tool-' || CAST(event_id % 7 AS VARCHAR) AS tool_name,
         CASE WHEN event_id % 10 = 0 THEN 'reject' ELSE 'accept' END AS decision,
         CASE WHEN event_id % 10 = 0 THEN 'user_reject' ELSE 'config' END AS source, terminal_type
  FROM ev WHERE event_type = 'click'),
tool_results AS (
  SELECT session_id, user_email, "timestamp", 'tool-' || CAST(event_id % 7 AS VARCHAR) AS tool_name,
         CASE WHEN event_id % 10 = 0 THEN 'reject' ELSE 'accept' END AS decision_type,
         CASE WHEN event_id % 10 = 0 THEN 'user_reject' ELSE 'config' END AS decision_source,
         (k % 9 <> 0) AS success, CAST(k * 100 AS INTEGER) AS duration_ms,
         CASE WHEN event_id % 3 = 0 THEN CAST(k * 64 AS INTEGER) END AS result_size_bytes, terminal_type
  FROM ev WHERE event_type = 'view'),
api_errors AS (
  SELECT session_id, user_email, "timestamp", 'model-' || CAST(event_id % 5 AS VARCHAR) AS model,
         'error-' || sc AS error, sc AS status_code,
         CAST(1 + event_id % 3 AS INTEGER) AS attempt, CAST(k * 100 AS INTEGER) AS duration_ms, terminal_type
  FROM (SELECT *, CASE event_id % 5 WHEN 0 THEN '400' WHEN 1 THEN '401' WHEN 2 THEN '429'
                  WHEN 3 THEN '500' ELSE 'undefined' END AS sc FROM ev)
  WHERE event_type = 'error'),
sc AS (SELECT session_id, SUM(cost_usd) AS total_cost FROM api_requests GROUP BY session_id)
"""


# Fault rules of ``sources.driver_tables.telemetry_events`` (ingest round trip).
INGEST_FAULTS = dict(
    bad_line="(event_id // 7) % 61 = 3",
    bad_message="event_id % 83 = 5",
    unknown_body="event_id % 97 = 11",
    drop_field="event_id % 89 = 7",
    bad_int="(event_type = 'purchase' AND event_id % 79 = 3)",
)
_F = INGEST_FAULTS
INGESTED_EVENTS = (f"NOT ({_F['bad_line']}) AND NOT ({_F['bad_message']}) AND NOT ({_F['unknown_body']}) "
                   f"AND NOT ({_F['drop_field']}) AND NOT {_F['bad_int']}")


def mapping_ctes(ingested_only: bool = False) -> str:
    """The six curated tables as CTEs; with ``ingested_only`` the facts keep only
    the events that survive the ingest round trip's faults."""
    if not ingested_only:
        return MAPPING_CTES.replace("__EV_OK__", "")
    text = MAPPING_CTES.replace("__EV_OK__", f"ev_ok AS (SELECT * FROM ev WHERE {INGESTED_EVENTS}),\n")
    return text.replace(" FROM ev WHERE event_type", " FROM ev_ok WHERE event_type") \
               .replace("FROM ev)\n  WHERE event_type", "FROM ev_ok)\n  WHERE event_type")


def ingest_sql() -> dict[str, str]:
    """Oracles for the ingest round trip, computed straight from ``events``."""
    out = {}
    for t, cols in (("user_prompts", None), ("api_requests", None), ("tool_decisions", None),
                    ("tool_results", None), ("api_errors", None)):
        out[t] = f"WITH {mapping_ctes(True).strip()}\nSELECT * FROM {t}"
    f = _F
    live = f"NOT ({f['bad_line']})"
    out["counts"] = f"""
        SELECT (SELECT COUNT(*) FROM events WHERE {INGESTED_EVENTS}) AS ingested,
               (SELECT COUNT(DISTINCT event_id // 7) FROM events WHERE {f['bad_line']}) AS malformed,
               (SELECT COUNT(*) FROM events WHERE {live} AND (({f['bad_message']}) OR
                    (NOT ({f['unknown_body']}) AND (({f['drop_field']}) OR {f['bad_int']})))) AS missing_fields,
               (SELECT COUNT(*) FROM events WHERE {live} AND NOT ({f['bad_message']})
                    AND {f['unknown_body']}) AS unknown_types"""
    out["reject_counts"] = f"""
        SELECT reason, COUNT(*) AS count FROM (
          SELECT CASE WHEN {f['bad_message']} THEN 'missing_fields'
                      WHEN {f['unknown_body']} THEN 'unknown_types'
                      ELSE 'missing_fields' END AS reason
          FROM events WHERE {live} AND NOT ({INGESTED_EVENTS})
          UNION ALL
          SELECT 'malformed' FROM events WHERE {f['bad_line']} GROUP BY event_id // 7)
        GROUP BY reason"""
    out["reject_summary"] = f"""
        WITH b AS (SELECT event_id, event_type, event_id // 7000 AS part,
                          row_number() OVER (PARTITION BY event_id // 7 ORDER BY event_id) - 1 AS idx,
                          dense_rank() OVER (PARTITION BY event_id // 7000 ORDER BY event_id // 7) AS line FROM events),
        r AS (SELECT DISTINCT 'malformed' AS reason, part, line, CAST(NULL AS BIGINT) AS idx FROM b WHERE {f['bad_line']}
              UNION ALL
              SELECT CASE WHEN {f['bad_message']} THEN 'missing_fields' WHEN {f['unknown_body']} THEN 'unknown_types'
                          ELSE 'missing_fields' END, part, line, idx
              FROM b WHERE {live} AND NOT ({INGESTED_EVENTS})),
        t AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY 'part=' || part || '/', line, idx) AS rn FROM r)
        SELECT c.reason, COUNT(t.reason) AS count,
               COALESCE(string_agg('part=' || part || ' Line ' || line || CASE WHEN idx IS NULL THEN '' ELSE ' (event index ' || idx || ')' END,
                                   '; ' ORDER BY rn) FILTER (rn <= 10), '') AS locations
        FROM (VALUES ('malformed'), ('missing_fields'), ('unknown_types')) c(reason) LEFT JOIN t ON t.reason = c.reason GROUP BY 1
        UNION ALL SELECT 'total_skipped', COUNT(*), '' FROM r"""
    out["pack"] = """
        SELECT event_id // 7 AS batch_id, COUNT(*) AS n_events, MIN(event_id) AS first_event_id,
               MAX(event_id) AS last_event_id,
               CAST(year(arg_min(ts, event_id)) AS INTEGER) AS year,
               CAST(month(arg_min(ts, event_id)) AS INTEGER) AS month,
               CAST(day(arg_min(ts, event_id)) AS INTEGER) AS day
        FROM events GROUP BY 1"""
    out["cut"] = """
        WITH e AS (SELECT event_id, ts, row_number() OVER (ORDER BY epoch_ms(ts), event_id) - 1 AS r FROM events),
        j AS (SELECT b, j, (((b * 1000 + j + 42) % 2147483648) * 1103515245 + 12345) % 2147483648 // 65536 % 10 + 1 AS size
              FROM (SELECT DISTINCT r // 1000 AS b FROM e), range(1000) t(j)),
        c AS (SELECT b, j, size, CAST(SUM(size) OVER (PARTITION BY b ORDER BY j) - size AS BIGINT) AS start FROM j)
        SELECT b * 1000 + j AS batch_no, COUNT(*) AS n_events, MIN(event_id) AS first_event_id, MAX(event_id) AS last_event_id,
               CAST(year(arg_min(ts, r)) AS INTEGER) AS year, CAST(month(arg_min(ts, r)) AS INTEGER) AS month,
               CAST(day(arg_min(ts, r)) AS INTEGER) AS day
        FROM e JOIN c ON c.b = e.r // 1000 AND e.r % 1000 >= start AND e.r % 1000 < start + size GROUP BY 1"""
    out["envelopes"] = f"""
        SELECT CASE WHEN event_id % 10 < 5 OR {f['bad_message']} THEN 'missing_fields' WHEN {f['unknown_body']} THEN 'unknown_types'
                    WHEN {f['drop_field']} OR {f['bad_int']} THEN 'missing_fields' ELSE 'ingested' END AS status,
               event_id % 10 < 5 AS no_envelope, COUNT(*) AS count FROM events GROUP BY 1, 2"""
    out["stream_daily_upserts"] = f"""WITH {mapping_ctes(True).strip()}
        SELECT CAST(ar."timestamp" AS DATE) AS date, e.practice,
               CAST(ROUND(TRY_CAST(CAST(SUM(ar.cost_usd) AS VARCHAR) AS DECIMAL(38,12)), 6) AS DOUBLE) AS total_cost, COUNT(*) AS n_requests
        FROM api_requests ar JOIN employees e ON ar.user_email = e.email GROUP BY 1, 2"""
    out["employees"] = f"WITH {mapping_ctes().strip()}\nSELECT * FROM employees"
    # Daily cost per practice over the ingested requests, days closed by a
    # one-day watermark (window end <= last event time - 1 day).
    out["stream_daily_cost"] = f"""WITH {mapping_ctes(True).strip()}
        SELECT CAST(ar."timestamp" AS DATE) AS date, e.practice,
               CAST(ROUND(TRY_CAST(CAST(SUM(ar.cost_usd) AS VARCHAR) AS DECIMAL(38,12)), 6) AS DOUBLE)
                 AS total_cost
        FROM api_requests ar JOIN employees e ON ar.user_email = e.email
        WHERE CAST(CAST(ar."timestamp" AS DATE) AS TIMESTAMP) + INTERVAL 2 DAY
              <= (SELECT MAX("timestamp") FROM api_requests)
        GROUP BY 1, 2"""
    return out


def case_sql() -> dict[str, str]:
    """Oracles of the cases that the clean tables don't show."""
    out = {}
    own = SqlFilter(date_start=_dt.date(2024, 1, 5), date_end=_dt.date(2024, 1, 20), practices=("BUILDING",), locations=("ASIA", "EUROPE"))
    out["d5_configured_domains"] = round_cols(query_sql(own)["q12_usage_by_practice"], ["total_cost"])
    out["d5_invalid_values"] = with_mapping("""
        SELECT field, value FROM (VALUES ('practice', 'BUILDING'), ('practice', 'Alchemy'), ('level', 'L1'), ('level', 'L11'),
                                         ('location', 'ASIA'), ('location', 'asia')) v(field, value)
        WHERE NOT EXISTS (SELECT 1 FROM employees e WHERE v.value = CASE v.field WHEN 'practice' THEN e.practice
                          WHEN 'level' THEN e.level ELSE e.location END)""")
    q = query_bodies(SqlFilter())
    known = mapping_ctes().strip().replace("ON n.n_regionkey = r.r_regionkey)", "ON n.n_regionkey = r.r_regionkey WHERE c.c_custkey % 7 <> 3)")
    out["j1_unknown_users"] = round_cols(f"WITH {known}\n{q['q12_usage_by_practice'][0]}", ["total_cost"])
    out["p7_level_sorted"] = with_mapping(
        f"SELECT level, session_count, CAST(substring(level, 2) AS INTEGER) AS rank FROM ({q['q13_usage_by_level'][0]}) q")
    out["p9_dirty_series"] = round_cols(with_mapping(
        f"SELECT ds, y FROM ({q['q9_daily_cost_totals'][0]}) q WHERE day(ds) % 7 <> 3 AND day(ds) % 5 <> 0"), ["y"])
    facts = " UNION ALL ".join(f"SELECT '{t}', CAST(\"timestamp\" AS DATE), COUNT(*), 0 FROM {t} GROUP BY 2" for t in (
        "user_prompts", "api_requests", "tool_decisions", "tool_results", "api_errors"))
    out["s16_tables_roundtrip"] = with_mapping(
        "SELECT 'employees' AS table_name, CAST(NULL AS DATE) AS day, COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS misplaced "
        f"FROM employees UNION ALL {facts}")
    out["s16_published_generations"] = with_mapping(f"""
        SELECT b.*, v.version FROM (
          SELECT 'employees' AS table_name, CAST(NULL AS DATE) AS day, COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS misplaced FROM employees
          UNION ALL {facts}) b, (VALUES ('current'), ('1')) v(version)
        WHERE v.version = 'current' OR b.table_name <> 'employees'
        UNION ALL SELECT 'employees', NULL, COUNT(*), 0, '1' FROM employees WHERE CAST(regexp_extract(email, '[0-9]+') AS BIGINT) % 7 <> 3""")
    out["s18_bad_directory"] = """
        SELECT 'user' || c_custkey || '@example.com' AS email,
               CASE WHEN c_custkey % 11 = 4 OR c_custkey % 13 = 5 THEN 'constraint' ELSE 'kept' END AS outcome
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
    out["s21_employees_csv_quoting"] = with_mapping(
        "SELECT * REPLACE ('Ann \"Bo\", ' || full_name || chr(10) || 'Jr. \"X\"' AS full_name) FROM employees")
    return out


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


class SqlFilter:
    """The WHERE clause of one filter, for a fact alias joined to ``employees e``."""

    def __init__(self, date_start=None, date_end=None, practices=(), levels=(), locations=()):
        self.date_start, self.date_end = date_start, date_end
        self.lists = (("practice", practices), ("level", levels), ("location", locations))

    @classmethod
    def of(cls, f) -> "SqlFilter":
        return cls(f.date_start, f.date_end, f.practices, f.levels, f.locations)

    def fact(self, table: str, alias: str) -> str:
        day = f'CAST({alias}."timestamp" AS DATE)'
        conds = ["TRUE"] + [f"{day} {op} DATE '{d}'" for op, d in ((">=", self.date_start), ("<=", self.date_end)) if d]
        for col, vals in self.lists:
            if vals:
                conds.append(f"e.{col} IN ({', '.join(_q(v) for v in vals)})")
        return (f"{table} {alias} JOIN employees e ON {alias}.user_email = e.email "
                f"WHERE {' AND '.join(conds)}")


def with_mapping(body: str, extra_ctes: str = "") -> str:
    ctes = mapping_ctes().strip() + ((",\n" + extra_ctes.strip()) if extra_ctes else "")
    return f"WITH {ctes}\n{body}"


def round_cols(sql: str, cols, digits: int = 6) -> str:
    """Round columns (a list, or a dict column -> decimals) like ``round_doubles``."""
    if not cols:
        return sql
    per = cols if isinstance(cols, dict) else {c: digits for c in cols}
    # Via the shortest decimal text of the double, as Spark converts DOUBLE to DECIMAL.
    rep = ", ".join(f"CAST(ROUND(TRY_CAST(CAST({c} AS VARCHAR) AS DECIMAL(38,12)), {d}) AS DOUBLE) AS {c}"
                    for c, d in per.items())
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS _r"


def query_sql(f: SqlFilter) -> dict[str, str]:
    return {k: with_mapping(*v) for k, v in query_bodies(f).items()}


def query_bodies(f: SqlFilter) -> dict[str, tuple[str, str]]:
    ar, up, td = f.fact("api_requests", "ar"), f.fact("user_prompts", "up"), f.fact("tool_decisions", "td")
    tr, ae = f.fact("tool_results", "tr"), f.fact("api_errors", "ae")
    # user_prompts joined to employees and to the lifetime session cost (one row per prompt)
    up_sc = (f"user_prompts up JOIN employees e ON up.user_email = e.email "
             f"LEFT JOIN sc ON up.session_id = sc.session_id WHERE "
             + f.fact("user_prompts", "up").split(" WHERE ", 1)[1])
    minutes = "CAST(date_diff('microsecond', MIN({a}.\"timestamp\"), MAX({a}.\"timestamp\")) AS DOUBLE) / 60000000.0"
    q = {}
    q["q1_kpi_metrics"] = f"""
        SELECT COUNT(DISTINCT ar.session_id) AS total_sessions,
               COUNT(DISTINCT ar.user_email) AS active_engineers,
               COALESCE(SUM(ar.cost_usd), 0.0) AS total_cost,
               CASE WHEN COUNT(*) > 0
                    THEN CAST((SELECT COUNT(*) FROM {ae}) AS DOUBLE) / COUNT(*) ELSE 0.0 END AS error_rate
        FROM {ar}"""
    q["q2_daily_sessions"] = f"""
        SELECT CAST(up."timestamp" AS DATE) AS date, COUNT(DISTINCT up.session_id) AS session_count
        FROM {up} GROUP BY 1"""
    q["q3_session_kpis"] = f"""
        SELECT COALESCE((SELECT AVG(d) FROM (SELECT {minutes.format(a='ar')} AS d FROM {ar}
                                              GROUP BY ar.session_id)), 0.0) AS avg_duration_mins,
               COALESCE((SELECT CAST(COUNT(*) AS DOUBLE) / NULLIF(COUNT(DISTINCT up.session_id), 0)
                         FROM {up}), 0.0) AS avg_prompts_per_session"""
    q["q4_cache_savings"] = f"""
        SELECT CAST(COALESCE(SUM(ar.cache_read_tokens), 0) AS DOUBLE) * ((3.00 - 0.30) / 1000000)
               AS cache_savings_usd FROM {ar}"""
    q["q5_cost_by_practice_over_time"] = f"""
        SELECT CAST(ar."timestamp" AS DATE) AS date, e.practice, SUM(ar.cost_usd) AS total_cost
        FROM {ar} GROUP BY 1, 2"""
    q["q6_cost_by_level_over_time"] = f"""
        SELECT CAST(ar."timestamp" AS DATE) AS date, e.level, SUM(ar.cost_usd) AS total_cost
        FROM {ar} GROUP BY 1, 2"""
    q["q7_token_breakdown"] = (f"""
        SELECT 'Input' AS token_type, i AS total FROM tok
        UNION ALL SELECT 'Output', o FROM tok
        UNION ALL SELECT 'Cache Read', r FROM tok
        UNION ALL SELECT 'Cache Creation', c FROM tok""", f"""
        tok AS (SELECT CAST(COALESCE(SUM(ar.input_tokens), 0) AS BIGINT) AS i,
                       CAST(COALESCE(SUM(ar.output_tokens), 0) AS BIGINT) AS o,
                       CAST(COALESCE(SUM(ar.cache_read_tokens), 0) AS BIGINT) AS r,
                       CAST(COALESCE(SUM(ar.cache_creation_tokens), 0) AS BIGINT) AS c FROM {ar})""")
    q["q8_avg_cost_per_session_over_time"] = f"""
        SELECT CAST(up."timestamp" AS DATE) AS date,
               SUM(COALESCE(sc.total_cost, 0.0)) / COUNT(DISTINCT up.session_id) AS avg_cost_per_session
        FROM {up_sc} GROUP BY 1"""
    q["q9_daily_cost_totals"] = f"""
        SELECT CAST(ar."timestamp" AS DATE) AS ds, COALESCE(SUM(ar.cost_usd), 0.0) AS y
        FROM {ar} GROUP BY 1"""
    q["q10_model_distribution"] = f"""
        SELECT ar.model, COUNT(*) AS call_count, SUM(ar.cost_usd) AS total_cost FROM {ar} GROUP BY 1"""
    q["q11_cache_hit_rate"] = f"""
        SELECT CASE WHEN COALESCE(SUM(CAST(ar.input_tokens AS BIGINT) + ar.cache_read_tokens
                                      + ar.cache_creation_tokens), 0) = 0 THEN 0.0
                    ELSE CAST(SUM(ar.cache_read_tokens) AS DOUBLE)
                         / CAST(SUM(CAST(ar.input_tokens AS BIGINT) + ar.cache_read_tokens
                                    + ar.cache_creation_tokens) AS DOUBLE) END AS cache_hit_rate
        FROM {ar}"""
    q["q12_usage_by_practice"] = f"""
        SELECT e.practice, COUNT(DISTINCT up.session_id) AS session_count,
               COALESCE(SUM(sc.total_cost), 0.0) AS total_cost
        FROM {up_sc} GROUP BY 1"""
    q["q13_usage_by_level"] = f"""
        SELECT e.level, COUNT(DISTINCT up.session_id) AS session_count FROM {up} GROUP BY 1"""
    q["q14_top_engineers"] = f"""
        SELECT full_name, practice, level, session_count, total_cost,
               total_cost / NULLIF(session_count, 0) AS avg_cost_per_session, preferred_model
        FROM (SELECT e.full_name, e.practice, e.level, e.email,
                     COUNT(DISTINCT up.session_id) AS session_count,
                     COALESCE(SUM(sc.total_cost), 0.0) AS total_cost
              FROM {up_sc} GROUP BY e.full_name, e.practice, e.level, e.email) per
        LEFT JOIN (SELECT user_email, model AS preferred_model FROM (
                     SELECT user_email, model,
                            ROW_NUMBER() OVER (PARTITION BY user_email ORDER BY COUNT(*) DESC, model) AS rn
                     FROM api_requests GROUP BY user_email, model) WHERE rn = 1) fav
          ON fav.user_email = per.email
        ORDER BY session_count DESC, email LIMIT 10"""
    q["q15_usage_by_location"] = f"""
        SELECT e.location, COUNT(DISTINCT up.session_id) AS session_count FROM {up} GROUP BY 1"""
    q["q16_hourly_heatmap"] = f"""
        SELECT CAST(hour(up."timestamp") AS BIGINT) AS hour, dayname(up."timestamp") AS day_of_week,
               COUNT(DISTINCT up.session_id) AS session_count FROM {up} GROUP BY 1, 2"""
    q["q17_day_of_week_counts"] = f"""
        SELECT dayname(up."timestamp") AS day_of_week, COUNT(DISTINCT up.session_id) AS session_count
        FROM {up} GROUP BY 1"""
    q["q18_business_hours_split"] = f"""
        SELECT CASE WHEN hour(up."timestamp") BETWEEN 9 AND 17 THEN 'Business Hours (9–17)'
                    ELSE 'After Hours' END AS category,
               COUNT(DISTINCT up.session_id) AS session_count FROM {up} GROUP BY 1"""
    q["q19_tool_frequency"] = f"""
        SELECT td.tool_name, COUNT(*) AS call_count FROM {td} GROUP BY 1"""
    q["q20_tool_accept_reject"] = f"""
        SELECT td.tool_name, COUNT(*) FILTER (WHERE td.decision = 'accept') AS accept_count,
               COUNT(*) FILTER (WHERE td.decision = 'reject') AS reject_count FROM {td} GROUP BY 1"""
    q["q21_tool_success_rate"] = f"""
        SELECT tr.tool_name, AVG(CAST(tr.success AS INTEGER)) AS success_rate FROM {tr} GROUP BY 1"""
    q["q22_tool_execution_time"] = f"""
        SELECT tr.tool_name, AVG(tr.duration_ms) AS avg_duration_ms FROM {tr} GROUP BY 1"""
    q["q23_session_duration_hist"] = f"""
        SELECT ar.session_id, {minutes.format(a='ar')} AS duration_mins FROM {ar} GROUP BY 1"""
    q["q24_session_cost_by_practice"] = f"""
        SELECT up.session_id, e.practice, COALESCE(sc.total_cost, 0.0) AS total_cost FROM {up_sc}"""
    q["q25_api_latency_by_model"] = f"""
        SELECT ar.model, AVG(ar.duration_ms) AS avg_duration_ms FROM {ar} GROUP BY 1"""
    q["q26_error_breakdown"] = f"""
        SELECT CASE WHEN ae.status_code = 'undefined' THEN 'Unknown' ELSE ae.status_code END AS status_code,
               COUNT(*) AS count FROM {ae} GROUP BY 1"""
    q["q27_level_cost_correlation"] = f"""
        SELECT e.level, SUM(COALESCE(sc.total_cost, 0.0)) / COUNT(DISTINCT up.session_id)
               AS avg_cost_per_session FROM {up_sc} GROUP BY 1"""
    return {k: v if isinstance(v, tuple) else (v, "") for k, v in q.items()}


_WEEKDAY_RANK = ("CASE {c} WHEN 'Monday' THEN 0 WHEN 'Tuesday' THEN 1 WHEN 'Wednesday' THEN 2 "
                 "WHEN 'Thursday' THEN 3 WHEN 'Friday' THEN 4 WHEN 'Saturday' THEN 5 "
                 "WHEN 'Sunday' THEN 6 END")


def reshape_sql(f: SqlFilter) -> dict[str, str]:
    """Oracles for P1-P9, each over the SQL of the query it reshapes."""
    b = {k: v[0] for k, v in query_bodies(f).items()}
    hours = ", ".join(f'CAST(SUM(CASE WHEN hour = {h} THEN session_count ELSE 0 END) AS BIGINT) AS "{h}"'
                      for h in range(24))
    q = {}
    q["p1_heatmap_pivot"] = f"""
        SELECT day_of_week, {hours}, CAST({_WEEKDAY_RANK.format(c='day_of_week')} AS INTEGER) AS day_rank
        FROM ({b['q16_hourly_heatmap']}) q GROUP BY day_of_week"""
    q["p2_weekday_sorted"] = f"""
        SELECT day_of_week, session_count, CAST({_WEEKDAY_RANK.format(c='day_of_week')} AS INTEGER) AS day_rank
        FROM ({b['q17_day_of_week_counts']}) q"""
    q["p3_accept_reject_unpivot"] = f"""
        SELECT tool_name, 'accept_count' AS decision, accept_count AS count FROM ({b['q20_tool_accept_reject']}) q
        UNION ALL
        SELECT tool_name, 'reject_count', reject_count FROM ({b['q20_tool_accept_reject']}) q"""
    q["p4_log_histogram"] = f"""
        SELECT i AS bin, lo AS bin_lo, hi AS bin_hi, sqrt(lo * hi) AS bin_center,
               CAST(COALESCE(c, 0) AS BIGINT) AS count
        FROM (SELECT CAST(g.i AS INTEGER) AS i, power(10.0, s.a + g.i * s.w) AS lo,
                     CASE WHEN g.i = s.n - 1 THEN power(10.0, s.b) ELSE power(10.0, s.a + (g.i + 1) * s.w) END AS hi,
                     h.c
              FROM stats s, range(0, 30) g(i)
              LEFT JOIN (SELECT CASE WHEN s2.w > 0 THEN least(s2.n - 1, CAST(floor((log10(v) - s2.a) / s2.w) AS INTEGER))
                                     ELSE 0 END AS k, COUNT(*) AS c
                         FROM pos, stats s2 GROUP BY 1) h ON h.k = g.i
              WHERE g.i < s.n)"""
    q["p5_box_stats"] = f"""
        SELECT f.practice, f.n, m.mn AS min, f.q1, f.median, f.q3, m.mx AS max,
               m.wl AS whisker_low, m.wh AS whisker_high, m.outliers
        FROM (SELECT practice, COUNT(*) AS n, quantile_cont(total_cost, 0.25) AS q1,
                     quantile_cont(total_cost, 0.5) AS median, quantile_cont(total_cost, 0.75) AS q3
              FROM box_in GROUP BY practice) f
        JOIN (SELECT i.practice, MIN(total_cost) AS mn, MAX(total_cost) AS mx,
                     MIN(CASE WHEN total_cost >= q1 - 1.5 * (q3 - q1) THEN total_cost END) AS wl,
                     MAX(CASE WHEN total_cost <= q3 + 1.5 * (q3 - q1) THEN total_cost END) AS wh,
                     COUNT(*) FILTER (WHERE total_cost < q1 - 1.5 * (q3 - q1)
                                         OR total_cost > q3 + 1.5 * (q3 - q1)) AS outliers
              FROM box_in i JOIN (SELECT practice, quantile_cont(total_cost, 0.25) AS q1,
                                         quantile_cont(total_cost, 0.75) AS q3
                                  FROM box_in GROUP BY practice) qq ON qq.practice = i.practice
              GROUP BY i.practice) m ON m.practice = f.practice"""
    q["p6_status_code_order"] = f"""
        SELECT status_code, count,
               CASE WHEN regexp_full_match(status_code, '[0-9]+') THEN 0
                    WHEN lower(status_code) = 'unknown' THEN 2 ELSE 1 END AS code_class,
               CASE WHEN lower(status_code) = 'unknown' AND NOT regexp_full_match(status_code, '[0-9]+') THEN 0
                    ELSE COALESCE(TRY_CAST(regexp_replace(status_code, '[^0-9]', '', 'g') AS BIGINT), 0) END
                 AS code_number
        FROM ({b['q26_error_breakdown']}) q"""
    q["p8_model_share"] = f"""
        SELECT model, call_count, total_cost, CAST(call_count AS DOUBLE) / SUM(call_count) OVER () AS share
        FROM ({b['q10_model_distribution']}) q"""
    q["p8_business_hours_share"] = f"""
        SELECT category, session_count, CAST(session_count AS DOUBLE) / SUM(session_count) OVER () AS share
        FROM ({b['q18_business_hours_split']}) q"""
    q["p9_normalize_series"] = f"SELECT ds, y FROM ({b['q9_daily_cost_totals']}) q"
    extra = {
        "p4_log_histogram": f"""
            pos AS (SELECT duration_mins AS v FROM ({b['q23_session_duration_hist']}) q WHERE duration_mins > 0),
            stats AS (SELECT a, b, CASE WHEN b > a THEN 30 ELSE 1 END AS n,
                             CASE WHEN b > a THEN (b - a) / 30 ELSE 0.0 END AS w
                      FROM (SELECT log10(MIN(v)) AS a, log10(MAX(v)) AS b FROM pos) WHERE a IS NOT NULL)""",
        "p5_box_stats": f"box_in AS ({b['q24_session_cost_by_practice']})",
    }
    return {k: with_mapping(v, extra.get(k, "")) for k, v in q.items()}


# ---------------------------------------------------------------------------------------
# Forecasting (F1-F6): the same closed-form model written directly in SQL; the
# back-test is brute force (history x cut-offs joined and refitted per cut-off).

def _fit_ctes(p: str, src: str, sid: list[str], stable: bool = False) -> str:
    """``stable``: the engine's own regression instead of sums, which cancel on steep series."""
    k = ", ".join(sid)
    on = " AND ".join(f"se.{c} = h.{c}" for c in sid)
    coef = f"""SELECT {k}, b, (sy - b * st) / n AS a FROM (
               SELECT *, CASE WHEN n * stt - st * st <> 0 THEN (n * sty - st * sy) / (n * stt - st * st)
                              ELSE 0.0 END AS b FROM {p}_sums)"""
    if stable:
        coef = f"SELECT {k}, b, my - b * mt AS a FROM (SELECT {k}, COALESCE(regr_slope(y, t), 0.0) AS b, AVG(y) AS my, AVG(t) AS mt FROM {p}_h GROUP BY ALL)"
    return f"""
{p}_first AS (SELECT {k}, MIN(ds) AS start, MAX(ds) AS last FROM {src} GROUP BY {k}),
{p}_h AS (SELECT s.*, f.start, CAST(date_diff('day', f.start, s.ds) AS DOUBLE) AS t
          FROM {src} s JOIN {p}_first f USING ({k})),
{p}_sums AS (SELECT {k}, CAST(COUNT(*) AS DOUBLE) AS n, SUM(t) AS st, SUM(y) AS sy,
                    SUM(t * t) AS stt, SUM(t * y) AS sty FROM {p}_h GROUP BY {k}),
{p}_coef AS ({coef}),
{p}_season AS (SELECT {k}, dayofweek(h.ds) AS dow, AVG(h.y - (c.a + c.b * h.t)) AS s
               FROM {p}_h h JOIN {p}_coef c USING ({k}) GROUP BY ALL),
{p}_fit AS (SELECT h.*, c.a + c.b * h.t + COALESCE(se.s, 0.0) AS yhat
            FROM {p}_h h JOIN {p}_coef c USING ({k})
            LEFT JOIN {p}_season se ON {on} AND se.dow = dayofweek(h.ds)),
{p}_sigma AS (SELECT {k}, COALESCE(stddev_samp(y - yhat), 0.0) AS sigma FROM {p}_fit GROUP BY {k})"""


def _predict(p: str, rows: str, sid: list[str], z: float) -> str:
    """SELECT rows(sid..., ds[, y]) with yhat and band from model ``p``."""
    k = ", ".join(sid)
    on = " AND ".join(f"se.{c} = r.{c}" for c in sid)
    return f"""
SELECT r.*, c.a + c.b * CAST(date_diff('day', f.start, r.ds) AS DOUBLE) + COALESCE(se.s, 0.0) AS yhat,
       c.a + c.b * CAST(date_diff('day', f.start, r.ds) AS DOUBLE) + COALESCE(se.s, 0.0) - {z!r} * g.sigma
         AS yhat_lower,
       c.a + c.b * CAST(date_diff('day', f.start, r.ds) AS DOUBLE) + COALESCE(se.s, 0.0) + {z!r} * g.sigma
         AS yhat_upper
FROM {rows} r JOIN {p}_first f USING ({k}) JOIN {p}_coef c USING ({k}) JOIN {p}_sigma g USING ({k})
LEFT JOIN {p}_season se ON {on} AND se.dow = dayofweek(r.ds)"""


def _normalize_cte(name: str, raw: str, key: str, date_start=None, date_end=None) -> str:
    s = f"DATE '{date_start}'" if date_start else "MIN(ds)"
    e = f"least(DATE '{date_end}', MAX(ds))" if date_end else "MAX(ds)"
    return f"""
{name}_d AS (SELECT {key}, CAST(ds AS DATE) AS ds, SUM(y) AS y FROM ({raw}) GROUP BY 1, 2),
{name}_b AS (SELECT {key}, {s} AS s, {e} AS e FROM {name}_d GROUP BY 1),
{name}_days AS (SELECT {key}, CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS ds
                FROM {name}_b WHERE s <= e),
{name} AS (SELECT x.{key}, x.ds, COALESCE(d.y, 0.0) AS y FROM {name}_days x
           LEFT JOIN {name}_d d ON d.{key} = x.{key} AND d.ds = x.ds)"""


ORDERS_RAW = ("SELECT o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS ds, o_totalprice AS y "
              "FROM orders")


def forecast_sql(f: SqlFilter, z: float, periods: int = 14, f1_start=None, f1_end=None) -> dict[str, str]:
    b = {k: v[0] for k, v in query_bodies(f).items()}
    q5 = f"SELECT practice, date AS ds, total_cost AS y FROM ({b['q5_cost_by_practice_over_time']})"
    out = {}
    out["f1_normalize_daily"] = with_mapping(
        "SELECT practice, ds, y FROM pr", _normalize_cte("pr", q5, "practice", f1_start, f1_end))
    ordr = _normalize_cte("od", ORDERS_RAW, "priority") + "," + _fit_ctes("m", "od", ["priority"])
    fut = (f"fut AS (SELECT priority, CAST(unnest(generate_series(last + 1, last + {periods}, "
           f"INTERVAL 1 DAY)) AS DATE) AS ds FROM m_first)")
    out["f2_fit_predict"] = "WITH " + ordr + "," + fut + "\n" + \
        "SELECT priority, ds, yhat, yhat_lower, yhat_upper FROM (" + \
        _predict("m", "(SELECT priority, ds FROM od UNION ALL SELECT priority, ds FROM fut)", ["priority"], z) + ")"
    out["f3_anomalies"] = "WITH " + ordr + """
SELECT priority, ds, y AS actual_cost, yhat AS expected_cost, y - yhat AS residual FROM (
  SELECT *, stddev_samp(y - yhat) OVER (PARTITION BY priority) AS sd FROM m_fit)
WHERE sd IS NOT NULL AND sd <> 0 AND abs(y - yhat) > 2.0 * sd"""
    def back_test(series: str, stable: bool) -> str:
        """Every cut-off of the daily totals, as changed by ``series``, joined with its training and test days."""
        source = _normalize_cte("od", ORDERS_RAW, "priority").replace("COALESCE(d.y, 0.0) AS y", f"{series} AS y")
        return (source + """,
bounds AS (SELECT priority, MIN(ds) AS lo, MAX(ds) AS hi, COUNT(*) AS n FROM od GROUP BY 1),
cuts AS (SELECT priority, CAST(hi - CAST(14 + 7 * k AS INTEGER) AS DATE) AS cutoff FROM bounds,
         range(0, CAST(floor((date_diff('day', lo, hi) - 43) / 7) AS BIGINT) + 1) r(k)
         WHERE n >= 44 AND date_diff('day', lo, hi) >= 43),
train AS (SELECT od.priority, c.cutoff, od.ds, od.y FROM od JOIN cuts c USING (priority) WHERE od.ds <= c.cutoff),
test AS (SELECT od.priority, c.cutoff, od.ds, od.y FROM od JOIN cuts c USING (priority)
         WHERE od.ds > c.cutoff AND od.ds <= c.cutoff + 14),""" + _fit_ctes("cv", "train", ["priority", "cutoff"], stable))

    bt = back_test("COALESCE(d.y, 0.0)", False)
    score = _predict("cv", "test", ["priority", "cutoff"], z)
    metrics = f"""
SELECT priority, COUNT(DISTINCT cutoff) AS n_cutoffs, AVG(abs(y - yhat)) AS mae, AVG(CASE WHEN y <> 0 THEN abs(y - yhat) / abs(y) END) AS mape,
       AVG(CASE WHEN y >= yhat_lower AND y <= yhat_upper THEN 1.0 ELSE 0.0 END) AS coverage FROM ({score}) GROUP BY 1"""
    day = "CAST(date_diff('day', (SELECT MIN(b.s) FROM od_b b WHERE b.priority = x.priority), x.ds) AS DOUBLE)"
    slope = "[0.0, 1e3, 1e5, 1e6, 1e7][CAST(substring(x.priority, 1, 1) AS INTEGER)]"
    out["f4_steep_trend"] = "WITH " + back_test(f"COALESCE(d.y, 0.0) / 100000 + {slope} * {day}", True) + metrics
    out["f4_shifted_series"] = "WITH " + back_test("COALESCE(d.y, 0.0) / 100000 + 1e8", True) + metrics
    widths = """SELECT priority, step, width FROM (
  SELECT priority, step, width, row_number() OVER (PARTITION BY priority, step ORDER BY width) AS nth, COUNT(*) OVER (PARTITION BY priority, step) AS n FROM miss{where})
  WHERE nth = least(CAST(ceil(round(0.8 * (n + 1), 9)) AS BIGINT), n)"""
    miss = f""",
miss AS (SELECT priority, cutoff, date_diff('day', cutoff, ds) AS step, abs(y - yhat) AS width,
                (date_diff('day', cutoff, MAX(cutoff) OVER (PARTITION BY priority)) // 7) % 2 = 0 AS sets FROM ({score}))"""
    out["f4_conformal_coverage"] = "WITH " + bt + miss + f""",
w AS ({widths.format(where=" WHERE sets")})
SELECT priority, COUNT(*) AS n_days, AVG(CASE WHEN miss.width <= w.width THEN 1.0 ELSE 0.0 END) AS coverage
FROM miss JOIN w USING (priority, step) WHERE NOT sets GROUP BY 1"""
    out["f2_conformal_forecast"] = "WITH " + bt + miss + "," + _fit_ctes("m", "od", ["priority"]) + "," + fut + f""",
w AS ({widths.format(where="")}),
p AS (SELECT priority, ds, yhat, row_number() OVER (PARTITION BY priority ORDER BY ds) AS step
      FROM ({_predict("m", "(SELECT priority, ds FROM fut)", ["priority"], z)}))
SELECT priority, ds, yhat, yhat - width AS yhat_lower, yhat + width AS yhat_upper FROM p JOIN w USING (priority, step)"""
    out["f1_nan_totals"] = "WITH " + _normalize_cte("od", ORDERS_RAW.replace(
        "o_totalprice AS y", "CASE WHEN o_orderkey % 11 <> 3 THEN o_totalprice END AS y"), "priority") + "\nSELECT priority, ds, y FROM od"
    out["f6_summary_anomalies"] = out["f3_anomalies"]
    out["f4_backtest"] = "WITH " + bt + "\n" + f"""
SELECT priority, COUNT(DISTINCT cutoff) AS n_cutoffs, AVG(abs(y - yhat)) AS mae,
       AVG(CASE WHEN y <> 0 THEN abs(y - yhat) / abs(y) END) AS mape,
       AVG(CASE WHEN y >= yhat_lower AND y <= yhat_upper THEN 1.0 ELSE 0.0 END) AS coverage
FROM ({_predict("cv", "test", ["priority", "cutoff"], z)}) GROUP BY 1"""
    out["f6_summary_metrics"] = out["f4_backtest"]
    pr = _normalize_cte("pr", q5, "practice") + "," + _fit_ctes("m", "pr", ["practice"])
    out["f6_forecast_status"] = with_mapping(f"""
SELECT r.practice, CASE WHEN COALESCE(h.n, 0) < 14 THEN 'insufficient_data' ELSE 'ok' END AS status,
       CASE WHEN COALESCE(h.n, 0) < 14 THEN 'At least 14 days of daily cost history are required for forecasting.'
            WHEN h.n < 44 THEN 'Cross-validation metrics require at least 44 days of history.' END AS message,
       CAST(COALESCE(h.n, 0) AS BIGINT) AS history_days
FROM (SELECT DISTINCT practice FROM ({q5})) r LEFT JOIN (SELECT practice, COUNT(*) AS n FROM pr GROUP BY 1) h
  USING (practice)""", pr)
    # the reference's own flow: Q9 daily totals under the filter, one series,
    # gap-filled over the filter's dates (end clamped to the last day with data)
    q9 = f"SELECT 'all' AS series, ds, y FROM ({b['q9_daily_cost_totals']})"
    one = (_normalize_cte("dc", q9, "series", f.date_start, f.date_end) + ","
           + _fit_ctes("m1", "dc", ["series"]))
    out["f6_daily_cost_status"] = with_mapping("""
SELECT CASE WHEN n < 14 THEN 'insufficient_data' ELSE 'ok' END AS status,
       CASE WHEN n < 14 THEN 'At least 14 days of daily cost history are required for forecasting.'
            WHEN n < 44 THEN 'Cross-validation metrics require at least 44 days of history.' END AS message,
       CAST(n AS BIGINT) AS history_days
FROM (SELECT COUNT(*) AS n FROM dc)""", one)
    fut1 = (f"fut1 AS (SELECT series, CAST(unnest(generate_series(last + 1, last + {periods}, "
            f"INTERVAL 1 DAY)) AS DATE) AS ds FROM m1_first)")
    out["f6_daily_cost_forecast"] = with_mapping(
        "SELECT ds, yhat, yhat_lower, yhat_upper FROM (" +
        _predict("m1", "(SELECT series, ds FROM fut1)", ["series"], z) + ")", one + "," + fut1)
    fut2 = (f"fut AS (SELECT practice, CAST(unnest(generate_series(last + 1, last + {periods}, "
            f"INTERVAL 1 DAY)) AS DATE) AS ds FROM m_first)")
    out["f6_forecast_future"] = with_mapping(
        "SELECT practice, ds, yhat, yhat_lower, yhat_upper FROM (" +
        _predict("m", "(SELECT practice, ds FROM fut)", ["practice"], z) + ")", pr + "," + fut2)
    return out
