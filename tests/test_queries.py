"""Q1-Q27 on the reference's hand-computed fixture, plus the quirks K1-K10."""

import datetime as dt

import pytest

from fixtures import API_REQUESTS, EMPLOYEES, FILTER, T, USER_PROMPTS, make_tables
from tokentally.operators.filters import Filters
from tokentally.plans import catalog


@pytest.fixture(scope="module")
def tables(spark):
    return make_tables(spark)


def run(tables, qid, **f):
    return catalog.run(qid, tables, Filters(**{**FILTER, **f}))


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_kpi_metrics(tables):
    (r,) = rows(run(tables, "q1_kpi_metrics"))
    assert r["total_sessions"] == 2 and r["active_engineers"] == 2
    assert r["total_cost"] == pytest.approx(0.061)
    assert r["error_rate"] == pytest.approx(1 / 3)


def test_kpi_metrics_empty_gives_zeros(tables):
    (r,) = rows(run(tables, "q1_kpi_metrics", locations=["Canada"]))
    assert r == {"total_sessions": 0, "active_engineers": 0, "total_cost": 0.0, "error_rate": 0.0}


def test_daily_sessions(tables):
    assert [(r["date"], r["session_count"]) for r in rows(run(tables, "q2_daily_sessions"))] == [
        (dt.date(2025, 12, 10), 1), (dt.date(2025, 12, 11), 1)]


def test_session_kpis(tables):
    (r,) = rows(run(tables, "q3_session_kpis"))
    assert r["avg_duration_mins"] == pytest.approx(2.5)
    assert r["avg_prompts_per_session"] == pytest.approx(1.0)
    (e,) = rows(run(tables, "q3_session_kpis", locations=["Canada"]))
    assert e == {"avg_duration_mins": 0.0, "avg_prompts_per_session": 0.0}


def test_cache_savings(tables):
    (r,) = rows(run(tables, "q4_cache_savings"))
    assert r["cache_savings_usd"] == pytest.approx(0.00405)


def test_cost_by_practice_over_time(tables):
    out = rows(run(tables, "q5_cost_by_practice_over_time"))
    assert [(r["date"], r["practice"]) for r in out] == [
        (dt.date(2025, 12, 10), "Backend Engineering"), (dt.date(2025, 12, 11), "Frontend Engineering")]
    assert out[0]["total_cost"] == pytest.approx(0.011)


def test_level_order_puts_l10_last(spark):
    emp = EMPLOYEES + [("carol@example.com", "Carol King", "ML Engineering", "L10", "Canada")]
    ar = API_REQUESTS + [("s3", "carol@example.com", T("2025-12-12 09:00:00"), "claude-opus-4-6",
                          1, 1, 1, 1, 0.5, 100, "vscode")]
    up = USER_PROMPTS + [("s3", "carol@example.com", T("2025-12-12 09:00:00"), 10, "vscode")]
    t = make_tables(spark, employees=emp, api_requests=ar, user_prompts=up)
    for qid in ("q6_cost_by_level_over_time", "q13_usage_by_level", "q27_level_cost_correlation"):
        levels = [r["level"] for r in rows(catalog.run(qid, t, Filters(**FILTER)))]
        assert levels == ["L3", "L5", "L10"], qid


def test_token_breakdown(tables):
    out = rows(run(tables, "q7_token_breakdown"))
    assert [r["token_type"] for r in out] == ["Input", "Output", "Cache Read", "Cache Creation"]
    assert out[0]["total"] == 150
    assert [r["total"] for r in rows(run(tables, "q7_token_breakdown", locations=["Canada"]))] == [0, 0, 0, 0]


def test_avg_cost_per_session_over_time(tables):
    out = {r["date"]: r["avg_cost_per_session"] for r in rows(run(tables, "q8_avg_cost_per_session_over_time"))}
    assert out[dt.date(2025, 12, 10)] == pytest.approx(0.011)


def test_daily_cost_totals(tables):
    out = rows(run(tables, "q9_daily_cost_totals"))
    assert out[0]["ds"] == dt.date(2025, 12, 10) and out[0]["y"] == pytest.approx(0.011)
    assert [r["ds"] for r in rows(run(tables, "q9_daily_cost_totals", locations=["Germany"]))] == [
        dt.date(2025, 12, 10)]


def test_model_distribution(tables):
    out = rows(run(tables, "q10_model_distribution"))
    assert {r["model"] for r in out} == {"claude-sonnet-4-6", "claude-haiku-4-5-20251001", "claude-opus-4-6"}
    assert all(r["call_count"] == 1 for r in out)


def test_cache_hit_rate(tables):
    (r,) = rows(run(tables, "q11_cache_hit_rate"))
    assert r["cache_hit_rate"] == pytest.approx(1500 / 1650)
    (e,) = rows(run(tables, "q11_cache_hit_rate", locations=["Canada"]))
    assert e["cache_hit_rate"] == 0.0


def test_usage_by_practice(tables):
    out = {r["practice"]: r for r in rows(run(tables, "q12_usage_by_practice"))}
    assert out["Backend Engineering"]["session_count"] == 1
    assert out["Backend Engineering"]["total_cost"] == pytest.approx(0.011)


def test_top_engineers(tables):
    out = {r["full_name"]: r for r in rows(run(tables, "q14_top_engineers"))}
    assert out["Alice Smith"]["avg_cost_per_session"] == pytest.approx(0.011)
    # alice used sonnet and haiku once each: the tie goes to the lower name
    assert out["Alice Smith"]["preferred_model"] == "claude-haiku-4-5-20251001"
    assert out["Bob Jones"]["preferred_model"] == "claude-opus-4-6"


def test_usage_by_location(tables):
    assert {r["location"]: r["session_count"] for r in rows(run(tables, "q15_usage_by_location"))} == {
        "Germany": 1, "Poland": 1}


def test_heatmap_and_weekdays(tables):
    hm = rows(run(tables, "q16_hourly_heatmap"))
    assert {(r["hour"], r["day_of_week"]) for r in hm} == {(10, "Wednesday"), (20, "Thursday")}
    dow = {r["day_of_week"]: r["session_count"] for r in rows(run(tables, "q17_day_of_week_counts"))}
    assert dow == {"Wednesday": 1, "Thursday": 1}


def test_business_hours_split(tables):
    out = {r["category"]: r["session_count"] for r in rows(run(tables, "q18_business_hours_split"))}
    assert out == {"Business Hours (9–17)": 1, "After Hours": 1}


def test_tools(tables):
    assert {r["tool_name"]: r["call_count"] for r in rows(run(tables, "q19_tool_frequency"))} == {
        "Read": 2, "Edit": 1}
    ar = {r["tool_name"]: (r["accept_count"], r["reject_count"]) for r in rows(run(tables, "q20_tool_accept_reject"))}
    assert ar == {"Read": (2, 0), "Edit": (0, 1)}
    assert rows(run(tables, "q21_tool_success_rate")) == [{"tool_name": "Read", "success_rate": 1.0}]
    assert rows(run(tables, "q22_tool_execution_time")) == [{"tool_name": "Read", "avg_duration_ms": 90.5}]


def test_sessions(tables):
    d = {r["session_id"]: r["duration_mins"] for r in rows(run(tables, "q23_session_duration_hist"))}
    assert d == {"s1": pytest.approx(5.0), "s2": 0.0}
    c = {r["session_id"]: r["total_cost"] for r in rows(run(tables, "q24_session_cost_by_practice"))}
    assert c["s1"] == pytest.approx(0.011)
    lat = {r["model"]: r["avg_duration_ms"] for r in rows(run(tables, "q25_api_latency_by_model"))}
    assert lat["claude-sonnet-4-6"] == 9000.0
    assert rows(run(tables, "q26_error_breakdown")) == [{"status_code": "401", "count": 1}]
    lv = {r["level"]: r["avg_cost_per_session"] for r in rows(run(tables, "q27_level_cost_correlation"))}
    assert lv["L5"] == pytest.approx(0.011)


# ---- quirks the reference's own fixture does not reach ------------------------------

@pytest.fixture(scope="module")
def quirky(spark):
    emp = EMPLOYEES + [(f"eng{i:02d}@example.com", f"Eng {i:02d}", "Data Engineering", "L2", "Canada")
                       for i in range(12)]
    ar = API_REQUESTS + [
        # s3: one request inside the range, one long before it (K3)
        ("s3", "alice@example.com", T("2025-12-15 09:00:00"), "m", 1, 1, 1, 1, 1.0, 10, "vscode"),
        ("s3", "alice@example.com", T("2025-11-01 09:00:00"), "m", 1, 1, 1, 1, 2.0, 10, "vscode"),
        # request of a user missing from the directory
        ("s9", "ghost@example.com", T("2025-12-15 09:00:00"), "m", 1, 1, 1, 1, 100.0, 10, "vscode"),
    ]
    up = USER_PROMPTS + [
        # s3 has three prompts (K1/K2); one at each business-hours boundary (K6)
        ("s3", "alice@example.com", T("2025-12-15 08:59:00"), 1, "vscode"),
        ("s3", "alice@example.com", T("2025-12-15 09:00:00"), 1, "vscode"),
        ("s3", "alice@example.com", T("2025-12-15 17:59:00"), 1, "vscode"),
        ("s4", "bob@example.com", T("2025-12-16 18:00:00"), 1, "iterm"),
        ("s9", "ghost@example.com", T("2025-12-15 09:00:00"), 1, "vscode"),
    ] + [(f"x{i}", f"eng{i:02d}@example.com", T("2025-12-20 12:00:00"), 1, "vscode") for i in range(12)]
    ae = [("s2", "bob@example.com", T("2025-12-11 20:00:30"), "m", "e", "undefined", 1, 5, "iterm")]
    return make_tables(spark, employees=emp, api_requests=ar, user_prompts=up, api_errors=ae)


def test_k1_k3_session_cost_counts_once_per_prompt_and_is_lifetime(quirky):
    out = {r["practice"]: r for r in rows(catalog.run("q12_usage_by_practice", quirky, Filters(**FILTER)))}
    # alice: s1 (0.011, 1 prompt) + s3 (3.0 lifetime, 3 prompts) -> 0.011 + 3 * 3.0
    assert out["Backend Engineering"]["session_count"] == 2
    assert out["Backend Engineering"]["total_cost"] == pytest.approx(0.011 + 9.0)
    k2 = [r for r in rows(catalog.run("q24_session_cost_by_practice", quirky, Filters(**FILTER)))
          if r["session_id"] == "s3"]
    assert len(k2) == 3 and all(r["total_cost"] == pytest.approx(3.0) for r in k2)


def test_j1_unknown_users_drop_out(quirky):
    (r,) = rows(catalog.run("q1_kpi_metrics", quirky, Filters(**FILTER)))
    assert r["total_cost"] == pytest.approx(0.061 + 1.0)   # ghost's 100.0 is not counted


def test_k6_business_hour_boundaries(quirky):
    f = Filters(date_start="2025-12-15", date_end="2025-12-16")
    out = {r["category"]: r["session_count"] for r in rows(catalog.run("q18_business_hours_split", quirky, f))}
    # s3 is active both before 9 and inside 9-17 (K5: counted in both); s4 at 18:00 is after hours
    assert out == {"Business Hours (9–17)": 1, "After Hours": 2}


def test_k8_top10_ties_go_to_lower_email(quirky):
    out = rows(catalog.run("q14_top_engineers", quirky, Filters(**FILTER)))
    assert len(out) == 10
    names = [r["full_name"] for r in out]
    assert names[:2] == ["Alice Smith", "Bob Jones"]
    assert names[2:] == [f"Eng {i:02d}" for i in range(8)]


def test_undefined_status_is_relabelled(quirky):
    assert rows(catalog.run("q26_error_breakdown", quirky, Filters(**FILTER))) == [
        {"status_code": "Unknown", "count": 1}]


def test_filters_all_values_equals_no_filter(tables):
    allf = dict(practices=["Backend Engineering", "Frontend Engineering"], levels=["L3", "L5"],
                locations=["Germany", "Poland"])
    a = sorted(map(tuple, run(tables, "q10_model_distribution", **allf).collect()))
    b = sorted(map(tuple, run(tables, "q10_model_distribution").collect()))
    assert a == b


def test_k9_error_rate_can_exceed_one(spark):
    ae = [("s2", "bob@example.com", T(f"2025-12-11 20:0{i}:30"), "m", "e", "500", 1, 5, "iterm") for i in range(5)]
    t = make_tables(spark, api_errors=ae)
    (r,) = rows(catalog.run("q1_kpi_metrics", t, Filters(**FILTER)))
    assert r["error_rate"] == pytest.approx(5 / 3)


def test_k10_grouped_queries_are_empty_on_no_data(tables):
    for qid in ("q2_daily_sessions", "q5_cost_by_practice_over_time", "q10_model_distribution",
                "q12_usage_by_practice", "q14_top_engineers", "q16_hourly_heatmap", "q19_tool_frequency",
                "q23_session_duration_hist", "q24_session_cost_by_practice", "q26_error_breakdown"):
        assert run(tables, qid, locations=["Canada"]).count() == 0, qid


def test_hot_session_matches_brute_force(spark):
    # one session holds most prompts: the pre-aggregated join must equal the
    # per-prompt join of the reference
    up = USER_PROMPTS + [("hot", "alice@example.com", T("2025-12-12 10:00:00") + dt.timedelta(seconds=i), 1, "vscode")
                         for i in range(2000)]
    ar = API_REQUESTS + [("hot", "alice@example.com", T("2025-12-12 09:00:00"), "m", 1, 1, 1, 1, 0.25, 5, "vscode")]
    t = make_tables(spark, api_requests=ar, user_prompts=up)
    f = Filters(**FILTER)
    cost = {}
    for s, *_rest in ar:
        cost[s] = cost.get(s, 0.0) + _rest[7]
    emp = {e[0]: e for e in EMPLOYEES}
    exp_total, exp_sessions = {}, {}
    for s, u, *_ in up:
        p = emp[u][2]
        exp_total[p] = exp_total.get(p, 0.0) + cost.get(s, 0.0)
        exp_sessions.setdefault(p, set()).add(s)
    got = {r["practice"]: r for r in rows(catalog.run("q12_usage_by_practice", t, f))}
    for p in exp_total:
        assert got[p]["total_cost"] == pytest.approx(exp_total[p])
        assert got[p]["session_count"] == len(exp_sessions[p])
    lv = {r["level"]: r["avg_cost_per_session"] for r in rows(catalog.run("q27_level_cost_correlation", t, f))}
    assert lv["L5"] == pytest.approx(exp_total["Backend Engineering"] / len(exp_sessions["Backend Engineering"]))
    assert catalog.run("q24_session_cost_by_practice", t, f).where("session_id = 'hot'").count() == 2000


def test_materialised_session_cost_gives_the_same_answers(quirky):
    m = quirky.with_session_cost()
    f = Filters(**FILTER)
    for qid in ("q8_avg_cost_per_session_over_time", "q12_usage_by_practice", "q14_top_engineers",
                "q24_session_cost_by_practice", "q27_level_cost_correlation"):
        a = sorted(map(repr, catalog.run(qid, quirky, f).collect()))
        b = sorted(map(repr, catalog.run(qid, m, f).collect()))
        assert a == b, qid


def test_filters_as_a_dict_like_the_reference_api(tables):
    out = rows(catalog.run("q15_usage_by_location", tables, {"date_start": "2025-12-01", "date_end": "2026-02-28",
                                                             "locations": ["Germany"]}))
    assert out == [{"location": "Germany", "session_count": 1}]
    with pytest.raises(ValueError, match="Invalid location"):
        catalog.run("q15_usage_by_location", tables, {"date_start": "2025-12-01", "date_end": "2026-02-28",
                                                      "locations": ["Atlantis"]})
