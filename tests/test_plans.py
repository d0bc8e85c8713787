"""Plan guards: no registered query may plan a Cartesian product or a nested-loop
join, and fact scans must carry pushed-down filters."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tokentally.operators import forecast as FC
from tokentally.operators.filters import Filters
from tokentally.plans import forecasts, sessions
from tokentally.sources.driver_tables import driver_tables

SF = "/root/testdata/sf0.001"
SIDE_EFFECTS = re.compile(r"^(s\d+_|e\d+_|op\d+_|pipeline$)")   # these run jobs of their own; covered elsewhere


def explain(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", [n for n in E.queries() if not SIDE_EFFECTS.match(n)])
def test_plan_has_no_cross_join_and_pushes_filters(spark, name):
    plan = explain(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for scan in re.findall(r"Location: InMemoryFileIndex \[[^\]]*events\.parquet\]\n(.*?)\n\n", plan, re.S):
        assert "PushedFilters: [" in scan and "EqualTo(event_type" in scan, name


def test_forecast_outputs_never_read_the_raw_rows(spark):
    s = FC.forecast_summary(forecasts.orders_raw(spark, SF), ["priority"])
    for out in (s.status, s.history, s.forecast, s.anomalies, s.metrics):
        assert "Scan parquet" not in explain(out)


@pytest.mark.parametrize("name", ["p8_model_share", "p8_business_hours_share"])
def test_shares_read_the_facts_once(spark, name):
    assert len(re.findall(r"Location: InMemoryFileIndex \[[^\]]*events\.parquet\]", explain(E.queries()[name](spark, SF)))) == 1


def test_hot_session_is_spread_over_tasks(spark):
    t = driver_tables(spark, SF)
    hot = F.when(F.hash("timestamp") % 10 < 7, F.lit("hot")).otherwise(F.col("session_id"))
    tables = type(t)(t.employees, t.user_prompts.withColumn("session_id", hot), t.api_requests, t.tool_decisions,
                     t.tool_results, t.api_errors)
    out = sessions.session_cost_by_practice(tables, Filters(domains=None), piece_rows=5)
    tasks = [r["count"] for r in out.where("session_id = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == tables.user_prompts.where("session_id = 'hot'").count()
    assert len(tasks) == 4 and max(tasks) < 0.5 * sum(tasks)
