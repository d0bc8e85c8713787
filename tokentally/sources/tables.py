"""The six curated tables as one bundle (S16 write, S19 read) and the join policy."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentally.functions.columns import event_day
from tokentally.sources.schemas import FACT_SCHEMAS, TABLE_SCHEMAS

# Largest employee directory we hint for broadcast under the "checked" policy.
# ~5 short strings per row keeps this well under 100 MB.
DEFAULT_BROADCAST_MAX_ROWS = 500_000


def run_all(jobs: list, concurrent: int = 1) -> None:
    """Run independent Spark actions, ``concurrent`` at a time (driver threads)."""
    if concurrent <= 1:
        for job in jobs:
            job()
        return
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=concurrent) as pool:
        for f in [pool.submit(job) for job in jobs]:
            f.result()


@dataclass
class Tables:
    employees: DataFrame
    user_prompts: DataFrame
    api_requests: DataFrame
    tool_decisions: DataFrame
    tool_results: DataFrame
    api_errors: DataFrame
    # "checked": count the dimension once and hint a broadcast when it is under
    #            the row bound; above it, a shuffle join with AQE skew splitting.
    # "auto":    no hint; Spark's own size estimate decides.  Derived fact views can
    #            look smaller than the directory on small files, so Spark may then
    #            broadcast the fact side instead.
    broadcast_policy: str = "checked"
    broadcast_max_rows: int = DEFAULT_BROADCAST_MAX_ROWS
    _employee_rows: int | None = field(default=None, repr=False)
    _session_cost: DataFrame | None = field(default=None, repr=False)

    # ---- S19: read the curated tables -------------------------------------------------
    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str, **kw) -> "Tables":
        root = root.rstrip("/")
        dfs = {name: spark.read.parquet(f"{root}/{name}") for name in TABLE_SCHEMAS}
        return cls(**dfs, **kw)

    # ---- S16: idempotent build (drop + recreate = overwrite) ---------------------------
    def writers(self, root: str) -> list:
        """One callable per table write (all independent Spark jobs)."""
        root = root.rstrip("/")

        def employees():
            self.employees.select(*TABLE_SCHEMAS["employees"].fieldNames()) \
                .write.mode("overwrite").parquet(f"{root}/employees")

        def fact(name: str, schema):
            def run():
                df = getattr(self, name).select(*schema.fieldNames())
                (df.withColumn("event_date", event_day("timestamp")).hint("rebalance", "event_date")
                   .write.mode("overwrite").partitionBy("event_date").parquet(f"{root}/{name}"))
            return run
        return [employees] + [fact(n, sch) for n, sch in FACT_SCHEMAS.items()]

    def write_parquet(self, root: str, concurrent: int = 1) -> None:
        """Write all six tables.  Facts are partitioned by ``event_date`` so date
        filters prune whole directories.  Rows are rebalanced on the day first, so a
        day is a few files of good size rather than one per task; AQE splits hot
        days.  ``concurrent`` > 1 submits the independent writes as concurrent
        Spark jobs (their scheduling and commit overheads overlap)."""
        run_all(self.writers(root), concurrent)

    def fact(self, name: str) -> DataFrame:
        if name not in FACT_SCHEMAS:
            raise ValueError(f"Unknown table: {name!r}")
        return getattr(self, name)

    # ---- A1 session-cost roll-up ----------------------------------------------------------
    def session_cost(self) -> DataFrame:
        """Lifetime cost per session (unfiltered, K3): the materialised copy when
        ``with_session_cost`` was called, else the lazy aggregate."""
        if self._session_cost is not None:
            return self._session_cost
        from tokentally.operators.rollups import session_cost
        return session_cost(self.api_requests)

    def with_session_cost(self) -> "Tables":
        """Materialise A1 once for every query that needs it (Q8, Q12, Q14, Q24, Q27).

        Written to the shared checkpoint folder, one row per session; later joins
        shuffle that copy on the session id, but do not aggregate the requests again.
        """
        from tokentally.operators.rollups import session_cost
        from tokentally.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(self.api_requests.sparkSession)
        sc = session_cost(self.api_requests).checkpoint(eager=True)
        out = Tables(self.employees, self.user_prompts, self.api_requests, self.tool_decisions,
                     self.tool_results, self.api_errors, self.broadcast_policy, self.broadcast_max_rows)
        out._employee_rows, out._session_cost = self._employee_rows, sc
        return out

    # ---- J1 join policy -------------------------------------------------------------------
    def employee_rows(self) -> int:
        """Row count of the dimension, computed once (one small job)."""
        if self._employee_rows is None:
            self._employee_rows = self.employees.count()
        return self._employee_rows

    def employees_broadcastable(self) -> bool:
        return self.employee_rows() <= self.broadcast_max_rows

    def dimension(self, df: DataFrame | None = None) -> DataFrame:
        """The (optionally pre-filtered) employee side of J1.  Hinted for broadcast
        only under the "checked" policy and when the whole dimension is under the
        counted row bound; otherwise Spark's size checks decide."""
        emp = self.employees if df is None else df
        if self.broadcast_policy == "checked" and self.employees_broadcastable():
            return F.broadcast(emp)
        return emp
