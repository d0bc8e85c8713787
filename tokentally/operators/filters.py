"""D1-D5 filters and the J1 fact-to-employee join."""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field
from typing import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.functions.columns import event_day

# The reference's allowed filter values.
DEFAULT_PRACTICES = (
    "Platform Engineering", "Data Engineering", "ML Engineering",
    "Backend Engineering", "Frontend Engineering",
)
DEFAULT_LEVELS = tuple(f"L{i}" for i in range(1, 11))
MAX_DOMAIN = 10_000
DEFAULT_LOCATIONS = ("United States", "Germany", "United Kingdom", "Poland", "Canada")


@dataclass(frozen=True)
class Domains:
    """Allowed values for the three list filters (configuration, not constants)."""

    practices: frozenset = frozenset(DEFAULT_PRACTICES)
    levels: frozenset = frozenset(DEFAULT_LEVELS)
    locations: frozenset = frozenset(DEFAULT_LOCATIONS)

    @classmethod
    def from_employees(cls, employees: DataFrame) -> "Domains":
        """Domains read from the dimension itself: distinct values made on the cluster;
        more than ``MAX_DOMAIN`` of them raise instead of reaching the driver."""
        def values(col: str) -> frozenset:
            rows = employees.select(col).where(F.col(col).isNotNull()).distinct().limit(MAX_DOMAIN + 1).collect()
            if len(rows) > MAX_DOMAIN:
                raise ValueError(f"{col} has more than {MAX_DOMAIN} values: pass Domains, or domains=None")
            return frozenset(r[0] for r in rows)
        return cls(values("practice"), values("level"), values("location"))


def _as_date(value, name: str) -> _dt.date:
    if isinstance(value, _dt.datetime):
        return value.date()
    if isinstance(value, _dt.date):
        return value
    if isinstance(value, str):
        text = value.strip()
        try:
            if len(text) > 10:
                return _dt.datetime.fromisoformat(text).date()
            return _dt.date.fromisoformat(text)
        except ValueError as exc:
            raise ValueError(f"Invalid {name}: {value!r}") from exc
    raise ValueError(f"Invalid {name}: {value!r}")


@dataclass(frozen=True)
class Filters:
    """Date range (both ends inclusive, ``None`` = no bound) plus three allow-lists;
    empty list = no filter.

    Validation (D5) runs on construction and raises ``ValueError``.
    """

    date_start: _dt.date | None = None
    date_end: _dt.date | None = None
    practices: tuple = ()
    levels: tuple = ()
    locations: tuple = ()
    domains: Domains | None = field(default_factory=Domains, compare=False)

    def __post_init__(self):
        for name in ("date_start", "date_end"):
            value = getattr(self, name)
            object.__setattr__(self, name, None if value is None else _as_date(value, name))
        for name in ("practices", "levels", "locations"):
            vals = getattr(self, name)
            if isinstance(vals, str):
                vals = (vals,)
            object.__setattr__(self, name, tuple(vals or ()))
        if None not in (self.date_start, self.date_end) and self.date_start > self.date_end:
            raise ValueError(
                f"date_start ({self.date_start}) must be <= date_end ({self.date_end})"
            )
        if self.domains is not None:
            for label, vals, allowed in (
                ("practice", self.practices, self.domains.practices),
                ("level", self.levels, self.domains.levels),
                ("location", self.locations, self.domains.locations),
            ):
                for v in vals:
                    if v not in allowed:
                        raise ValueError(f"Invalid {label}: {v!r}")

    @classmethod
    def from_dict(cls, d: dict, domains: Domains | None = None) -> "Filters":
        return cls(
            date_start=d["date_start"], date_end=d["date_end"],
            practices=tuple(d.get("practices") or ()), levels=tuple(d.get("levels") or ()),
            locations=tuple(d.get("locations") or ()),
            domains=Domains() if domains is None else domains,
        )

    # ---- predicates -------------------------------------------------------------------
    def date_predicate(self, df: DataFrame, ts_col: str = "timestamp"):
        """CAST(ts AS DATE) BETWEEN start AND end.  Catalyst turns it into a
        timestamp range that reaches the Parquet scan; on curated tables the same
        range on ``event_date`` prunes partitions."""
        cond = F.lit(True)
        for day in [event_day(ts_col)] + [F.col(c) for c in df.columns if c == "event_date"]:
            if self.date_start is not None:
                cond = cond & (day >= F.lit(self.date_start))
            if self.date_end is not None:
                cond = cond & (day <= F.lit(self.date_end))
        return cond

    def employee_predicate(self):
        """D2-D4 on the dimension side (None when no list is set)."""
        cond = None
        for col, vals in (("practice", self.practices), ("level", self.levels),
                          ("location", self.locations)):
            if vals:
                c = F.col(col).isin(list(vals))
                cond = c if cond is None else cond & c
        return cond


def invalid_values(filters: Filters, employees: DataFrame) -> DataFrame:
    """D5 against the directory itself: (field, value) for every requested practice,
    level or location that no employee has.  An anti-join; nothing reaches the driver."""
    asked = [(field, v) for field, vals in (("practice", filters.practices), ("level", filters.levels),
                                            ("location", filters.locations)) for v in vals]
    wanted = employees.sparkSession.createDataFrame(asked, "field string, value string").distinct()
    known = employees.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("practice", "level", "location")
    ])).alias("kv")).select("kv.*").distinct()
    return wanted.join(known, ["field", "value"], "left_anti")


def filtered_fact(tables, fact: str | DataFrame, filters: Filters,
                  ts_col: str = "timestamp",
                  employee_cols: Iterable[str] = ("practice", "level", "location",
                                                  "full_name", "email")) -> DataFrame:
    """D1-D4 + J1: the fact rows in range whose user is in the (filtered) directory.

    Events of users missing from ``employees`` drop out, filter or not (inner join).
    The dimension is filtered before the join and broadcast only under the row bound.
    """
    df = tables.fact(fact) if isinstance(fact, str) else fact
    df = df.where(filters.date_predicate(df, ts_col))
    emp = tables.employees
    pred = filters.employee_predicate()
    if pred is not None:
        emp = emp.where(pred)
    keep = ["email"] + [c for c in employee_cols if c != "email"]
    emp = tables.dimension(emp.select(*keep))
    return df.join(emp, df["user_email"] == emp["email"], "inner")
