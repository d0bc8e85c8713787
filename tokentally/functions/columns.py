"""Column-level helpers.  All are built-in Spark expressions (codegen, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full English weekday names, Monday first (display order).
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

_ZONE_SUFFIX = r"(Z|z|[+-][0-9]{2}:?[0-9]{2})$"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def event_day(ts: str | Column) -> Column:
    """Calendar day of a UTC wall-clock timestamp."""
    return F.to_date(_col(ts))


def hour_of_day(ts: str | Column) -> Column:
    """Hour 0-23 as BIGINT (the width SQL engines give for EXTRACT(hour))."""
    return F.hour(_col(ts)).cast("bigint")


def weekday_name(ts: str | Column) -> Column:
    """Full English day name ('Monday').  ``dayname()`` would give 'Mon'."""
    return F.date_format(_col(ts), "EEEE")


def weekday_rank(day_name: str | Column) -> Column:
    """0 for Monday ... 6 for Sunday; NULL for anything else."""
    pos = F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), _col(day_name))
    return F.when(pos > 0, pos - 1).cast("int")


def level_rank(level: str | Column) -> Column:
    """Numeric part of 'L<n>' so that L10 sorts after L9 (NULL if not numeric)."""
    return _col(level).substr(2, 1 << 20).try_cast("int")


def minutes_between(start: str | Column, end: str | Column) -> Column:
    """(end - start) in minutes from whole microseconds, as DOUBLE."""
    micros = F.timestamp_diff("MICROSECOND", _col(start), _col(end))
    return micros.cast("double") / F.lit(60_000_000.0)


def safe_ratio(num: str | Column, den: str | Column, default: float | None = 0.0) -> Column:
    """num / den as DOUBLE; ``default`` when den is 0 or NULL (ANSI-safe)."""
    q = F.try_divide(_col(num).cast("double"), _col(den).cast("double"))
    return q if default is None else F.coalesce(q, F.lit(float(default)))


def parse_utc_timestamp(text: str | Column) -> Column:
    """ISO-8601 text -> TIMESTAMP_NTZ holding the UTC wall clock; NULL if unparsable.

    A zone suffix (``Z``, ``+02:00``) is honoured; text without a zone is taken
    as UTC already.  Independent of the session time zone.
    """
    s = F.trim(_col(text))
    naive = s.try_cast("timestamp_ntz")
    instant = s.try_cast("timestamp")
    naive_micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), naive)
    shift = F.unix_micros(instant) - naive_micros
    # Fast path: a trailing "Z" (the exporter's format) is UTC already.
    return F.when(s.endswith("Z") | s.endswith("z"), naive).when(
        s.rlike(_ZONE_SUFFIX),
        F.when(instant.isNotNull(), F.timestamp_add("MICROSECOND", shift, naive)),
    ).otherwise(naive)
