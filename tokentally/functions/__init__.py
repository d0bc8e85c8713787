from tokentally.functions.columns import (  # noqa: F401
    event_day,
    hour_of_day,
    level_rank,
    minutes_between,
    parse_utc_timestamp,
    safe_ratio,
    weekday_name,
    weekday_rank,
)
