"""Column expressions shared by the operators (all built-in, JVM-side)."""

from rollcall.functions.columns import (
    CHANNEL_LABEL_PREFIX, ROW_ORDER, channel_label, flag_value, latest, pct, round2, round_half_even_exact,
    safe_div, split_groups, trim_groups,
)
from rollcall.functions.time import (
    DAY_NAMES, datetime_text, day_name, duration_text, hour_utc, iso_datetime, utc_date, utc_timestamp,
    weekday_sun0,
)

__all__ = [
    "CHANNEL_LABEL_PREFIX", "ROW_ORDER", "channel_label", "flag_value", "latest", "pct", "round2",
    "round_half_even_exact", "safe_div", "split_groups", "trim_groups",
    "DAY_NAMES", "datetime_text", "day_name", "duration_text", "hour_utc", "iso_datetime", "utc_date",
    "utc_timestamp", "weekday_sun0",
]
