"""UTC time buckets over integer epoch seconds.

Hour, weekday, date and the ISO text are integer arithmetic on the epoch
seconds, so they do not depend on the session time zone.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday names indexed 0 = Sunday .. 6 = Saturday.
DAY_NAMES = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


DAY_S = 86400
EPOCH_WEEKDAY = 4  # 1970-01-01 was a Thursday (0 = Sunday)


def utc_timestamp(ts: str | Column = "ts") -> Column:
    """Epoch seconds as a TIMESTAMP (an instant; event-time windows and watermarks use it)."""
    return F.timestamp_seconds(_c(ts))


def _days(ts: str | Column) -> Column:
    return F.floor(_c(ts) / F.lit(DAY_S))


def hour_utc(ts: str | Column = "ts") -> Column:
    return F.pmod(F.floor(_c(ts) / F.lit(3600)), F.lit(24)).cast("int")


def weekday_sun0(ts: str | Column = "ts") -> Column:
    """0 = Sunday .. 6 = Saturday."""
    return F.pmod(_days(ts) + EPOCH_WEEKDAY, F.lit(7)).cast("int")


def utc_date(ts: str | Column = "ts") -> Column:
    return F.date_from_unix_date(_days(ts).cast("int"))


def utc_day(ts: int) -> _dt.date:
    """The UTC day of epoch seconds."""
    return _dt.datetime.fromtimestamp(int(ts), _dt.timezone.utc).date()


def day_bounds(date: str) -> tuple[int, int]:
    """``YYYY-MM-DD`` to the epoch seconds of its midnight (UTC) and of the next one."""
    day = _dt.datetime.strptime(date, "%Y-%m-%d").replace(tzinfo=_dt.timezone.utc)
    start = int(day.timestamp())
    return start, start + DAY_S


def midnight_of(date: str | Column) -> Column:
    """Date text ``YYYY-MM-DD`` to the epoch seconds of its midnight (UTC); other text to NULL."""
    text = F.when(_c(date).rlike(r"^\d{4}-\d{2}-\d{2}$"), _c(date))
    return F.unix_date(text.try_cast("date")).cast("long") * DAY_S


def next_midnight_of(date: str | Column) -> Column:
    """Date text ``YYYY-MM-DD`` to the epoch seconds of the next day's midnight (UTC)."""
    return midnight_of(date) + DAY_S


def day_name(dow: str | Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in DAY_NAMES]), _c(dow) + 1)


def _clock(ts: str | Column) -> Column:
    """``HH:mm:ss`` of the UTC time of day."""
    secs = F.pmod(_c(ts), F.lit(DAY_S))
    parts = [F.floor(secs / 3600), F.floor(F.pmod(secs, F.lit(3600)) / 60), F.pmod(secs, F.lit(60))]
    padded = [F.lpad(x.cast("string"), 2, "0") for x in parts]
    return F.concat_ws(":", *padded)


def iso_datetime(ts: str | Column = "ts") -> Column:
    """``YYYY-MM-DDTHH:MM:SS`` (UTC)."""
    return F.concat(utc_date(ts).cast("string"), F.lit("T"), _clock(ts))


def datetime_text(ts: str | Column = "ts") -> Column:
    """``YYYY-MM-DD HH:MM:SS`` (UTC)."""
    return F.concat(utc_date(ts).cast("string"), F.lit(" "), _clock(ts))


def duration_text(hours: str | Column) -> Column:
    """Duration label from hours: ``<minutes>m`` under an hour, ``<h.h>h`` under a
    day, else ``<d.d>d``; rounded like Python's number formatting."""
    from rollcall.functions.columns import round_half_even_exact

    h = _c(hours).cast("double")
    return (F.when(h < 1, F.format_string("%.0fm", round_half_even_exact(h * 60, 0)))
            .when(h < 24, F.format_string("%.1fh", round_half_even_exact(h, 1)))
            .otherwise(F.format_string("%.1fd", round_half_even_exact(h / 24, 1))))
