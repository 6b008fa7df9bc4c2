"""Composite answers: several questions that are asked together, as named DataFrames.

Each part is an ordinary lazy DataFrame; nothing is collected here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.operators import load, ltv, sequence, status, users
from rollcall.tables import Presence


def _with_period(df: DataFrame, days: int | None) -> DataFrame:
    """Echo the requested look-back (NULL for all time) next to a summary row."""
    return df.select(F.lit(days).cast("int").alias("period_days"), "*")


def away_stats(pr: Presence, days: int | None = 7, limit: int = 10,
               as_of: int | None = None) -> dict[str, DataFrame]:
    """Overall away share and the most-away users."""
    rng = pr.time_range(days, as_of)
    return {"summary": _with_period(status.away_summary(pr, days, rng.t1), days),
            "top_away_users": status.top_away_users(pr, days, limit, as_of=rng.t1)}


def mute_stats(pr: Presence, days: int | None = 7, limit: int = 10,
               as_of: int | None = None) -> dict[str, DataFrame]:
    """Mute, recording and talking shares and the users who record most."""
    rng = pr.time_range(days, as_of)
    return {"summary": _with_period(status.mute_summary(pr, days, rng.t1), days),
            "top_recorders": users.top_recorders(pr, days, limit, rng.t1)}


def connection_patterns(pr: Presence, days: int | None = 7, limit: int = 10,
                        as_of: int | None = None) -> dict[str, DataFrame]:
    """Users and mean online hours, and the users with the most sessions."""
    rng = pr.time_range(days, as_of)
    return {"summary": _with_period(sequence.connection_summary(pr, days, rng.t1), days),
            "top_reconnectors": sequence.session_counts(pr, days, limit, as_of=rng.t1)}


def user_report(pr: Presence, client_uid: str, days: int | None = 30,
                as_of: int | None = None) -> dict[str, DataFrame]:
    """One user's profile, favourite channels and weekday activity (long form)."""
    rng = pr.time_range(days, as_of)
    return {"profile": users.user_profile(pr, client_uid, days, rng.t1),
            "favorite_channels": users.favorite_channels(pr, client_uid, days, 5, rng.t1),
            "weekday_activity": users.user_weekday_activity(pr, client_uid, days, rng.t1)}


def overview(pr: Presence, days: int | None = 7, as_of: int | None = None) -> dict[str, DataFrame]:
    """Summary, load curve and peaks for one range."""
    rng = pr.time_range(days, as_of)
    return {"summary": _with_period(load.summary(pr, days, rng.t1), days),
            "hourly": load.relative_load(load.hourly_heatmap(pr, days, rng.t1)),
            "peaks": load.peak_times(pr, days, 10, rng.t1)}


def growth(pr: Presence, days: int = 7, as_of: int | None = None) -> dict[str, DataFrame]:
    """New versus returning users for the range."""
    return {"summary": _with_period(users.growth_metrics(pr, days, as_of), days)}


def engagement(pr: Presence, days: int | None = None, limit: int = 50,
               as_of: int | None = None) -> dict[str, DataFrame]:
    """Score distribution and the top-scored users."""
    rng = pr.time_range(days, as_of)
    return {"summary": _with_period(ltv.ltv_summary(pr, days, as_of=rng.t1), days),
            "top_users": ltv.lifetime_value(pr, days, limit, as_of=rng.t1)}
