"""Command line: run one question over presence tables and print or write the result.

    python -m rollcall.cli TABLE_ROOT QUESTION [--days N] [--limit N] [--as-of EPOCH]
                           [--poll-interval S [--any-interval]] [--uid UID] [--date YYYY-MM-DD]
                           [--out PATH --format json|parquet|csv]

``TABLE_ROOT`` holds ``snapshots/``, ``clients/`` and ``channels/`` as written by
:func:`rollcall.sources.parquet.write_presence`.  Without ``--out`` every
row is printed as a line of JSON.  Questions of several parts (``overview``, ``away-stats``, ``user-report`` ...) print
or write each part under its name.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.operators import channels, load, ltv, maintenance, metrics, reports, rollup, sequence, status, users
from rollcall.session import build_session
from rollcall.sources.parquet import load_presence
from rollcall.tables import DEFAULT_POLL_INTERVAL_S, Presence

UNSET = object()


def _d(a, default):
    return default if a.days is UNSET else a.days


def _l(a, default):
    return default if a.limit is None else a.limit


# question -> builder(presence, args)
QUESTIONS = {
    "top-users": lambda pr, a: users.top_users(pr, _d(a, 7), _l(a, 10), a.as_of),
    "user-stats": lambda pr, a: users.user_stats(pr, a.uid, _d(a, 30), a.as_of),
    "user-profile": lambda pr, a: users.user_profile(pr, a.uid, _d(a, 30), a.as_of),
    "favorite-channels": lambda pr, a: users.favorite_channels(pr, a.uid, _d(a, 30), 5, a.as_of),
    "weekday-activity": lambda pr, a: users.user_weekday_activity(pr, a.uid, _d(a, 30), a.as_of),
    "hourly-heatmap": lambda pr, a: load.relative_load(load.hourly_heatmap(pr, _d(a, 7), a.as_of)),
    "daily-activity": lambda pr, a: load.relative_load(load.daily_activity(pr, _d(a, 30), a.as_of)),
    "idle-users": lambda pr, a: users.top_idle_users(pr, _d(a, 7), _l(a, 10), as_of=a.as_of),
    "peak-times": lambda pr, a: load.peak_times(pr, _d(a, 7), _l(a, 10), a.as_of),
    "channel-stats": lambda pr, a: channels.channel_stats(pr, _d(a, 7), a.as_of),
    "growth": lambda pr, a: users.growth_metrics(pr, _d(a, 7), a.as_of),
    "online-now": lambda pr, a: status.online_now(pr),
    "active-now": lambda pr, a: status.active_now(pr),
    "summary": lambda pr, a: load.summary(pr, _d(a, 7), a.as_of),
    "db-stats": lambda pr, a: load.dataset_stats(pr),
    "away-summary": lambda pr, a: status.away_summary(pr, _d(a, 7), a.as_of),
    "away-users": lambda pr, a: status.top_away_users(pr, _d(a, 7), _l(a, 10), as_of=a.as_of),
    "mute-summary": lambda pr, a: status.mute_summary(pr, _d(a, 7), a.as_of),
    "recorders": lambda pr, a: users.top_recorders(pr, _d(a, 7), _l(a, 10), a.as_of),
    "server-groups": lambda pr, a: channels.server_group_stats(pr, _d(a, 7), a.exact, a.as_of),
    "channel-switches": lambda pr, a: sequence.channel_switches(pr, _d(a, 7), _l(a, 10), as_of=a.as_of),
    "reconnectors": lambda pr, a: sequence.session_counts(pr, _d(a, 7), _l(a, 10), as_of=a.as_of),
    "connection-summary": lambda pr, a: sequence.connection_summary(pr, _d(a, 7), a.as_of),
    "sessions": lambda pr, a: sequence.sessions(pr, _d(a, 7), as_of=a.as_of),
    "ltv": lambda pr, a: ltv.lifetime_value(pr, _d(a, None), _l(a, 50), as_of=a.as_of),
    "ltv-summary": lambda pr, a: ltv.ltv_summary(pr, _d(a, None), as_of=a.as_of),
    "channels": lambda pr, a: channels.list_channels(pr),
    "daily-rollup": lambda pr, a: rollup.rollup_of_day(pr, a.date) if a.date else rollup.rollup_previous_day(pr, a.as_of),
    "retention": lambda pr, a: maintenance.retention_report(pr, _d(a, 30), a.as_of),
    "metrics": lambda pr, a: metrics.metrics_snapshot(pr, _d(a, 7), a.as_of),
}


# question -> builder(presence, args) of several named frames
REPORTS = {
    "away-stats": lambda pr, a: reports.away_stats(pr, _d(a, 7), _l(a, 10), a.as_of),
    "mute-stats": lambda pr, a: reports.mute_stats(pr, _d(a, 7), _l(a, 10), a.as_of),
    "connection-patterns": lambda pr, a: reports.connection_patterns(pr, _d(a, 7), _l(a, 10), a.as_of),
    "user-report": lambda pr, a: reports.user_report(pr, a.uid, _d(a, 30), a.as_of),
    "overview": lambda pr, a: reports.overview(pr, _d(a, 7), a.as_of),
    "growth-report": lambda pr, a: reports.growth(pr, _d(a, 7), a.as_of),
    "engagement": lambda pr, a: reports.engagement(pr, _d(a, None), _l(a, 50), a.as_of),
}
# fixed: what the interface accepts; the library itself takes any limit and interval
LIMIT, SCORE_LIMIT, INTERVALS = 100, 500, (10, 3600)
SCORE_QUESTIONS = ("ltv", "engagement")
ROLLUP_INTERVAL_S = 60      # of the daily rollup, where no interval is given


def checked(args: argparse.Namespace) -> argparse.Namespace:
    """Bounds of the parameters; fills in the interval."""
    most = SCORE_LIMIT if args.question in SCORE_QUESTIONS else LIMIT
    if args.limit is not None and not 1 <= args.limit <= most:
        raise ValueError(f"limit must be within 1..{most}")
    if args.poll_interval is None:
        args.poll_interval = ROLLUP_INTERVAL_S if args.question == "daily-rollup" else DEFAULT_POLL_INTERVAL_S
    elif not INTERVALS[0] <= args.poll_interval <= INTERVALS[1] and not args.any_interval:
        raise ValueError(f"the poll interval must be within {INTERVALS[0]}..{INTERVALS[1]} s (see --any-interval)")
    if args.question in ("user-stats", "user-report") and not args.uid:
        raise ValueError(f"{args.question} needs --uid")
    return args


def _days(text: str):
    return None if text.lower() in ("all", "none") else int(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rollcall", description=__doc__.splitlines()[0])
    p.add_argument("tables")
    p.add_argument("question", choices=sorted({*QUESTIONS, *REPORTS}))
    p.add_argument("--days", type=_days, default=UNSET, help="look-back days, or 'all'")
    p.add_argument("--limit", type=int)
    p.add_argument("--as-of", type=int, dest="as_of", help="end of the range (epoch s); default: last poll")
    p.add_argument("--poll-interval", type=int, dest="poll_interval", help="seconds, 10 to 3600; default 30 (daily rollup 60)")
    p.add_argument("--any-interval", action="store_true", dest="any_interval", help="accept intervals outside these bounds")
    p.add_argument("--uid")
    p.add_argument("--date", help="day of the rollup, YYYY-MM-DD; default: the day before the last poll")
    p.add_argument("--exact", action="store_true", help="server groups: count each member once")
    p.add_argument("--out")
    p.add_argument("--format", default="json", choices=("json", "parquet", "csv"))
    p.add_argument("--master")
    return p


def write_result(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Result sets are small or partitioned DataFrames; written like any table."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", "true")
    getattr(writer, fmt)(path)


def print_result(df: DataFrame) -> None:
    """Every row as a line of JSON, fetched partition by partition."""
    for row in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator():
        print(row[0])


def run(argv: list[str]) -> DataFrame | dict[str, DataFrame]:
    args = checked(parser().parse_args(argv))
    spark = build_session(args.master, app=f"rollcall {args.question}")
    pr: Presence = load_presence(spark, args.tables, args.poll_interval)
    if args.question in REPORTS:
        parts = REPORTS[args.question](pr, args)
        for name, part in parts.items():
            if args.out:
                write_result(part, f"{args.out}/{name}", args.format)
            else:
                print(f"# {name}")
                print_result(part)
        return parts
    df = QUESTIONS[args.question](pr, args)
    if args.out:
        write_result(df, args.out, args.format)
    else:
        print_result(df)
    return df


if __name__ == "__main__":
    run(sys.argv[1:])
