"""The presence tables and the look-back range every operator filters by."""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_POLL_INTERVAL_S = 30
DAY_S = 86400


@dataclass(frozen=True)
class TimeRange:
    """Inclusive epoch-second range ``t0 <= ts <= t1``.

    ``days=None`` means all time (``t0 = 0``).  ``t1`` is the ``as_of`` instant,
    an explicit literal so that the range reaches the parquet scan as a pushed
    filter and prunes ``event_date`` partitions.
    """

    t0: int
    t1: int

    @classmethod
    def lookback(cls, as_of: int, days: int | None) -> "TimeRange":
        if days is not None and days < 0:
            raise ValueError("days must be >= 0 or None")
        t0 = 0 if days is None else int(as_of) - int(days) * DAY_S
        return cls(t0, int(as_of))

    def contains(self, ts: str | Column = "ts") -> Column:
        col = F.col(ts) if isinstance(ts, str) else ts
        return col.between(F.lit(self.t0), F.lit(self.t1))

    def date_bounds(self) -> tuple[_dt.date, _dt.date]:
        lo = _dt.datetime.fromtimestamp(max(self.t0, 0), _dt.timezone.utc).date()
        hi = _dt.datetime.fromtimestamp(max(self.t1, 0), _dt.timezone.utc).date()
        return lo, hi

    def predicate(self, df: DataFrame, ts: str = "ts",
                  date_col: str = "event_date") -> Column:
        """Range predicate plus the implied partition predicate on the date."""
        cond = self.contains(ts)
        if date_col in df.columns:
            lo, hi = self.date_bounds()
            cond = cond & F.col(date_col).between(F.lit(lo), F.lit(hi))
        return cond


@dataclass(frozen=True)
class Presence:
    """Snapshots, client rows and the channel dimension.

    ``clients`` carries ``ts`` and ``event_date`` of its snapshot, so time
    filters need no join; rows whose snapshot is missing are removed by
    :meth:`committed_clients` where that can happen (streamed appends).
    ``first_seen`` (``client_uid, first_ts``), when given, is the all-time
    first sample per user kept next to the facts, so questions about all
    history (growth, distinct users) read it instead of every client row.
    ``summaries`` (:class:`rollcall.operators.summaries.Summaries`), when given,
    holds finished days in summarized form for the per-user questions.
    """

    snapshots: DataFrame
    clients: DataFrame
    channels: DataFrame
    poll_interval_s: int = DEFAULT_POLL_INTERVAL_S
    first_seen: DataFrame | None = None
    summaries: object | None = None
    _memo: dict = field(init=False, repr=False, compare=False, default=None)

    def __post_init__(self):
        if not 1 <= int(self.poll_interval_s) <= 86400:
            raise ValueError("poll_interval_s out of range")
        object.__setattr__(self, "_memo", {})

    def memo(self, key: str, compute):
        """Scalars about these tables (latest poll, dimension size) computed once."""
        if key not in self._memo:
            self._memo[key] = compute()
        return self._memo[key]

    @property
    def spark(self) -> SparkSession:
        return self.snapshots.sparkSession

    def with_interval(self, poll_interval_s: int) -> "Presence":
        return replace(self, poll_interval_s=poll_interval_s)

    # -- time range -------------------------------------------------------
    def latest_poll(self) -> tuple[int | None, int | None, _dt.date | None]:
        """``(ts, snapshot_id, event_date)`` of the latest poll.

        One scalar action over the poll table (one row per poll, so it grows
        with time, not with clients), computed once per table set.
        """
        def compute():
            row = (self.snapshots
                   .agg(F.max_by(F.struct("ts", "snapshot_id", "event_date"), "snapshot_id").alias("m"))
                   .first())
            m = None if row is None else row["m"]
            return (None, None, None) if m is None else (int(m["ts"]), int(m["snapshot_id"]), m["event_date"])
        return self.memo("latest_poll", compute)

    def latest_ts(self) -> int | None:
        """Largest snapshot time (``as_of`` default), also where ids do not follow the time."""
        return self.memo("latest_ts", lambda: self.snapshots.agg(F.max("ts")).first()[0])

    def time_range(self, days: int | None, as_of: int | None = None) -> TimeRange:
        if as_of is None:
            as_of = self.latest_ts()
            if as_of is None:
                as_of = 0
        return TimeRange.lookback(as_of, days)

    def clients_in(self, rng: TimeRange) -> DataFrame:
        return self.clients.filter(rng.predicate(self.clients))

    def snapshots_in(self, rng: TimeRange) -> DataFrame:
        return self.snapshots.filter(rng.predicate(self.snapshots))

    def committed_clients(self) -> DataFrame:
        """Client rows whose snapshot row exists (drops orphans / torn appends)."""
        return self.clients.join(self.snapshots.select("snapshot_id"), "snapshot_id", "left_semi")


def check_limit(limit: int) -> int:
    """A ranking has at least one row; how many may be asked for is the interface's business (see the command line)."""
    if int(limit) < 1:
        raise ValueError("limit must be at least 1")
    return int(limit)
