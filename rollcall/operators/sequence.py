"""Per-user sequences: channel switches and sessions.

Both need each sample's predecessor in the same user's history (LAG over
``ts, snapshot_id, id``).  A window partitioned by user alone would put one
user's whole history in one task, so the history is cut into time slices and
summarized upwards.  The summary of a contiguous stretch of samples, a *run*,
is its count, its first and last sample, and the session starts and switches
inside it; two neighbouring runs join to one by comparing the end of the first
with the start of the second.  So:

1. one shuffle on ``(client_uid, slice)``: LAG inside each slice, one run per slice;
2. if a slice is shorter than a day, one shuffle of these runs on ``(client_uid, day)``;
3. one shuffle of the days' runs (users x days rows) on ``client_uid``.

The result is exactly the LAG over the full history.  A window partition holds
one user's rows of one slice, one day's slices, or one row per day, however much
history a user has.  A slice is ``slice_polls`` polls, fewer where the polls are
so large that one identity could have more than ``SLICE_ROWS`` rows in it.
Slices never cross UTC midnight.  The days' runs can be kept as a table
(:mod:`rollcall.operators.summaries`); then only days without one are read from the facts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions.columns import latest, round2
from rollcall.tables import Presence, TimeRange, check_limit

SLICE_POLLS = 120          # 1 h at 30 s polls
SLICE_ROWS = 1 << 15       # rows that a slice of one identity may hold (one poll is never split)
DAY_S = 86400
_ORDER = ("ts", "snapshot_id", "id")


def slice_length_s(poll_interval_s: int, slice_polls: int = SLICE_POLLS) -> int:
    return min(max(1, int(slice_polls)) * int(poll_interval_s), DAY_S)


def slice_id(ts: Column, slice_s: int) -> Column:
    """Slice number, increasing with time; each UTC day has ``ceil(86400 / slice_s)`` slices."""
    per_day = -(-DAY_S // slice_s)
    day = F.floor(ts / F.lit(DAY_S))
    return (day * per_day + F.floor((ts - day * DAY_S) / F.lit(slice_s))).cast("long")


def slice_day(slice_col: Column, slice_s: int) -> Column:
    """Day number (days since 1970-01-01, UTC) of a slice."""
    per_day = -(-DAY_S // slice_s)
    return F.floor(slice_col / F.lit(per_day)).cast("long")


def slice_polls_for(pr: Presence, slice_polls: int = SLICE_POLLS) -> int:
    """``slice_polls``, or fewer where the largest poll is so large that a slice could hold more than SLICE_ROWS rows."""
    largest = pr.memo("largest_poll", lambda: pr.snapshots.agg(F.max("total_clients")).first()[0]) or 0
    return max(1, min(int(slice_polls), SLICE_ROWS // max(1, int(largest))))


@dataclass(frozen=True)
class Kept:
    """A value that a run keeps beside the sequence columns: how it comes from rows and from smaller runs."""
    name: str
    source: str
    of_rows: str        # count | sum | max | last | true | set
    of_runs: str        # sum | max | last | set

    def from_rows(self) -> Column:
        c = F.col(self.source)
        value = {"count": lambda: F.count(c), "sum": lambda: F.sum(c), "max": lambda: F.max(c), "last": lambda: on_last(self.source),
                 "true": lambda: F.count_if(c), "set": lambda: F.sort_array(F.collect_set(c))}[self.of_rows]()
        return value.alias(self.name)

    def from_runs(self) -> Column:
        c = F.col(self.name)
        value = {"sum": lambda: F.sum(c), "max": lambda: F.max(c), "last": lambda: on_last(self.name),
                 "set": lambda: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c))))}[self.of_runs]()
        return value.alias(self.name)


def _sliced_rows(cs: DataFrame, p: int, slice_s: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows with in-slice predecessor flags.

    ``_start`` (gap > 2p) and ``_switch`` (channel changed) compare with the
    previous row of the slice; ``_first`` / ``_last`` mark the slice's first
    and last rows, so per-slice first/last values are plain conditional
    aggregates (fixed-width, no arg-max over structs).
    """
    w = Window.partitionBy("client_uid", "_slice").orderBy(*_ORDER)
    cols = ["client_uid", "ts", "snapshot_id", "id", "channel_id", *[c for c in extra if c != "channel_id"]]
    rows = cs.select(*cols, slice_id(F.col("ts"), slice_s).alias("_slice"))
    prev_ts = F.lag("ts").over(w)
    prev_ch = F.lag("channel_id").over(w)
    return (rows
            .withColumn("_first", prev_ts.isNull())
            .withColumn("_last", F.lead("id").over(w).isNull())
            .withColumn("_start", F.when(prev_ts.isNotNull() & ((F.col("ts") - prev_ts) > 2 * p), 1).otherwise(0))
            .withColumn("_switch", F.when(prev_ch.isNotNull() & (F.col("channel_id") != prev_ch), 1).otherwise(0)))


def on_first(col: str) -> Column:
    """Value of ``col`` on the first row or run of the group (an aggregate)."""
    return F.max(F.when(F.col("_first"), F.col(col)))


def on_last(col: str) -> Column:
    """Value of ``col`` on the last row or run of the group (an aggregate)."""
    return F.max(F.when(F.col("_last"), F.col(col)))


def _compared(runs: DataFrame, keys: list[str], order: str, p: int) -> DataFrame:
    """Runs compared with the one before: ``_b_start`` / ``_b_switch`` are what their meeting adds (nothing for the first)."""
    w = Window.partitionBy(*keys).orderBy(order)
    prev_ts, prev_ch = F.lag("_last_ts").over(w), F.lag("_last_ch").over(w)
    return (runs.withColumn("_first", prev_ts.isNull())
            .withColumn("_last", F.lead(order).over(w).isNull())
            .withColumn("_b_start", F.when((F.col("_first_ts") - prev_ts) > 2 * p, 1).otherwise(0))
            .withColumn("_b_switch", F.when(F.col("_first_ch") != prev_ch, 1).otherwise(0)))


def day_runs(cs: DataFrame, p: int, slice_polls: int = SLICE_POLLS, kept: tuple[Kept, ...] = ()) -> DataFrame:
    """One run per (client_uid, ``_day``): ``_n``, first and last time and channel, ``_starts`` and ``_switches``
    inside the day (its first sample starts nothing), and the ``kept`` values."""
    slice_s = slice_length_s(p, slice_polls)
    rows = _sliced_rows(cs, p, slice_s, tuple(dict.fromkeys(k.source for k in kept)))
    runs = (rows.groupBy("client_uid", "_slice")
            .agg(F.count(F.lit(1)).alias("_n"),
                 F.min("ts").alias("_first_ts"),
                 F.max("ts").alias("_last_ts"),
                 on_first("channel_id").alias("_first_ch"),
                 on_last("channel_id").alias("_last_ch"),
                 F.sum("_start").alias("_starts"),
                 F.sum("_switch").alias("_switches"),
                 *[k.from_rows() for k in kept])
            .withColumn("_day", slice_day(F.col("_slice"), slice_s)))
    if slice_s >= DAY_S:
        return runs.drop("_slice")
    return (_compared(runs, ["client_uid", "_day"], "_slice", p).groupBy("client_uid", "_day")
            .agg(F.sum("_n").alias("_n"),
                 F.min("_first_ts").alias("_first_ts"),
                 F.max("_last_ts").alias("_last_ts"),
                 on_first("_first_ch").alias("_first_ch"),
                 on_last("_last_ch").alias("_last_ch"),
                 F.sum(F.col("_starts") + F.col("_b_start")).alias("_starts"),
                 F.sum(F.col("_switches") + F.col("_b_switch")).alias("_switches"),
                 *[k.from_runs() for k in kept]))


def user_totals(runs: DataFrame, p: int, extra_user_aggs: list[Column] | None = None) -> DataFrame:
    """Per user from the days' runs: samples, sessions, switches, days, first/last seen."""
    return (_compared(runs, ["client_uid"], "_day", p).groupBy("client_uid")
            .agg(F.sum("_n").cast("long").alias("total_samples"),
                 (F.sum(F.col("_starts") + F.col("_b_start")) + 1).cast("long").alias("session_count"),
                 F.sum(F.col("_switches") + F.col("_b_switch")).cast("long").alias("channel_switches"),
                 F.count(F.lit(1)).alias("days_active"),
                 F.min("_first_ts").alias("first_seen"),
                 F.max("_last_ts").alias("last_seen"),
                 *(extra_user_aggs or [])))


def runs_in(pr: Presence, rng: TimeRange, slice_polls: int = SLICE_POLLS, kept: tuple[Kept, ...] = ()) -> DataFrame:
    """The days' runs of a range: kept days from their summaries, the other days from the facts."""
    from rollcall.operators import summaries

    days, facts = summaries.split(pr, rng)
    fresh = None if facts is None else day_runs(facts, pr.poll_interval_s, slice_polls_for(pr, slice_polls), kept)
    if not days:
        return fresh
    stored = summaries.stored_runs(pr, days).select(*summaries.RUN_COLUMNS, *[k.name for k in kept])
    return stored if fresh is None else stored.unionByName(fresh)


def sequence_metrics(cs: DataFrame, p: int, slice_polls: int = SLICE_POLLS) -> DataFrame:
    """Per user of the given rows: ``total_samples``, ``session_count``, ``channel_switches``, days, first/last seen."""
    return user_totals(day_runs(cs, p, slice_polls), p)


def with_latest(winners: DataFrame, rows: DataFrame, *columns: str, seen: str = "last_seen") -> DataFrame:
    """Adds ``columns`` of each user's latest row by ``(ts, snapshot_id, id)``.

    The rows were ranked with fixed-width values; only the winners' rows at
    their last time are read for the text.
    """
    values = [c for c in winners.columns if c != "client_uid"]
    texts = rows.select("client_uid", F.col("ts").alias("_ts"), "snapshot_id", "id", *columns)
    found = texts.join(winners.withColumn("_ts", F.col(seen)), ["client_uid", "_ts"])
    return found.groupBy("client_uid").agg(*[F.any_value(c).alias(c) for c in values],      # the same in all rows of a user
                                           *[latest(c, ("_ts", "snapshot_id", "id")).alias(c) for c in columns])


def channel_switches(pr: Presence, days: int | None = 7, limit: int = 10,
                     slice_polls: int = SLICE_POLLS, as_of: int | None = None) -> DataFrame:
    """Users who change channel most between consecutive samples.

    The first sample in the range has no predecessor; a change across an
    offline gap counts; a user seen twice in one poll is ordered by row id.
    """
    check_limit(limit)
    p = pr.poll_interval_s
    rng = pr.time_range(days, as_of)
    m = user_totals(runs_in(pr, rng, slice_polls, (LAST_NICKNAME,)), p, [F.max_by("_nick_last", "_day").alias("nickname")])
    hours = F.col("total_samples") * p / 3600.0
    return (m.filter(F.col("channel_switches") > 0)
            .select("client_uid", "nickname", "total_samples", "channel_switches",
                    round2(F.col("channel_switches") / hours).alias("switches_per_hour"))
            .orderBy(F.desc("channel_switches"), F.asc("client_uid"))
            .limit(limit))


def session_counts(pr: Presence, days: int | None = 7, limit: int = 10,
                   slice_polls: int = SLICE_POLLS, as_of: int | None = None) -> DataFrame:
    """Users with the most sessions (a gap over two poll intervals starts one)."""
    check_limit(limit)
    p = pr.poll_interval_s
    rng = pr.time_range(days, as_of)
    m = user_totals(runs_in(pr, rng, slice_polls, (LAST_NICKNAME,)), p, [F.max_by("_nick_last", "_day").alias("nickname")])
    per_session = F.col("total_samples").cast("double") / F.col("session_count")
    return (m.select("client_uid", "nickname", "session_count",
                     round2(per_session * p / 60.0).alias("avg_session_length_minutes"))
            .orderBy(F.desc("session_count"), F.asc("client_uid"))
            .limit(limit))


# the nickname of a run's last sample
LAST_NICKNAME = Kept("_nick_last", "nickname", "last", "last")


def connection_summary(pr: Presence, days: int | None = 7, as_of: int | None = None) -> DataFrame:
    """Distinct users and their mean online hours; one row."""
    from rollcall.operators import summaries

    p = pr.poll_interval_s
    per_user = summaries.user_rows(pr, pr.time_range(days, as_of)).groupBy("client_uid").agg(F.sum("n").alias("n"))
    return per_user.agg(
        F.count(F.lit(1)).alias("total_users"),
        F.coalesce(round2(F.avg("n") * p / 3600.0), F.lit(0.0)).alias("avg_online_time_hours"))


def day_pieces(cs: DataFrame, p: int, slice_polls: int = SLICE_POLLS) -> DataFrame:
    """(client_uid, _day, start_ts, end_ts, n): each day's stretches of samples without a gap over two intervals.

    Stretches are cut inside each slice, then joined over the slices of the day.
    """
    slice_s = slice_length_s(p, slice_polls)
    rows = _sliced_rows(cs, p, slice_s)
    w_run = (Window.partitionBy("client_uid", "_slice").orderBy(*_ORDER)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    pieces = (rows.withColumn("_local", F.sum("_start").over(w_run))
              .groupBy("client_uid", "_slice", "_local")
              .agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("n"))
              .withColumn("_day", slice_day(F.col("_slice"), slice_s)))
    if slice_s >= DAY_S:
        return pieces.drop("_slice", "_local")
    return joined_pieces(pieces, p)


def joined_pieces(pieces: DataFrame, p: int) -> DataFrame:
    """Pieces of each (client_uid, _day) joined where they overlap or no gap over two intervals lies between them."""
    w_day = Window.partitionBy("client_uid", "_day").orderBy("start_ts", "end_ts")
    reached = F.max("end_ts").over(w_day.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reached.isNull() | ((F.col("start_ts") - reached) > 2 * p), 1).otherwise(0)
    return (pieces.withColumn("_new", new)
            .withColumn("_piece", F.sum("_new").over(w_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            .groupBy("client_uid", "_day", "_piece")
            .agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("n").alias("n")).drop("_piece"))


def numbered_sessions(pieces: DataFrame, p: int) -> DataFrame:
    """(client_uid, session_no, session_start, session_end, samples) from the days' pieces, numbered from 1 per user.

    A prefix sum in three steps, none of which holds all of a user's pieces: the
    pieces of a day are numbered within the day; each day's number of pieces and its first and last time
    (one row per user and day) give the days' offsets, where a day's first piece may go on
    with the session of the day before; offset and number make the session's number.
    """
    w_day = Window.partitionBy("client_uid", "_day").orderBy("start_ts")
    local = pieces.withColumn("_no", F.row_number().over(w_day))
    days = (pieces.groupBy("client_uid", "_day")
            .agg(F.count(F.lit(1)).alias("_pieces"), F.min("start_ts").alias("_from"), F.max("end_ts").alias("_to")))
    w_user = Window.partitionBy("client_uid").orderBy("_day")
    goes_on = F.coalesce((F.col("_from") - F.lag("_to").over(w_user)) <= 2 * p, F.lit(False)).cast("long")
    offsets = (days.withColumn("_goes_on", goes_on)
               .withColumn("_upto", F.sum(F.col("_pieces") - F.col("_goes_on")).over(
                   w_user.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
               # the number of the day's first piece, less one
               .select("client_uid", "_day", (F.col("_upto") - F.col("_pieces")).alias("_before")))
    return (local.join(offsets, ["client_uid", "_day"])
            .groupBy("client_uid", (F.col("_before") + F.col("_no")).cast("long").alias("session_no"))
            .agg(F.min("start_ts").alias("session_start"), F.max("end_ts").alias("session_end"),
                 F.sum("n").cast("long").alias("samples")))


def sessions(pr: Presence, days: int | None = 7, slice_polls: int = SLICE_POLLS,
             as_of: int | None = None) -> DataFrame:
    """One row per session: number (from 1, per user), start, end, samples.  Kept days come from their summaries."""
    from rollcall.operators import summaries

    p = pr.poll_interval_s
    kept_days, facts = summaries.split(pr, pr.time_range(days, as_of))
    pieces = None if facts is None else day_pieces(facts, p, slice_polls_for(pr, slice_polls))
    if kept_days:
        stored = summaries.stored_pieces(pr, kept_days)
        pieces = stored if pieces is None else stored.unionByName(pieces.select(*stored.columns))
    return numbered_sessions(pieces, p)
