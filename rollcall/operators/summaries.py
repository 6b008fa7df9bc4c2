"""Day summaries: what per-user questions need of a finished day, kept as tables.

For every UTC day small tables hold one row per user (its run, see
:mod:`rollcall.operators.sequence`, and sums), one per user and channel, one
per stretch of samples, and a sketch of the users of each channel.  All are mergeable: rows of several days combine to
what the facts of these days would give, so a question over a range
reads summaries for its whole days and facts only for the rest.

A ``days`` table records for which polls a day was summarized (their number, rows and
times, all known from the poll table).  A day counts as kept only while that
still agrees with the poll table, so a late poll makes its day be read from
the facts until the next :func:`refresh`.
"""

from __future__ import annotations

import datetime as _dt
import os
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.operators.sequence import Kept, LAST_NICKNAME, SLICE_POLLS, day_pieces, day_runs, slice_polls_for
from rollcall.tables import Presence, TimeRange

FOLDER = "summaries"
RUN_COLUMNS = ("client_uid", "_day", "_n", "_first_ts", "_last_ts", "_first_ch", "_last_ch", "_starts", "_switches")
TOTALS = (LAST_NICKNAME, Kept("_nick_max", "nickname", "max", "max"), Kept("_talk", "is_talking", "true", "sum"),
          Kept("_recording", "is_recording", "true", "sum"), Kept("_idle_sum", "idle_ms", "sum", "sum"),
          Kept("_idle_n", "idle_ms", "count", "sum"))
_POLLS = ("polls", "rows", "first_ts", "last_ts", "times")


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S, _L = T.StringType(), T.LongType()
SCHEMAS = {
    "runs": _schema(client_uid=_S, _day=_L, _n=_L, _first_ts=_L, _last_ts=_L, _first_ch=_L, _last_ch=_L, _starts=_L, _switches=_L,
                    _nick_last=_S, _nick_max=_S, _talk=_L, _recording=_L, _idle_sum=_L, _idle_n=_L, event_date=T.DateType()),
    "channels": _schema(client_uid=_S, channel_id=_L, n=_L, idle_sum=_L, idle_n=_L, event_date=T.DateType()),
    "pieces": _schema(client_uid=_S, _day=_L, start_ts=_L, end_ts=_L, n=_L, event_date=T.DateType()),
    "users": _schema(channel_id=_L, n=_L, sketch=T.BinaryType(), event_date=T.DateType()),
    "days": _schema(polls=_L, rows=_L, first_ts=_L, last_ts=_L, times=_L, poll_interval_s=_L, event_date=T.DateType()),
}


@dataclass(frozen=True)
class Summaries:
    """The stored tables, each partitioned by ``event_date``."""
    runs: DataFrame
    channels: DataFrame
    pieces: DataFrame
    users: DataFrame
    days: DataFrame


def day_channels(cs: DataFrame) -> DataFrame:
    """(client_uid, event_date, channel_id, n, idle_sum, idle_n)."""
    return cs.groupBy("event_date", "client_uid", "channel_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("idle_ms").alias("idle_sum"), F.count("idle_ms").alias("idle_n"))


ROWS_PER_FILE = 5_000_000   # client rows of a day that make one file of its summary, at most
SKETCH_LG_K = 14     # 2**14 registers: a standard error of 0.8 %, 16 KB at most


def _sketch() -> Column:
    return F.hll_sketch_agg("client_uid", F.lit(SKETCH_LG_K)).alias("sketch")


def day_users(cs: DataFrame) -> DataFrame:
    """(event_date, channel_id, n, sketch): the samples and a HyperLogLog sketch of the users of each channel."""
    return cs.groupBy("event_date", "channel_id").agg(
        F.count(F.lit(1)).alias("n"), _sketch())


def users_in(pr: Presence, rng: TimeRange) -> DataFrame:
    """(channel_id, n, sketch) rows of a range: sketches of the kept days, and of the facts of the others."""
    days, facts = split(pr, rng)
    columns = ["channel_id", "n", "sketch"]
    fresh = None if facts is None else day_users(facts).select(columns)
    if not days:
        return fresh
    stored = _of(pr.summaries.users, days).select(columns)
    return stored if fresh is None else stored.unionByName(fresh)


def _polls_of_days(pr: Presence) -> DataFrame:
    """What the poll table says about each day; ``times`` tells polls at other times apart."""
    return pr.snapshots.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("polls"), F.sum("total_clients").cast("long").alias("rows"), F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"), F.bit_xor(F.xxhash64("snapshot_id", "ts", "total_clients")).alias("times"))


def _kept_days(pr: Presence) -> list[tuple[_dt.date, int, int]]:
    """(day, first and last poll time) of the days whose summary still agrees with the poll table (one row per day)."""
    def compute():
        if pr.summaries is None:
            return []
        kept = pr.summaries.days.filter(F.col("poll_interval_s") == F.lit(pr.poll_interval_s)).drop("poll_interval_s")
        same = _polls_of_days(pr).join(kept, ["event_date", *_POLLS], "left_semi")
        return [(r["event_date"], r["first_ts"], r["last_ts"]) for r in same.select("event_date", "first_ts", "last_ts").collect()]
    return pr.memo("kept_days", compute)


def split(pr: Presence, rng: TimeRange) -> tuple[list[_dt.date], DataFrame | None]:
    """The kept days that lie whole in the range, and the client rows of its other days (None: there are no others)."""
    days = sorted(d for d, first, last in _kept_days(pr) if first >= rng.t0 and last <= rng.t1)
    if not days:
        return [], pr.clients_in(rng)
    every = pr.memo("poll_days", lambda: {r[0] for r in pr.snapshots.select("event_date").distinct().collect()})
    lo, hi = rng.date_bounds()
    if all(d in set(days) for d in every if lo <= d <= hi):
        return days, None
    return days, pr.clients_in(rng).filter(~F.col("event_date").isin(days))


def _of(table: DataFrame, days: list[_dt.date]) -> DataFrame:
    return table.filter(F.col("event_date").between(F.lit(days[0]), F.lit(days[-1])) & F.col("event_date").isin(days)).drop("event_date")


def stored_runs(pr: Presence, days: list[_dt.date]) -> DataFrame:
    return _of(pr.summaries.runs, days)


def stored_pieces(pr: Presence, days: list[_dt.date]) -> DataFrame:
    return _of(pr.summaries.pieces, days)


def stored_channels(pr: Presence, days: list[_dt.date]) -> DataFrame:
    return _of(pr.summaries.channels, days)


def user_channel_rows(pr: Presence, rng: TimeRange) -> DataFrame:
    """(client_uid, channel_id, n, idle_sum, idle_n) rows that add up to the range, one or more per user and channel."""
    columns = ["client_uid", "channel_id", "n", "idle_sum", "idle_n"]
    days, facts = split(pr, rng)
    fresh = None if facts is None else (facts.groupBy("client_uid", "channel_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("idle_ms").alias("idle_sum"), F.count("idle_ms").alias("idle_n")))
    if not days:
        return fresh
    stored = stored_channels(pr, days).select(columns)
    return stored if fresh is None else stored.unionByName(fresh)


def user_rows(pr: Presence, rng: TimeRange) -> DataFrame:
    """(client_uid, n) rows that add up to the range, one or more per user."""
    days, facts = split(pr, rng)
    fresh = None if facts is None else facts.groupBy("client_uid").agg(F.count(F.lit(1)).alias("n"))
    if not days:
        return fresh
    stored = stored_runs(pr, days).select("client_uid", F.col("_n").alias("n"))
    return stored if fresh is None else stored.unionByName(fresh)


def load(spark: SparkSession, root: str) -> Summaries | None:
    """The summaries stored beside the tables at ``root``; None if there are none."""
    try:
        return Summaries(**{name: spark.read.schema(schema).parquet(os.path.join(root, FOLDER, name))
                            for name, schema in SCHEMAS.items()})
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def refresh(pr: Presence, root: str, slice_polls: int = SLICE_POLLS) -> list[_dt.date]:
    """Summarize the days that have no summary that agrees with the poll table; returns them.

    Only these days' facts are read and only their partitions written, the
    ``days`` rows last, so a day counts as kept once all its tables are there.
    """
    done = {d for d, _, _ in _kept_days(pr)}
    polls = _polls_of_days(pr).collect()      # one row per day
    todo = sorted(r["event_date"] for r in polls if r["event_date"] not in done)
    if not todo:
        return []
    cs = pr.clients.filter(F.col("event_date").between(F.lit(todo[0]), F.lit(todo[-1])) & F.col("event_date").isin(todo))
    p, n = pr.poll_interval_s, slice_polls_for(pr, slice_polls)
    date = F.date_from_unix_date(F.col("_day").cast("int")).alias("event_date")

    # a day is dealt to as many tasks as its rows need; small days make one file
    spread = 1 + max(r["rows"] or 0 for r in polls) // ROWS_PER_FILE

    def write(df: DataFrame, name: str) -> None:
        schema = SCHEMAS[name]
        dealt = [F.pmod(F.xxhash64("client_uid"), F.lit(spread))] if "client_uid" in schema.names and spread > 1 else []
        (df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
         .repartition("event_date", *dealt)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date")
         .parquet(os.path.join(root, FOLDER, name)))

    write(day_runs(cs, p, n, TOTALS).withColumn("event_date", date), "runs")
    write(day_channels(cs), "channels")
    # each (user, channel) pair once: less to read than the facts
    pairs = pr.spark.read.schema(SCHEMAS["channels"]).parquet(os.path.join(root, FOLDER, "channels")).filter(F.col("event_date").isin(todo))
    write(pairs.groupBy("event_date", "channel_id").agg(F.sum("n").alias("n"), _sketch()), "users")
    write(day_pieces(cs, p, n).withColumn("event_date", date), "pieces")
    write(_polls_of_days(pr).filter(F.col("event_date").isin(todo)).withColumn("poll_interval_s", F.lit(p)), "days")
    return todo
