"""Views maintained while polls are ingested: load per hour and sessions, corrected by late polls.

The windowed streams of :mod:`rollcall.streaming.windows` close a window once
the watermark has passed it and drop what comes later.  Here every micro-batch
merges what it brings into stored state instead, however late it is:

* an hour's row is computed anew from the poll table when one of its polls is new or changed;
* a user's day is kept as stretches of samples (start, end, number); new samples
  extend, join or add stretches, so neither facts nor other days are read.

Each batch writes the rows it changes next to the ingest's tables, before the
snapshots that commit it.  A row's version (polls and documents in the hour, samples in the user's
day) only grows, so readers take the largest among committed batches and older rows stay untouched.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.functions.columns import round2
from rollcall.operators.sequence import DAY_S, joined_pieces, numbered_sessions
from rollcall.sources.parquet import read_or_none

HOUR_S = 3600


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S, _L = T.StringType(), T.LongType()
HOURS = _schema(hour_start=_L, polls=_L, clients=_L, max_clients=_L, version=_L, event_date=T.DateType(), batch=_S)
PIECES = _schema(client_uid=_S, _day=_L, start_ts=_L, end_ts=_L, n=_L, version=_L, poll_interval_s=_L, event_date=T.DateType(), batch=_S)


def _committed(spark: SparkSession, root: str, name: str, schema: T.StructType, batches: DataFrame) -> DataFrame | None:
    rows = read_or_none(spark, os.path.join(root, name), schema)
    return None if rows is None else rows.join(batches, "batch", "left_semi")


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each key's largest version (of the batch that wrote it last, should two have the same)."""
    w = Window.partitionBy(*keys)
    return (rows.withColumn("_newest", F.max(F.struct("version", "batch")).over(w))
            .filter(F.struct("version", "batch") == F.col("_newest")).drop("_newest"))


def changed_hours(polls: DataFrame, others: DataFrame | None) -> DataFrame:
    """Rows of the hours that ``polls`` (event_date, ts, total_clients, version) touch, with the ``others`` of these hours."""
    def hour(df: DataFrame) -> DataFrame:
        return df.select("event_date", "ts", "total_clients", "version", (F.floor(F.col("ts") / HOUR_S) * HOUR_S).alias("hour_start"))
    rows = hour(polls)
    if others is not None:
        touched = rows.select("event_date", "hour_start").distinct()
        kept = hour(others).join(touched, ["event_date", "hour_start"], "left_semi").join(rows, ["event_date", "ts"], "left_anti")
        rows = rows.unionByName(kept)
    return rows.groupBy("event_date", "hour_start").agg(
        F.count(F.lit(1)).alias("polls"), F.sum("total_clients").alias("clients"), F.max("total_clients").alias("max_clients"),
        (F.count(F.lit(1)) + F.sum("version")).alias("version"))


def changed_pieces(new: DataFrame, old: DataFrame | None, stored: DataFrame | None, p: int) -> DataFrame:
    """Stretches of the user days that gain samples.

    ``new`` are the batch's client rows, ``old`` those that an earlier version of the same polls had, ``stored``
    the newest stretches so far.
    """
    def points(df: DataFrame, sign: int) -> DataFrame:
        return df.select("client_uid", "ts", F.lit(sign).alias("n"))
    delta = points(new, 1) if old is None else points(new, 1).unionByName(points(old, -1))
    day = F.floor(F.col("ts") / DAY_S).cast("long").alias("_day")
    pieces = (delta.groupBy("client_uid", "ts").agg(F.sum("n").cast("long").alias("n")).filter("n > 0")
              .select("client_uid", day, F.col("ts").alias("start_ts"), F.col("ts").alias("end_ts"), "n"))
    if stored is not None:
        users = pieces.select("client_uid", "_day").distinct()
        pieces = pieces.unionByName(stored.select(*pieces.columns).join(users, ["client_uid", "_day"], "left_semi"))
    total = F.sum("n").over(Window.partitionBy("client_uid", "_day"))
    return (joined_pieces(pieces, p).withColumn("version", total.cast("long")).withColumn("n", F.col("n").cast("long"))
            .withColumn("poll_interval_s", F.lit(p).cast("long")).withColumn("event_date", F.date_from_unix_date(F.col("_day").cast("int"))))


def write_views(spark: SparkSession, root: str, tag: str, polls: DataFrame, clients: DataFrame, p: int,
                other_polls: DataFrame | None, old_clients: DataFrame | None, batches: DataFrame | None) -> None:
    """Write what a batch changes; called by the ingest before it writes its snapshots."""
    def write(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").partitionBy("event_date").parquet(os.path.join(root, name, f"batch={tag}"))

    days = polls.select("event_date").distinct()
    stored = None
    if batches is not None:
        stored = _committed(spark, root, "pieces", PIECES, batches)
        if stored is not None:
            stored = _newest(stored.filter((F.col("batch") != tag) & (F.col("poll_interval_s") == p)).join(days, "event_date", "left_semi"),
                             ["client_uid", "_day"])
    if other_polls is not None:
        other_polls = other_polls.join(days, "event_date", "left_semi")
    write(changed_hours(polls, other_polls), "hours")
    write(changed_pieces(clients, old_clients, stored, p), "pieces")


def _batches(spark: SparkSession, root: str) -> DataFrame:
    from rollcall.streaming.ingest import VERSIONED
    return spark.read.schema(VERSIONED).parquet(os.path.join(root, "snapshots")).select("batch").distinct()


def maintained_hours(spark: SparkSession, root: str) -> DataFrame:
    """hour_start, avg_clients, max_clients, polls of every hour with polls, all late polls included."""
    rows = _newest(_committed(spark, root, "hours", HOURS, _batches(spark, root)), ["event_date", "hour_start"])
    return rows.select("hour_start", round2(F.col("clients") / F.col("polls")).alias("avg_clients"), "max_clients", "polls")


def maintained_sessions(spark: SparkSession, root: str, poll_interval_s: int) -> DataFrame:
    """What :func:`rollcall.operators.sequence.sessions` gives over all ingested polls, from the stored stretches."""
    rows = _committed(spark, root, "pieces", PIECES, _batches(spark, root)).filter(F.col("poll_interval_s") == poll_interval_s)
    newest = _newest(rows, ["event_date", "client_uid", "_day"])
    return numbered_sessions(newest.select("client_uid", "_day", "start_ts", "end_ts", "n"), poll_interval_s)
