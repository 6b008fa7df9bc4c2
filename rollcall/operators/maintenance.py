"""Table upkeep: channel upsert and retention."""

from __future__ import annotations

import datetime as _dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.functions.time import utc_day
from rollcall.tables import DAY_S, Presence

_CHANNEL_COLS = ("channel_id", "channel_name", "parent_channel_id", "channel_order",
                 "total_clients", "last_updated")


def upsert_channels(current: DataFrame, updates: DataFrame, seq_col: str | None = None) -> DataFrame:
    """Last write wins per channel; channels absent from ``updates`` remain.

    Among rows of one channel the latest ``last_updated`` wins, then an update
    over the current row, then the larger ``seq_col`` (the later position in a
    channel list), then the larger row (a deterministic last resort).  Written
    as an arg-max aggregate, so a channel reported in many polls is combined
    map-side rather than gathered into one task.  The caller writes the result
    to a new path; the table being read is never overwritten in place.
    """
    seq = F.col(seq_col).cast("long") if seq_col else F.lit(0).cast("long")
    cur = current.select(*_CHANNEL_COLS, F.lit(0).alias("_src"), F.lit(0).cast("long").alias("_seq"))
    upd = updates.select(*_CHANNEL_COLS, F.lit(1).alias("_src"), seq.alias("_seq"))
    row = F.struct(*[F.col(c) for c in _CHANNEL_COLS[1:]])
    # the row itself breaks any remaining tie, so a recomputed task picks the same row
    rank = F.struct("last_updated", "_src", "_seq", row.alias("_row"))
    return (cur.unionByName(upd)
            .groupBy("channel_id")
            .agg(F.max_by(row, rank).alias("_row"))
            .select("channel_id", *[F.col(f"_row.{c}").alias(c) for c in _CHANNEL_COLS[1:]]))


def retention_cutoff(as_of: int, days: int) -> int:
    if days is None or int(days) < 1:
        raise ValueError("retention days must be >= 1")
    return int(as_of) - int(days) * DAY_S


def retain(pr: Presence, as_of: int, days: int) -> tuple[Presence, DataFrame]:
    """Keep polls with ``ts >= as_of - days*86400`` in both tables.

    Returns the kept tables and a one-row frame with the removed counts.
    The predicates on ``event_date`` let either side skip the other's date
    partitions whole; only the cutoff's day is read by both.
    """
    cutoff = retention_cutoff(as_of, days)
    day = F.lit(utc_day(cutoff))
    stays = (F.col("event_date") >= day) & (F.col("ts") >= F.lit(cutoff))
    goes = (F.col("event_date") <= day) & (F.col("ts") < F.lit(cutoff))
    keep_sn, keep_cs = pr.snapshots.filter(stays), pr.clients.filter(stays)
    removed_rows = pr.clients.filter(goes).agg(F.count(F.lit(1))).scalar()
    removed = (pr.snapshots.filter(goes).agg(F.count(F.lit(1)).alias("removed_snapshots"))
               .withColumn("removed_client_rows", removed_rows))
    kept = Presence(keep_sn, keep_cs, pr.channels, pr.poll_interval_s)
    return kept, removed


def retention_report(pr: Presence, days: int, as_of: int | None = None) -> DataFrame:
    """Removed and kept counts for a retention of ``days`` days; one row, one scan of the times per table."""
    as_of = pr.latest_ts() if as_of is None else as_of
    cutoff = F.lit(retention_cutoff(as_of or 0, days))

    def counts(table: DataFrame) -> DataFrame:
        return table.agg(F.struct(F.count_if(F.col("ts") < cutoff).alias("removed"),
                                  F.count_if(F.col("ts") >= cutoff).alias("kept")).alias("n"))

    return (counts(pr.snapshots).withColumn("rows", counts(pr.clients).scalar())
            .select(F.col("n.removed").alias("removed_snapshots"), F.col("rows.removed").alias("removed_client_rows"),
                    F.col("n.kept").alias("kept_snapshots"), F.col("rows.kept").alias("kept_client_rows")))


def write_retained(pr: Presence, as_of: int, days: int, new_root: str) -> DataFrame:
    """Write the retained tables to ``new_root`` (a fresh version); returns removed counts."""
    from rollcall.sources.parquet import write_presence

    kept, removed = retain(pr, as_of, days)
    write_presence(kept, new_root)
    return removed


RETENTION = "retention"      # folder of the recorded cutoffs, one small file each
CUTOFFS = T.StructType([T.StructField("cutoff", T.LongType())])


def recorded_cutoff(spark: SparkSession, root: str) -> int | None:
    """The latest cutoff that :func:`expire` recorded for the tables at ``root``."""
    from rollcall.sources.parquet import read_or_none

    cutoffs = read_or_none(spark, os.path.join(root, RETENTION), CUTOFFS)
    return None if cutoffs is None else cutoffs.agg(F.max("cutoff")).first()[0]


def expire(pr: Presence, root: str, as_of: int, days: int) -> tuple[int, int]:
    """Apply retention to the stored tables at ``root``; returns the removed polls and client rows.

    The cutoff is recorded first: from then on the tables are loaded without
    older rows.  Then the day partitions that lie wholly before the cutoff are dropped,
    so no kept day is read or written; what the cutoff's own day still holds goes with that day.  The
    first samples are folded again over the kept rows (one row per user).  Repeating it after a failure goes on where it stopped.
    """
    spark = pr.spark
    cutoff = retention_cutoff(as_of, days)
    day = utc_day(cutoff)
    gone = pr.snapshots.filter((F.col("event_date") <= F.lit(day)) & (F.col("ts") < F.lit(cutoff))).agg(
        F.count(F.lit(1)), F.coalesce(F.sum("total_clients"), F.lit(0))).first()
    spark.createDataFrame([(cutoff,)], "cutoff long").coalesce(1).write.mode("append").parquet(os.path.join(root, RETENTION))
    for table in ("clients", "snapshots", *(os.path.join("summaries", n) for n in ("runs", "channels", "pieces", "users", "days"))):
        _drop_days_before(spark, os.path.join(root, table), day)
    spark.catalog.refreshByPath(root)
    kept = retain(pr, as_of, days)[0].clients.filter(F.col("event_date") >= F.lit(day))
    kept.groupBy("client_uid").agg(F.min("ts").alias("first_ts")).write.mode("overwrite").parquet(os.path.join(root, "first_seen"))
    return int(gone[0]), int(gone[1])


def _drop_days_before(spark: SparkSession, path: str, day: _dt.date) -> None:
    """Delete the ``event_date=`` folders before a day, through the file system that Spark uses for the path."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(folder):
        return
    for entry in fs.listStatus(folder):
        name = entry.getPath().getName()
        if name.startswith("event_date=") and name[len("event_date="):] < day.isoformat():
            fs.delete(entry.getPath(), True)
