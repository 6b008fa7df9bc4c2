"""Parquet layout of the presence tables.

``snapshots`` and ``clients`` are partitioned by ``event_date`` (UTC) so every
time-ranged operator prunes whole days; ``channels`` is a small dimension.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall import schemas
from rollcall.operators import summaries
from rollcall.functions.time import utc_day
from rollcall.operators.maintenance import CUTOFFS, RETENTION, recorded_cutoff, upsert_channels
from rollcall.tables import DEFAULT_POLL_INTERVAL_S, Presence

TABLES = ("snapshots", "clients", "channels", "first_seen")
FIRST_SEEN = T.StructType([T.StructField("client_uid", T.StringType(), False),
                           T.StructField("first_ts", T.LongType(), False)])


APPENDED = "appended"      # folder of the channels and first samples of appends, until they are compacted


def is_missing(error: AnalysisException) -> bool:
    """The path does not exist (yet); any other analysis error is a real one."""
    return error.getCondition() == "PATH_NOT_FOUND"


def read_or_none(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The parquet table at ``path``, or None where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if not is_missing(e):
            raise
        return None


def load_presence(spark: SparkSession, root: str,
                  poll_interval_s: int = DEFAULT_POLL_INTERVAL_S) -> Presence:
    """The stored tables.  Channels and first samples that appends have left beside them are folded in: one row per
    channel (the one updated last) and per user (the earliest sample); without appends they are read as they are."""
    def read(name, schema):
        return spark.read.schema(schema).parquet(os.path.join(root, name))

    def appended(name, schema):
        return read_or_none(spark, os.path.join(root, APPENDED, name), schema)

    first_seen = read_or_none(spark, os.path.join(root, "first_seen"), FIRST_SEEN)    # none in older table sets
    later = appended("first_seen", FIRST_SEEN)
    if first_seen is not None and later is not None:
        first_seen = first_seen.unionByName(later).groupBy("client_uid").agg(F.min("first_ts").alias("first_ts"))
    channels = read("channels", schemas.CHANNELS)
    more = appended("channels", schemas.CHANNELS)
    if more is not None:
        channels = upsert_channels(channels, more)
    snapshots, clients = read("snapshots", schemas.SNAPSHOTS), read("clients", schemas.CLIENTS)
    cutoff = recorded_cutoff(spark, root)
    if cutoff is not None:      # retention: what its day still holds from before
        stays = (F.col("event_date") >= F.lit(utc_day(cutoff))) & (F.col("ts") >= F.lit(cutoff))
        snapshots, clients = snapshots.filter(stays), clients.filter(stays)
    return Presence(
        snapshots=snapshots,
        clients=clients,
        channels=channels,
        poll_interval_s=poll_interval_s,
        first_seen=first_seen,
        summaries=summaries.load(spark, root),
    )


def write_presence(pr: Presence, root: str, mode: str = "overwrite",
                   sort_within: bool = True) -> None:
    """Write the tables; facts partitioned by date.  ``mode="append"`` adds polls, and leaves channel versions and first
    samples beside what is stored; :func:`load_presence` folds them in, :func:`rollcall.jobs.compact_appended` for good.

    Client rows are range-partitioned on ``(event_date, client_uid, ts)``: a
    day is spread over many write tasks (a day never lands in one task, and
    even one very active user's day is split by time), and each file holds a
    contiguous, sorted run of users, so row-group statistics on
    ``client_uid`` prune point lookups.
    """
    if mode == "overwrite":     # what belonged to tables written here before
        for name, schema in ((f"{APPENDED}/channels", schemas.CHANNELS), (f"{APPENDED}/first_seen", FIRST_SEEN),
                             (RETENTION, CUTOFFS), (f"{summaries.FOLDER}/days", summaries.SCHEMAS["days"])):
            if read_or_none(pr.spark, os.path.join(root, name), schema) is not None:
                pr.spark.createDataFrame([], schema).write.mode("overwrite").parquet(os.path.join(root, name))
    clients: DataFrame = pr.clients.repartitionByRange("event_date", "client_uid", "ts")
    if sort_within:
        clients = clients.sortWithinPartitions("event_date", "client_uid", "ts", "snapshot_id", "id")
    clients.write.mode(mode).partitionBy("event_date").parquet(os.path.join(root, "clients"))
    (pr.snapshots.repartition("event_date")
     .write.mode(mode).partitionBy("event_date").parquet(os.path.join(root, "snapshots")))
    # all-time first sample per user: a partial aggregate, one row per user, over the rows as written where
    # these are all there is (two columns instead of the input's lineage)
    append = mode == "append"
    rows = pr.clients if append else pr.spark.read.schema(schemas.CLIENTS).parquet(os.path.join(root, "clients"))
    first = pr.first_seen if pr.first_seen is not None else rows.groupBy("client_uid").agg(F.min("ts").alias("first_ts"))
    beside = os.path.join(root, APPENDED) if append else root
    upsert_channels(pr.channels.limit(0), pr.channels).write.mode(mode).parquet(os.path.join(beside, "channels"))
    first.write.mode(mode).parquet(os.path.join(beside, "first_seen"))
