"""Streaming ingest of poll documents into the presence tables.

Landing files hold JSON lines ``{"poll_ts": <epoch s>, "payload": {...}}``.
Each micro-batch writes its documents, its client rows and then its snapshot
rows into directories named by the query and batch ids (``batch=<query>-<id>``),
overwriting them, so a batch replayed after a failure replaces its own partial
output and no other query's; readers take client rows only where the snapshot
row exists (:func:`committed_presence`).

A poll's documents may arrive in several micro-batches.  Accepted documents are
kept by poll and content; when further ones of a known poll arrive, the batch
unites them with the kept ones and writes that poll's rows again as a new
version.  A version is the number of documents it unites, so readers take the
largest, and the answer does not depend on how the documents were batched.
One query at a time is expected to ingest into a table set.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rollcall import schemas
from rollcall.operators.maintenance import upsert_channels
from rollcall.session import checkpoint_dir
from rollcall.functions.time import utc_date
from rollcall.sources import payloads
from rollcall.sources.parquet import is_missing, read_or_none
from rollcall.streaming import views
from rollcall.tables import DEFAULT_POLL_INTERVAL_S, Presence

# Polls may land out of order; a poll more than this late is dropped by the
# duplicate filter's watermark (set well above the landing disorder).
DEFAULT_LATENESS = "10 minutes"


def poll_stream(spark: SparkSession, landing_dir: str, lateness: str = DEFAULT_LATENESS,
                dedupe: bool = True, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming ``poll_ts, payload, poll_time`` with a watermark on ``poll_time``.

    The watermark (``lateness``) is the stream's only one: copies of a poll's
    document are dropped within it (different documents of one poll all stay), and the
    windowed operators downstream close on it.
    """
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    raw = reader.load(landing_dir)
    docs = raw.select(payloads.poll_time(F.get_json_object("value", "$.poll_ts")).alias("poll_ts"),
                      F.get_json_object("value", "$.payload").alias("payload"))
    # validated before repeats are dropped: a rejected document never suppresses the retry
    docs = (payloads.only_accepted(docs)
            .withColumn("poll_time", F.timestamp_seconds("poll_ts"))
            .withWatermark("poll_time", lateness))
    return docs.dropDuplicatesWithinWatermark(["poll_ts", "payload"]) if dedupe else docs


def client_stream(polls: DataFrame, include_query_clients: bool = False, dedupe: bool = True) -> DataFrame:
    """Client rows of a poll stream (no snapshots), keeping the event time ``poll_time``.

    With ``dedupe``, a connection (``clid``) that several documents of a poll list under one identity is
    kept once within the watermark; records without ``clid`` are all kept.
    """
    rows = payloads.client_list_rows(polls.select("poll_ts", "payload", "poll_time", F.sha2("payload", 256).alias("_doc")),
                                     include_query_clients)
    if dedupe:
        clid = F.col("c.clid")
        rows = (rows.withColumn("_uid", F.col("c.client_unique_identifier"))
                .withColumn("_connection", F.coalesce(F.concat(F.lit("c"), clid), F.concat_ws("/", F.lit("d"), "_doc", "pos")))
                .dropDuplicatesWithinWatermark(["poll_ts", "_uid", "_connection"]))
    return payloads.clients_from_rows(rows, keep=("poll_time",))


def _tagged(write: Callable[[DataFrame, str], None], spark: SparkSession, checkpoint: str) -> Callable[[DataFrame, int], None]:
    """``write(batch, tag)`` as a foreachBatch function.

    The tag joins the id of the query, which Spark keeps in the checkpoint, and
    the batch id: the same for a replay, another for a new checkpoint.
    """
    ids: list[str] = []

    def run(batch: DataFrame, batch_id: int) -> None:
        if not ids:
            ids.append(json.loads(spark.read.text(os.path.join(checkpoint, "metadata")).first()[0])["id"])
        write(batch, batch_tag(batch_id, ids[0]))
    return run


def batch_tag(batch_id: int, query_id: str = "") -> str:
    return f"{query_id}-{batch_id:09d}" if query_id else f"{batch_id:09d}"


# What a table set keeps besides the rows: poll versions, and the accepted documents by poll and content.
VERSIONED = T.StructType(schemas.SNAPSHOTS.fields + [T.StructField("version", T.LongType(), True),
                                                      T.StructField("batch", T.StringType(), True)])
_DOCUMENTS = T.StructType([T.StructField("poll_ts", T.LongType()), T.StructField("doc", T.StringType()),
                           T.StructField("payload", T.StringType()), T.StructField("event_date", T.DateType()),
                           T.StructField("batch", T.StringType())])
_POLL = ["event_date", "snapshot_id"]


def _newest_polls(snapshots: DataFrame) -> DataFrame:
    """One row per poll: its newest version (rows written before versions were kept count as the first)."""
    version = F.coalesce("version", F.lit(1)).cast("long")
    newest = F.max(F.struct(version.alias("version"), "batch", "ts", "total_clients"))
    return snapshots.groupBy(*_POLL).agg(newest.alias("r")).select(*_POLL, "r.*")


def _kept_documents(spark: SparkSession, root: str, polls: DataFrame, committed: DataFrame | None) -> DataFrame | None:
    """The documents of the given polls (event_date, poll_ts) that the committed batches have kept."""
    docs = read_or_none(spark, os.path.join(root, "documents"), _DOCUMENTS)
    if docs is None or committed is None:
        return None
    return (docs.join(polls, ["event_date", "poll_ts"], "left_semi")
            .join(committed, "batch", "left_semi").drop("batch").dropDuplicates(["poll_ts", "doc"]))


def _client_rows(spark: SparkSession, root: str) -> DataFrame:
    """The client rows of all batches, with the batch that wrote them."""
    with_batch = T.StructType(schemas.CLIENTS.fields + [T.StructField("batch", T.StringType(), True)])
    return spark.read.schema(with_batch).parquet(os.path.join(root, "clients"))


def _write_batch(batch: DataFrame, batch_id: int, root: str, include_query_clients: bool,
                 query_id: str = "") -> None:
    _write_tagged(batch, batch_tag(batch_id, query_id), root, include_query_clients)


def _write_tagged(batch: DataFrame, tag: str, root: str, include_query_clients: bool, views_interval_s: int | None = None) -> None:
    """Documents, clients, first samples, views and snapshots of the polls that this batch brings something new for."""
    spark = batch.sparkSession
    others = read_or_none(spark, os.path.join(root, "snapshots"), VERSIONED)
    others = None if others is None else others.filter(F.col("batch") != tag)
    committed = None if others is None else others.select("batch").distinct()
    accepted = (payloads.accepted_documents(batch.select("poll_ts", "payload"))
                .select("poll_ts", F.sha2("payload", 256).alias("doc"), "payload", utc_date("poll_ts").alias("event_date"))
                .persist())
    fresh = united = accepted
    try:
        kept = _kept_documents(spark, root, accepted.select("event_date", "poll_ts").distinct(), committed)
        if kept is not None:
            fresh = accepted.join(kept.select("poll_ts", "doc"), ["poll_ts", "doc"], "left_anti").persist()
            # documents of this batch and those kept of the same polls, if this batch adds any
            known = kept.join(fresh.select("poll_ts").distinct(), "poll_ts", "left_semi")
            united = fresh.unionByName(known).persist()
        snaps, clients = payloads.ingest_client_payloads(united.select("poll_ts", "payload"), include_query_clients)
        versions = united.groupBy("poll_ts").agg(F.count(F.lit(1)).alias("version")).withColumnRenamed("poll_ts", "snapshot_id")

        def write(df: DataFrame, table: str, by_day: bool = True) -> None:
            writer = df.write.mode("overwrite")
            (writer.partitionBy("event_date") if by_day else writer).parquet(os.path.join(root, table, f"batch={tag}"))

        write(fresh, "documents")
        write(clients, "clients")
        # per-user first sample of this batch: growth reads this small table, not the history
        write(clients.groupBy("client_uid").agg(F.min("ts").alias("first_ts")), "first_seen", by_day=False)
        snaps = snaps.join(versions, "snapshot_id")
        if views_interval_s is not None:
            known_polls = None if others is None else _newest_polls(others)
            old = None
            if known_polls is not None:     # the rows that earlier versions of this batch's polls have
                earlier = known_polls.join(snaps, _POLL, "left_semi")
                old = _client_rows(spark, root).join(earlier, [*_POLL, "batch"], "left_semi")
            views.write_views(spark, root, tag, snaps, clients, int(views_interval_s), known_polls, old, committed)
        # snapshots last: their presence marks the batch as committed
        write(snaps, "snapshots")
    finally:
        for df in {id(d): d for d in (accepted, fresh, united)}.values():
            df.unpersist()


def start_presence_ingest(spark: SparkSession, landing_dir: str, table_root: str,
                          checkpoint: str | None = None, available_now: bool = True,
                          include_query_clients: bool = False,
                          lateness: str = DEFAULT_LATENESS, dedupe: str = "committed",
                          max_files_per_trigger: int | None = None, views_interval_s: int | None = None) -> StreamingQuery:
    """Start the ingest query (``availableNow`` drains what has landed, then stops).

    ``max_files_per_trigger`` bounds a micro-batch, so that a backlog is read
    in several; unset, a batch holds all that has landed.

    Each micro-batch unites the accepted documents of a poll with those that earlier
    batches kept (a read of the touched days' documents), so the tables are the same for any batch size.
    ``dedupe="committed"`` (default) needs no streaming state and keeps late polls.
    ``dedupe="watermark"`` also drops copies of documents in the stream with
    ``dropDuplicatesWithinWatermark``, and with them polls later than ``lateness``.

    With ``views_interval_s`` (the poll interval) each batch also maintains hours and sessions,
    late polls included; read them with :func:`rollcall.streaming.maintained_hours` and ``maintained_sessions``.
    """
    if dedupe not in ("committed", "watermark"):
        raise ValueError("dedupe must be 'committed' or 'watermark'")
    checkpoint = checkpoint or os.path.join(checkpoint_dir(spark), "presence-ingest")
    polls = poll_stream(spark, landing_dir, lateness, dedupe=(dedupe == "watermark"),
                        max_files_per_trigger=max_files_per_trigger)
    write = _tagged(lambda df, tag: _write_tagged(df, tag, table_root, include_query_clients, views_interval_s),
                    spark, checkpoint)
    writer = (polls.writeStream.foreachBatch(write)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def committed_presence(spark: SparkSession, table_root: str, channels: DataFrame | None = None,
                       poll_interval_s: int = DEFAULT_POLL_INTERVAL_S) -> Presence:
    """The ingested tables: the newest version of each poll, client rows limited to it."""
    newest = _newest_polls(spark.read.schema(VERSIONED).parquet(os.path.join(table_root, "snapshots")))
    cs = _client_rows(spark, table_root)
    if channels is None:
        channels = spark.createDataFrame([], schemas.CHANNELS)
    sn = newest.select(*[f.name for f in schemas.SNAPSHOTS.fields])
    cs = cs.join(newest, [*_POLL, "batch"], "left_semi").select(*[f.name for f in schemas.CLIENTS.fields])
    try:
        first_seen = committed_first_seen(spark, table_root)
    except AnalysisException as e:  # tables written without the side table
        if not is_missing(e):
            raise
        first_seen = None
    return Presence(sn, cs, channels, poll_interval_s, first_seen=first_seen)


def committed_first_seen(spark: SparkSession, table_root: str) -> DataFrame:
    """``client_uid, first_ts`` over committed batches (for :func:`rollcall.operators.users.growth_metrics`).

    Each batch adds at most one row per user; the fold is a partial aggregate.
    """
    schema = T.StructType([T.StructField("client_uid", T.StringType()), T.StructField("first_ts", T.LongType()),
                           T.StructField("batch", T.StringType())])
    fs = spark.read.schema(schema).parquet(os.path.join(table_root, "first_seen"))
    committed = (spark.read.schema(VERSIONED).parquet(os.path.join(table_root, "snapshots"))
                 .select("batch").distinct())
    return (fs.join(committed, "batch", "left_semi")
            .groupBy("client_uid").agg(F.min("first_ts").alias("first_ts")))


_CURRENT = T.StructType([T.StructField(f.name, f.dataType, True) for f in schemas.CLIENTS.fields]
                        + [T.StructField("written_by", T.StringType()), T.StructField("v", T.LongType()),
                           T.StructField("docs", T.LongType())])
_CURRENT_DOCUMENTS = T.StructType([T.StructField("payload", T.StringType()), T.StructField("v", T.LongType()),
                                   T.StructField("batch", T.StringType())])


def current_presence(spark: SparkSession, path: str) -> DataFrame:
    """Client rows of the newest poll stored by :func:`start_current_presence`; none if that poll was empty."""
    versions = read_or_none(spark, path, _CURRENT)
    if versions is None:
        return spark.createDataFrame([], schemas.CLIENTS)
    newest = versions.agg(F.max(F.struct("v", "docs"))).scalar()
    return (versions.filter((F.struct("v", "docs") == newest) & F.col("client_uid").isNotNull())
            .drop("written_by", "v", "docs"))


def _write_current(batch: DataFrame, tag: str, path: str, include_query_clients: bool = False) -> None:
    """Write the newest poll of the batch, unless a newer one is stored.

    Documents of that poll that other batches brought are kept next to the
    rows and united with the batch's; each number of documents is a version
    (``v=<poll>/docs=<number>``) of its own.  An empty poll is a version, too (one row without
    a client).  A batch that is replayed after a failure writes its version again.
    """
    spark = batch.sparkSession
    batch = payloads.accepted_documents(batch.select("poll_ts", "payload")).persist()
    try:
        newest = batch.agg(F.max("poll_ts")).first()[0]
        if newest is None:
            return
        kept_path = os.path.join(path, "_documents")      # not listed by readers of the rows
        stored = read_or_none(spark, kept_path, _CURRENT_DOCUMENTS)
        docs = batch.filter(F.col("poll_ts") == F.lit(newest)).select("payload")
        if stored is not None:
            others = stored.filter(F.col("batch") != tag)
            newer = others.agg(F.max("v")).first()[0]
            if newer is not None and newer > newest:
                return
            docs = docs.union(others.filter(F.col("v") == F.lit(newest)).select("payload")).distinct()
        docs = docs.select(F.lit(newest).cast("long").alias("poll_ts"), "payload").persist()
        try:
            number = docs.count()
            snaps, clients = payloads.ingest_client_payloads(docs, include_query_clients)
            rows = (snaps.select("snapshot_id", "ts", "event_date")
                    .join(clients.drop("ts", "event_date"), "snapshot_id", "left")
                    .select(*[f.name for f in schemas.CLIENTS.fields], F.lit(tag).alias("written_by")))
            (batch.filter(F.col("poll_ts") == F.lit(newest)).select("payload")
             .write.mode("overwrite").parquet(os.path.join(kept_path, f"v={newest}", f"batch={tag}")))
            rows.write.mode("overwrite").parquet(os.path.join(path, f"v={newest}", f"docs={number}"))
        finally:
            docs.unpersist()
    finally:
        batch.unpersist()


def start_current_presence(spark: SparkSession, landing_dir: str, current_path: str,
                           checkpoint: str | None = None, available_now: bool = True,
                           include_query_clients: bool = False) -> StreamingQuery:
    """Keep the newest poll for :func:`current_presence`, all its documents united whatever batches they come in;
    late polls change nothing, empty ones empty the answer."""
    checkpoint = checkpoint or os.path.join(checkpoint_dir(spark), "current-presence")
    write = _tagged(lambda df, tag: _write_current(df, tag, current_path, include_query_clients), spark, checkpoint)
    writer = (poll_stream(spark, landing_dir, dedupe=False).writeStream.foreachBatch(write)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def _channel_versions(spark: SparkSession, root: str) -> DataFrame | None:
    schema = T.StructType(schemas.CHANNELS.fields + [T.StructField("written_by", T.StringType(), True),
                                                     T.StructField("v", T.LongType(), True)])
    try:
        return spark.read.schema(schema).parquet(root)
    except AnalysisException as e:  # nothing written yet
        if not is_missing(e):
            raise
        return None


def latest_channels(spark: SparkSession, root: str, not_by: str | None = None) -> DataFrame:
    """The newest version of the channel dimension written by :func:`start_channel_upkeep`
    (with ``not_by``: the newest that this batch did not write).

    Versions are ``v=<number>`` directories found by Spark's partition
    discovery, so any file system Spark reads (HDFS, object stores) works.
    """
    versions = _channel_versions(spark, root)
    if versions is None:
        return spark.createDataFrame([], schemas.CHANNELS)
    if not_by is not None:
        versions = versions.filter(~F.col("written_by").eqNullSafe(not_by))
    newest = versions.agg(F.max("v")).first()[0]
    return versions.filter(F.col("v") == F.lit(newest)).drop("v", "written_by")


def _upkeep_batch(batch: DataFrame, tag: str, root: str) -> None:
    """Write the version after the newest; a replayed batch writes its own version again."""
    spark = batch.sparkSession
    versions = _channel_versions(spark, root)
    newest = None if versions is None else versions.filter(~F.col("written_by").eqNullSafe(tag)).agg(F.max("v")).first()[0]
    current = latest_channels(spark, root, not_by=tag)
    updates = payloads.channel_updates(batch.select("poll_ts", "payload"))
    merged = upsert_channels(current, updates, seq_col="_seq").withColumn("written_by", F.lit(tag))
    # the read above listed the existing versions when it was created, so
    # writing a version directory next to them does not change its input
    merged.write.mode("overwrite").parquet(os.path.join(root, f"v={0 if newest is None else newest + 1}"))


def start_channel_upkeep(spark: SparkSession, landing_dir: str, dimension_root: str,
                         checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Upsert channel-list polls into a new version of the dimension per micro-batch.

    Every version is a fresh directory; the one being read is never rewritten.
    Late polls are kept: the upsert itself lets the later update win.
    """
    checkpoint = checkpoint or os.path.join(checkpoint_dir(spark), "channel-upkeep")
    write = _tagged(lambda df, tag: _upkeep_batch(df, tag, dimension_root), spark, checkpoint)
    writer = (poll_stream(spark, landing_dir, dedupe=False).writeStream.foreachBatch(write)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 hour")
    return writer.start()
