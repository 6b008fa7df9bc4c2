"""Derive presence tables from the driver's ``events`` and ``nation`` tables.

This builds stand-in input only: rows in the presence schema, one fact row per
event, bucketed to polls of ``poll_interval_s`` seconds.  The column rules are
fixed by the test-data description; no operator result is computed here
except the per-poll client count that a poller records with each snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.time import utc_date
from rollcall.tables import Presence

# Fixed values of the adapter (test-data description).
ADAPTER_POLL_INTERVAL_S = 14400        # 4 h polls
ONBOARDING_ORIGIN_TICK = 118338        # first poll of 2024-01-01 at 4 h polls
CHANNEL_COUNT = 27                     # channel ids 1..27; nations 0..24 become channels 1..25
SHARED_IDENTITIES = 3                  # heavy identities that many users' events share
BLANK_NAME_NATION = 3                  # this nation's channel gets an empty name
TICK_CHUNK = 10_000                    # poll ticks generated per grid row


def _k() -> F.Column:
    return F.regexp_extract(F.col("props"), "([0-9]+)", 1).cast("long")


def client_rows(events: DataFrame, poll_interval_s: int = ADAPTER_POLL_INTERVAL_S) -> DataFrame:
    """One fact row per event.

    Events with ``k >= (user_id % 10) * 10`` and ``tick - origin >= (user_id %
    30) * 6`` belong to identity ``u<user_id>``: activity is uneven across
    users, and users first appear at different times (so new versus returning
    users are meaningful).  All other events belong to a few shared identities
    ``guest<user_id % 3>``, which hold most of the rows (hot keys).
    """
    p = int(poll_interval_s)
    k = F.col("k")
    uid = F.col("user_id")
    etype = F.col("event_type")
    base = (events
            .select("event_id", "user_id", "event_type", "value",
                    F.unix_timestamp(F.col("ts")).alias("epoch"), _k().alias("k"))
            .withColumn("snapshot_id", F.floor(F.col("epoch") / p).cast("long")))
    own = (k >= (uid % 10) * 10) & ((F.col("snapshot_id") - ONBOARDING_ORIGIN_TICK) >= (uid % 30) * 6)
    away = etype == "view"
    rows = base.select(
        F.col("event_id").alias("id"),
        "snapshot_id",
        (F.col("snapshot_id") * p).alias("ts"),
        F.when(own, F.concat(F.lit("u"), uid.cast("string")))
         .otherwise(F.concat(F.lit("guest"), (uid % SHARED_IDENTITIES).cast("string"))).alias("client_uid"),
        uid.alias("client_database_id"),
        F.concat(F.lit("nick"), uid.cast("string"), F.lit("_"), (k % 3).cast("string")).alias("nickname"),
        (k % CHANNEL_COUNT + 1).alias("channel_id"),
        F.when(k % 7 == 0, F.lit(None).cast("long"))
         .otherwise(F.floor(F.col("value") * 10000).cast("long")).alias("idle_ms"),
        away.alias("is_away"),
        F.when(away | (k % 10 == 0), F.concat(F.lit("brb"), (k % 5).cast("string")))
         .otherwise(F.lit("")).alias("away_message"),
        (etype == "click").alias("is_talking"),
        (etype == "error").alias("input_muted"),
        (etype == "signup").alias("output_muted"),
        ((etype == "purchase") & (k % 4 == 0)).alias("is_recording"),
        F.when(k % 9 == 0, F.lit(None).cast("string"))
         .when(k % 9 == 1, F.lit(""))
         .otherwise(F.concat((uid % 3 + 6).cast("string"), F.lit(", "), (k % 2 + 9).cast("string")))
         .alias("server_groups"),
        F.floor(F.col("value") * 60).cast("long").alias("connected_time"),
    )
    return rows.withColumn("event_date", utc_date("ts"))


def snapshot_rows(events: DataFrame, clients: DataFrame,
                  poll_interval_s: int = ADAPTER_POLL_INTERVAL_S) -> DataFrame:
    """One row per poll tick between the first and last event, also when empty.

    The tick grid has span / interval rows (a time bound, not a data bound).
    It is generated in chunks of ``TICK_CHUNK`` ticks spread over tasks, so no
    single row or task holds the whole grid.  The client count per tick is a
    partial aggregate joined onto the grid.
    """
    p = int(poll_interval_s)
    tick = F.floor(F.unix_timestamp(F.col("ts")) / p).cast("long")
    bounds = events.agg(F.min(tick).alias("lo"), F.max(tick).alias("hi"))
    chunks = (bounds.select("lo", "hi", F.explode(F.sequence(F.lit(0).cast("long"),
                                                             F.floor((F.col("hi") - F.col("lo")) / TICK_CHUNK)
                                                             .cast("long"))).alias("_chunk"))
              .repartition("_chunk"))
    start = F.col("lo") + F.col("_chunk") * TICK_CHUNK
    grid = chunks.select(F.explode(F.sequence(start, F.least(F.col("hi"), start + (TICK_CHUNK - 1))))
                         .alias("snapshot_id"))
    counts = clients.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("total_clients"))
    return (grid.join(counts, "snapshot_id", "left")
            .select("snapshot_id",
                    (F.col("snapshot_id") * p).alias("ts"),
                    F.coalesce("total_clients", F.lit(0)).cast("long").alias("total_clients"))
            .withColumn("event_date", utc_date("ts")))


def channel_rows(nation: DataFrame) -> DataFrame:
    key = F.col("n_nationkey").cast("long")
    return (nation
            .select((key + 1).alias("channel_id"),
                    F.when(key == BLANK_NAME_NATION, F.lit("")).otherwise(F.col("n_name")).alias("channel_name"),
                    F.col("n_regionkey").cast("long").alias("parent_channel_id"),
                    key.alias("channel_order"),
                    F.lit(0).cast("long").alias("total_clients"),
                    F.lit(0).cast("long").alias("last_updated")))


def presence_from_events(events: DataFrame, nation: DataFrame,
                         poll_interval_s: int = ADAPTER_POLL_INTERVAL_S) -> Presence:
    clients = client_rows(events, poll_interval_s)
    return Presence(
        snapshots=snapshot_rows(events, clients, poll_interval_s),
        clients=clients,
        channels=channel_rows(nation),
        poll_interval_s=poll_interval_s,
    )


def load_adapter(spark, sf_dir: str, poll_interval_s: int = ADAPTER_POLL_INTERVAL_S) -> Presence:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return presence_from_events(events, nation, poll_interval_s)


def channel_observations(events: DataFrame, poll_interval_s: int = ADAPTER_POLL_INTERVAL_S) -> DataFrame:
    """Stand-in channel-list rows: one observation per event, stamped with its poll.

    Rule: channel ``k % 27 + 1`` named ``room <id>/<user_id % 4>``, parent
    ``k % 3``, order ``k % 27``, ``user_id % 7`` clients; ``_seq`` is the event id
    (the position in the reported list).
    """
    p = int(poll_interval_s)
    k = _k()
    cid = k % CHANNEL_COUNT + 1
    return events.select(
        cid.alias("channel_id"),
        F.concat(F.lit("room "), cid.cast("string"), F.lit("/"), (F.col("user_id") % 4).cast("string"))
         .alias("channel_name"),
        (k % 3).alias("parent_channel_id"),
        (k % CHANNEL_COUNT).alias("channel_order"),
        (F.col("user_id") % 7).cast("long").alias("total_clients"),
        (F.floor(F.unix_timestamp(F.col("ts")) / p) * p).cast("long").alias("last_updated"),
        F.col("event_id").alias("_seq"))


def client_payloads(pr: Presence) -> DataFrame:
    """Stand-in poll documents: every poll's client list as one JSON text.

    Numbers are written as JSON numbers except the talker flag (text), NULL
    fields are left out, and the list is in row-id order.  Empty polls give an
    empty list.
    """
    c = F.col
    record = F.struct(
        c("id").alias("clid"), c("channel_id").alias("cid"), c("client_database_id"),
        c("nickname").alias("client_nickname"), c("client_uid").alias("client_unique_identifier"),
        c("idle_ms").alias("client_idle_time"), F.lit(0).alias("client_type"),
        c("is_away").cast("int").alias("client_away"), c("away_message").alias("client_away_message"),
        c("is_talking").cast("int").cast("string").alias("client_is_talker"),
        c("input_muted").cast("int").alias("client_input_muted"),
        c("output_muted").cast("int").alias("client_output_muted"),
        c("is_recording").cast("int").alias("client_is_recording"),
        c("server_groups").alias("client_servergroups"),
        c("connected_time").alias("connection_connected_time"))
    lists = pr.clients.groupBy("snapshot_id").agg(F.array_sort(F.collect_list(record)).alias("body"))
    docs = (pr.snapshots.select("snapshot_id", "ts").join(lists, "snapshot_id", "left")
            .select(c("ts").alias("poll_ts"),
                    F.to_json(F.struct(F.struct(F.lit(0).alias("code"), F.lit("ok").alias("message")).alias("status"),
                                       F.coalesce(c("body"), F.array()).alias("body"))).alias("payload")))
    return docs


# varied documents: rows a document holds at most, and the rules for what is left out or unusual (by row id and part)
PART_ROWS = 50


def varied_payloads(pr: Presence) -> DataFrame:
    """Stand-in poll documents that exercise the ingest rules; a poll comes in parts of at most PART_ROWS rows.

    Part = id div 50.  Parts divisible by 9 are rejected (code 512), of remainder 1 bare lists, of
    remainder 2 without status.  Every fourth part is sent twice; parts of remainder 1 by 6 (no bare lists) a
    second time under another part name.  Polls with an id divisible by 5 also have an empty document.  By id: divisible by 11 is a
    service client, remainder 1 has no type, divisible by 13 no uid, by 17 no nickname, by 19 no channel, by 7 no
    away message, by 5 an away flag that is no number.
    """
    c, i = F.col, F.col("id")

    def unless(n: int, value: Column) -> Column:
        return F.when(i % n != 0, value)

    record = F.struct(
        F.lpad(i.cast("string"), 12, "0").alias("clid"), unless(19, c("channel_id")).alias("cid"), c("client_database_id"),
        unless(17, c("nickname")).alias("client_nickname"), unless(13, c("client_uid")).alias("client_unique_identifier"),
        c("idle_ms").cast("string").alias("client_idle_time"),
        F.when(i % 11 == 0, F.lit("1")).when(i % 11 != 1, F.lit("0")).alias("client_type"),
        F.when(i % 5 == 0, F.lit("yes")).otherwise(c("is_away").cast("int").cast("string")).alias("client_away"),
        unless(7, c("away_message")).alias("client_away_message"), c("is_talking").cast("int").alias("client_is_talker"),
        c("input_muted").alias("client_input_muted"), c("output_muted").cast("int").cast("double").alias("client_output_muted"),
        c("is_recording").cast("int").alias("client_is_recording"), c("server_groups").alias("client_servergroups"),
        c("connected_time").alias("connection_connected_time"))
    part = F.floor(i / PART_ROWS).cast("long")
    lists = (pr.clients.groupBy(c("ts").alias("poll_ts"), part.alias("part"))
             .agg(F.array_sort(F.collect_list(record)).alias("body")))       # at most PART_ROWS
    status = F.when(c("part") % 9 == 0, F.struct(F.lit("512").alias("code"), F.lit("no such server").alias("message"))) \
        .when(c("part") % 9 != 2, F.struct(F.lit("0").alias("code"), F.lit("ok").alias("message")))
    copies = F.concat(F.array(F.lit("")), F.when(c("part") % 4 == 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")),
                      F.when((c("part") % 6 == 1) & (c("part") % 9 != 1), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))
    sent = lists.select("*", status.alias("status"), F.explode(copies).alias("copy"))
    name = F.concat(F.lpad(c("part").cast("string"), 12, "0"), c("copy")).alias("part")
    text = F.when(c("part") % 9 == 1, F.to_json("body")).otherwise(F.to_json(F.struct(name, "status", "body")))
    none = pr.snapshots.filter(c("snapshot_id") % 5 == 0).select(c("ts").alias("poll_ts"), F.lit('{"status":{"code":0},"body":[]}').alias("payload"))
    return sent.select("poll_ts", text.alias("payload")).unionByName(none)


def channel_payloads(events: DataFrame, poll_interval_s: int = ADAPTER_POLL_INTERVAL_S) -> DataFrame:
    """Stand-in channel-list documents: each poll's observations as one JSON list (event-id order)."""
    obs = channel_observations(events, poll_interval_s)
    c = F.col
    record = F.struct(c("_seq").alias("_order"), c("channel_id").alias("cid"),
                      c("parent_channel_id").alias("pid"), c("channel_name"),
                      c("channel_order").cast("string").alias("channel_order"),
                      c("total_clients"))
    lists = obs.groupBy("last_updated").agg(F.array_sort(F.collect_list(record)).alias("body"))
    return lists.select(c("last_updated").alias("poll_ts"),
                        F.to_json(F.struct(F.struct(F.lit(0).alias("code")).alias("status"), "body"))
                        .alias("payload"))
