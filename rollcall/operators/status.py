"""Presence state: who is online now, away and mute/recording shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions.columns import pct, round2, split_groups
from rollcall.operators.dimension import with_channel_names
from rollcall.operators.sequence import with_latest
from rollcall.tables import Presence, check_limit

# Fixed value: an online user counts as active below this many (rounded) idle minutes.
ACTIVE_IDLE_MINUTES = 5


def latest_snapshot_id(pr: Presence) -> int | None:
    """Largest poll id (the "current" poll)."""
    return pr.latest_poll()[1]


def online_now(pr: Presence, snapshot_id: int | None = None) -> DataFrame:
    """Clients of the latest poll with their full state, by nickname.

    The poll id is resolved first and used as a literal, so the scan of the
    fact is a pushed filter on one poll (and one date partition).
    """
    _, latest_id, latest_date = pr.latest_poll()
    sid = latest_id if snapshot_id is None else int(snapshot_id)
    cs = pr.clients
    if sid is None:
        cs = cs.limit(0)
    else:
        cs = cs.filter(F.col("snapshot_id") == F.lit(sid))
        if sid != latest_id:    # the poll table knows the day of any other poll (one row, by its id)
            found = pr.snapshots.filter(F.col("snapshot_id") == F.lit(sid)).select("event_date").first()
            latest_date = None if found is None else found[0]
        if latest_date is not None and "event_date" in cs.columns:
            cs = cs.filter(F.col("event_date") == F.lit(latest_date))
    idle = F.col("idle_ms")
    conn = F.col("connected_time")
    named = with_channel_names(cs, pr)
    return (named.select(
        "client_uid", "nickname", "channel_id", "channel_name", "idle_ms",
        F.when(idle.isNull() | (idle == 0), F.lit(0.0)).otherwise(round2(idle / 60000.0)).alias("idle_minutes"),
        F.col("is_away").cast("boolean").alias("is_away"),
        F.coalesce(F.col("away_message"), F.lit("")).alias("away_message"),
        F.col("is_talking").cast("boolean").alias("is_talking"),
        F.col("input_muted").cast("boolean").alias("input_muted"),
        F.col("output_muted").cast("boolean").alias("output_muted"),
        F.col("is_recording").cast("boolean").alias("is_recording"),
        split_groups("server_groups").alias("server_groups"),
        "connected_time",
        F.when(conn.isNull() | (conn == 0), F.lit(0.0)).otherwise(round2(conn / 3600.0)).alias("connected_hours"),
        F.col("ts").alias("snapshot_time"),
        "id")
        .orderBy("nickname", "id").drop("id"))


def active_now(pr: Presence, snapshot_id: int | None = None) -> DataFrame:
    """Online users, and those not away with idle below five (rounded) minutes."""
    now = online_now(pr, snapshot_id)
    return now.agg(
        F.count(F.lit(1)).alias("online_users"),
        F.count_if(~F.col("is_away") & (F.col("idle_minutes") < ACTIVE_IDLE_MINUTES)).alias("active_users"))


def away_summary(pr: Presence, days: int | None = 7, as_of: int | None = None) -> DataFrame:
    """Share of client samples flagged away; zeros on an empty range."""
    rng = pr.time_range(days, as_of)
    return (pr.clients_in(rng)
            .agg(F.count(F.lit(1)).alias("total_samples"),
                 F.count_if(F.col("is_away")).alias("away_samples"))
            .withColumn("away_percentage", pct("away_samples", "total_samples")))


def top_away_users(pr: Presence, days: int | None = 7, limit: int = 10, min_samples: int = 10,
                   as_of: int | None = None) -> DataFrame:
    """Most-away users among samples carrying an away message.

    The base of the percentage is the samples with a message, and a user needs
    more than ``min_samples`` of them.
    """
    check_limit(limit)
    rng = pr.time_range(days, as_of)
    cs = pr.clients_in(rng).filter(F.col("away_message").isNotNull() & (F.col("away_message") != ""))
    order = F.desc("away_count"), F.asc("client_uid")
    top = (cs.groupBy("client_uid")
           .agg(F.count(F.lit(1)).alias("total_samples"),
                F.count_if(F.col("is_away")).alias("away_count"), F.max("ts").alias("last_seen"))
           .filter(F.col("total_samples") > min_samples)
           .orderBy(*order).limit(limit))
    return (with_latest(top, cs, "nickname", "away_message")
            .select("client_uid", "nickname", "total_samples", "away_count",
                    pct("away_count", "total_samples").alias("away_percentage"),
                    F.col("away_message").alias("last_away_message"))
            .orderBy(*order))


def mute_summary(pr: Presence, days: int | None = 7, as_of: int | None = None) -> DataFrame:
    """Shares of samples with microphone muted, speakers muted, recording, talking."""
    rng = pr.time_range(days, as_of)
    counts = pr.clients_in(rng).agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(F.col("input_muted")).alias("_mic"),
        F.count_if(F.col("output_muted")).alias("_spk"),
        F.count_if(F.col("is_recording")).alias("_rec"),
        F.count_if(F.col("is_talking")).alias("_talk"))
    return counts.select(
        "total_samples",
        pct("_mic", "total_samples").alias("mic_muted_percentage"),
        pct("_spk", "total_samples").alias("speaker_muted_percentage"),
        pct("_rec", "total_samples").alias("recording_percentage"),
        pct("_talk", "total_samples").alias("talking_percentage"))
