"""Per-user questions: top users, profiles, favourite channels, weekdays,
idle users, recorders and growth (new versus returning)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions.columns import pct, round2
from rollcall.functions.time import weekday_sun0
from rollcall.operators.dimension import with_channel_names
from rollcall.operators.sequence import with_latest
from rollcall.operators.summaries import user_channel_rows, user_rows
from rollcall.tables import Presence, check_limit


def top_users(pr: Presence, days: int | None = 7, limit: int = 10,
              as_of: int | None = None) -> DataFrame:
    """Users ranked by samples (online time = samples x poll interval)."""
    check_limit(limit)
    p = pr.poll_interval_s
    rng = pr.time_range(days, as_of)
    cs = pr.clients_in(rng)
    order = F.desc("sample_count"), F.asc("client_uid")
    top = (cs.groupBy("client_uid")
           .agg(F.count(F.lit(1)).alias("sample_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
           .orderBy(*order).limit(limit))
    secs = F.col("sample_count") * p
    minutes = secs / 60.0
    return with_latest(top, cs, "nickname").select(
        "client_uid", "nickname", "sample_count",
        secs.cast("long").alias("online_seconds"),
        round2(minutes).alias("online_minutes"),
        round2(minutes / 60.0).alias("online_hours"),
        "first_seen", "last_seen").orderBy(*order)


def user_profile(pr: Presence, client_uid: str | None = None, days: int | None = 30,
                 as_of: int | None = None) -> DataFrame:
    """Basic per-user stats; one row per user seen in the range (or the one asked for)."""
    p = pr.poll_interval_s
    rng = pr.time_range(days, as_of)
    cs = pr.clients_in(rng)
    if client_uid is not None:
        cs = cs.filter(F.col("client_uid") == client_uid)
    per_user = (cs.groupBy("client_uid")
                .agg(F.count(F.lit(1)).alias("sample_count"),
                     F.min("ts").alias("first_seen"),
                     F.max("ts").alias("last_seen"),
                     F.avg("idle_ms").alias("_avg_idle")))
    secs = F.col("sample_count") * p
    return with_latest(per_user, cs, "nickname").select(
        "client_uid", "nickname", "sample_count",
        secs.cast("long").alias("online_seconds"),
        round2(secs / 3600.0).alias("online_hours"),
        "first_seen", "last_seen",
        F.coalesce(F.col("_avg_idle"), F.lit(0.0)).cast("long").alias("avg_idle_ms"))


def favorite_channels(pr: Presence, client_uid: str | None = None, days: int | None = 30,
                      k: int = 5, as_of: int | None = None) -> DataFrame:
    """Top ``k`` channels per user by samples, with channel names."""
    rows = user_channel_rows(pr, pr.time_range(days, as_of))
    if client_uid is not None:
        rows = rows.filter(F.col("client_uid") == client_uid)
    visits = rows.groupBy("client_uid", "channel_id").agg(F.sum("n").cast("long").alias("visits"))
    w = Window.partitionBy("client_uid").orderBy(F.desc("visits"), F.asc("channel_id"))
    top = visits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return with_channel_names(top, pr).select(
        "client_uid", F.col("rank").cast("int").alias("rank"), "channel_id", "channel_name", "visits")


def user_weekday_activity(pr: Presence, client_uid: str | None = None, days: int | None = 30,
                          as_of: int | None = None) -> DataFrame:
    """Samples per UTC weekday (0 = Sunday); weekdays without samples are absent."""
    rng = pr.time_range(days, as_of)
    cs = pr.clients_in(rng)
    if client_uid is not None:
        cs = cs.filter(F.col("client_uid") == client_uid)
    return (cs.groupBy("client_uid", weekday_sun0("ts").alias("day_of_week"))
            .agg(F.count(F.lit(1)).alias("sample_count")))


def weekday_map(activity: DataFrame) -> DataFrame:
    """Nested form of :func:`user_weekday_activity`: one map per user."""
    return activity.groupBy("client_uid").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("day_of_week", "sample_count"))))
        .alias("activity_by_day_of_week"))


def user_stats(pr: Presence, client_uid: str, days: int | None = 30,
               as_of: int | None = None) -> DataFrame:
    """Profile of one user with favourite channels and weekday map nested in."""
    rng = pr.time_range(days, as_of)
    prof = user_profile(pr, client_uid, days, rng.t1)
    fav = (favorite_channels(pr, client_uid, days, 5, rng.t1)
           .groupBy("client_uid")
           .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "channel_id", "channel_name", "visits"))),
                            lambda s: F.struct(s["channel_id"].alias("channel_id"),
                                               s["channel_name"].alias("channel_name"),
                                               s["visits"].alias("visits"))).alias("favorite_channels")))
    dow = weekday_map(user_weekday_activity(pr, client_uid, days, rng.t1))
    return prof.join(fav, "client_uid", "left").join(dow, "client_uid", "left")


def top_idle_users(pr: Presence, days: int | None = 7, limit: int = 10, min_samples: int = 10,
                   as_of: int | None = None) -> DataFrame:
    """Highest mean idle time among users with more than ``min_samples`` idle readings."""
    check_limit(limit)
    rng = pr.time_range(days, as_of)
    cs = pr.clients_in(rng).filter(F.col("idle_ms").isNotNull())
    order = F.desc("_avg"), F.asc("client_uid")
    top = (cs.groupBy("client_uid")
           .agg(F.avg("idle_ms").alias("_avg"), F.count(F.lit(1)).alias("sample_count"), F.max("ts").alias("last_seen"))
           .filter(F.col("sample_count") > min_samples)
           .orderBy(*order).limit(limit))
    return (with_latest(top, cs, "nickname")
            .select("client_uid", "nickname",
                    F.col("_avg").cast("long").alias("avg_idle_ms"),
                    round2(F.col("_avg") / 60000.0).alias("avg_idle_minutes"),
                    "sample_count", "_avg")
            .orderBy(*order).drop("_avg"))


def top_recorders(pr: Presence, days: int | None = 7, limit: int = 10,
                  as_of: int | None = None) -> DataFrame:
    """Users with recording samples, most first."""
    check_limit(limit)
    rng = pr.time_range(days, as_of)
    cs = pr.clients_in(rng)
    order = F.desc("recording_count"), F.asc("client_uid")
    top = (cs.groupBy("client_uid")
           .agg(F.count(F.lit(1)).alias("total_samples"), F.max("ts").alias("last_seen"),
                F.count_if(F.col("is_recording")).alias("recording_count"))
           .filter(F.col("recording_count") > 0)
           .orderBy(*order).limit(limit))
    return (with_latest(top, cs, "nickname")
            .select("client_uid", "nickname", "recording_count",
                    pct("recording_count", "total_samples").alias("recording_percentage"))
            .orderBy(*order))


def first_seen(pr: Presence) -> DataFrame:
    """All-time first sample per user; keep it as a side table at scale."""
    return pr.clients.groupBy("client_uid").agg(F.min("ts").alias("first_ts"))


def merge_first_seen(first_seen_table: DataFrame, new_clients: DataFrame) -> DataFrame:
    """Fold newly ingested client rows into the first-seen table (one row per user).

    New rows are pre-aggregated per user before the union, so the shuffle
    carries at most one row per user from each side.
    """
    fresh = new_clients.groupBy("client_uid").agg(F.min("ts").alias("first_ts"))
    return (first_seen_table.select("client_uid", "first_ts").unionByName(fresh)
            .groupBy("client_uid").agg(F.min("first_ts").alias("first_ts")))


def growth_metrics(pr: Presence, days: int = 7, as_of: int | None = None,
                   first_seen_table: DataFrame | None = None) -> DataFrame:
    """Active, new (first sample ever inside the range) and returning users.

    The all-time first sample comes from ``first_seen_table``, else from the
    table set's ``first_seen``, else it is computed from every client row; with
    a side table the scan of the fact stays inside the range.
    """
    if days is None or days < 1:
        raise ValueError("days must be >= 1")
    rng = pr.time_range(days, as_of)
    active = (user_rows(pr, rng).select("client_uid").distinct()
              .agg(F.count(F.lit(1)).alias("total_unique_users")))
    fs = first_seen_table if first_seen_table is not None else (
        pr.first_seen if pr.first_seen is not None else first_seen(pr))
    new = fs.filter(rng.contains("first_ts")).agg(F.count(F.lit(1)).alias("new_users")).scalar()
    return (active.withColumn("new_users", new)
            .select(F.col("total_unique_users"), F.col("new_users"),
                    (F.col("total_unique_users") - F.col("new_users")).alias("returning_users"),
                    pct("new_users", "total_unique_users").alias("new_user_percentage")))
