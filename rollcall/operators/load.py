"""Server load over time, from the snapshot table (empty polls count)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions.columns import round2
from rollcall.functions.time import day_name, hour_utc, iso_datetime, weekday_sun0
from rollcall.operators.summaries import user_rows, users_in
from rollcall.tables import Presence, TimeRange, check_limit

# Fixed value: width of the relative-load bar.
BAR_WIDTH = 30


def hourly_heatmap(pr: Presence, days: int | None = 7, as_of: int | None = None) -> DataFrame:
    """Mean concurrent clients per UTC hour of day; hours without polls are absent."""
    rng = pr.time_range(days, as_of)
    return (pr.snapshots_in(rng)
            .groupBy(hour_utc("ts").alias("hour"))
            .agg(round2(F.avg("total_clients")).alias("avg_clients"),
                 F.count(F.lit(1)).alias("sample_count"))
            .orderBy("hour"))


def daily_activity(pr: Presence, days: int | None = 30, as_of: int | None = None) -> DataFrame:
    """Mean concurrent clients per UTC weekday (0 = Sunday) with its name."""
    rng = pr.time_range(days, as_of)
    return (pr.snapshots_in(rng)
            .groupBy(weekday_sun0("ts").alias("day_of_week"))
            .agg(round2(F.avg("total_clients")).alias("avg_clients"),
                 F.count(F.lit(1)).alias("sample_count"))
            .select("day_of_week", day_name("day_of_week").alias("day_name"),
                    "avg_clients", "sample_count")
            .orderBy("day_of_week"))


def relative_load(df: DataFrame, value: str = "avg_clients", width: int = BAR_WIDTH) -> DataFrame:
    """Adds ``bar`` = ``int(value / max(value) * width)``, 0 when the maximum is 0.

    The maximum is a scalar subquery over the (already aggregated) curve.
    """
    mx = F.col("_max")
    ratio = F.try_divide(F.col(value).cast("double"), mx.cast("double")) * width
    return (df.withColumn("_max", df.agg(F.max(value)).scalar())
            .withColumn("bar", F.when(mx > 0, ratio.cast("long")).otherwise(F.lit(0)).cast("int"))
            .drop("_max"))


def peak_times(pr: Presence, days: int | None = 7, limit: int = 10,
               as_of: int | None = None) -> DataFrame:
    """Polls with the most clients (latest first among ties)."""
    check_limit(limit)
    rng = pr.time_range(days, as_of)
    return (pr.snapshots_in(rng)
            .select(F.col("ts").alias("timestamp"), iso_datetime("ts").alias("datetime"), "total_clients")
            .orderBy(F.desc("total_clients"), F.desc("timestamp"))
            .limit(limit))


def poll_summary(pr: Presence, rng: TimeRange) -> DataFrame:
    """Poll count, mean and peak concurrency; always one row."""
    return pr.snapshots_in(rng).agg(
        F.count(F.lit(1)).alias("total_snapshots"),
        round2(F.coalesce(F.avg("total_clients"), F.lit(0.0))).alias("avg_users_online"),
        F.coalesce(F.max("total_clients"), F.lit(0)).cast("long").alias("max_users_online"))


def summary(pr: Presence, days: int | None = 7, as_of: int | None = None) -> DataFrame:
    """Poll count, mean and peak concurrency, distinct users; always one row."""
    rng = pr.time_range(days, as_of)
    polls = poll_summary(pr, rng)
    users = user_rows(pr, rng).select("client_uid").distinct().agg(F.count(F.lit(1))).scalar()
    return polls.withColumn("unique_users", users)


def unique_users_estimate(pr: Presence, days: int | None = 7, as_of: int | None = None) -> DataFrame:
    """Samples and estimated distinct users of a range from mergeable sketches; one row, zeros on an empty range."""
    return users_in(pr, pr.time_range(days, as_of)).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_samples"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).cast("long").alias("unique_users_estimate"))


def dataset_stats(pr: Presence) -> DataFrame:
    """Whole-table counts and the first/last poll time (no time range)."""
    polls = pr.snapshots.agg(F.count(F.lit(1)).alias("snapshot_count"),
                             F.min("ts").alias("first_snapshot_timestamp"),
                             F.max("ts").alias("last_snapshot_timestamp"))
    rows = pr.clients.agg(F.count(F.lit(1))).scalar()
    # one row per user in the first-seen side table, when the table set has one
    users = (pr.first_seen.agg(F.count(F.lit(1))).scalar() if pr.first_seen is not None
             else pr.clients.select("client_uid").distinct().agg(F.count(F.lit(1))).scalar())
    return polls.select("snapshot_count", rows.alias("client_snapshot_count"), users.alias("unique_clients"),
                        "first_snapshot_timestamp", "last_snapshot_timestamp")
