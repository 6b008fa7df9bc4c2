"""The registered questions: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Inputs are the presence tables derived from the test tables (``events`` and
``nation``) by :mod:`rollcall.sources.events_adapter`; ``as_of`` is the last
poll time, and the look-back windows cut the month of data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.operators import channels, load, ltv, maintenance, metrics, rollup, sequence, status, users
from rollcall.sources import events_adapter, payloads
from rollcall.sources.conform import conform_clients
from rollcall.streaming.windows import hourly_concurrency, session_stream
from rollcall.tables import DAY_S, Presence

SHORT_DAYS = 7
LONG_DAYS = 30
RETENTION_DAYS = 7
ROLLUP_DATE = "2024-01-15"
STATS_UID = "guest0"
OLD_LAYOUT_DAYS = 15   # rows older than this many days are stored in the first layout


def _presence(spark: SparkSession, sf_dir: str) -> Presence:
    # no session settings are changed: every time bucket is epoch arithmetic
    return events_adapter.load_adapter(spark, sf_dir)


def _q(fn: Callable[[Presence], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(_presence(spark, sf_dir))
    run.__doc__ = fn.__doc__
    return run


def _online_now_flat(pr: Presence) -> DataFrame:
    return status.online_now(pr).withColumn("server_groups", F.array_join("server_groups", ","))


def _metrics_flat(pr: Presence) -> DataFrame:
    m = metrics.metrics_snapshot(pr, SHORT_DAYS, top_channels=None)
    return m.select("name", F.col("labels")["channel_id"].alias("label_channel_id"),
                    F.col("labels")["channel_name"].alias("label_channel_name"), "value")


def _rollup_flat(pr: Presence, compat: bool = False) -> DataFrame:
    return rollup.daily_user_rollup(pr, compat=compat).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def _channel_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    pr = _presence(spark, sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    updates = events_adapter.channel_observations(events)
    return maintenance.upsert_channels(pr.channels, updates, seq_col="_seq")


def _ingested(spark: SparkSession, sf_dir: str):
    pr = _presence(spark, sf_dir)
    return payloads.ingest_client_payloads(events_adapter.client_payloads(pr))


def _ingest_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir)[1].drop("event_date")


def _ingest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir)[0].drop("event_date")


def _ingest_channel_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return payloads.channel_updates(events_adapter.channel_payloads(events)).withColumnRenamed("_seq", "list_seq")


def _varied(spark: SparkSession, sf_dir: str):
    return events_adapter.varied_payloads(_presence(spark, sf_dir))


def _ingest_rules_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.ingest_client_payloads(_varied(spark, sf_dir))[1].drop("event_date")


def _ingest_rules_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.ingest_client_payloads(_varied(spark, sf_dir))[0].drop("event_date")


def _ingest_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.rejected_polls(_varied(spark, sf_dir))


def _user_stats_flat(pr: Presence) -> DataFrame:
    """The nested answer about one user, lists and map as text."""
    pairs = F.map_entries("activity_by_day_of_week")
    return users.user_stats(pr, STATS_UID, LONG_DAYS).select(
        "client_uid", "nickname", "sample_count", "first_seen", "last_seen", "avg_idle_ms",
        F.array_join(F.transform("favorite_channels", lambda x: F.concat_ws("=", x["channel_name"], x["visits"].cast("string"))), ";")
        .alias("favorites"),
        F.array_join(F.transform(F.array_sort(pairs), lambda x: F.concat_ws("=", x["key"].cast("string"), x["value"].cast("string"))), ";")
        .alias("weekdays"))


def _session_windows(pr: Presence) -> DataFrame:
    """The streaming session windows over the stored rows."""
    timed = pr.clients.withColumn("poll_time", F.timestamp_seconds("ts"))
    return session_stream(timed, pr.poll_interval_s).drop("session_window").select("client_uid", "session_start", "session_end", "samples")


def _hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming hourly windows over the polls' documents."""
    docs = events_adapter.client_payloads(_presence(spark, sf_dir)).withColumn("poll_time", F.timestamp_seconds("poll_ts"))
    return hourly_concurrency(docs).select(F.unix_timestamp("hour.start").alias("hour_start"), "avg_clients", "max_clients", "polls")


def _conform_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pr = _presence(spark, sf_dir)
    cutoff = pr.latest_ts() - OLD_LAYOUT_DAYS * DAY_S
    v1_cols = ["id", "snapshot_id", "ts", "client_uid", "client_database_id", "nickname",
               "channel_id", "idle_ms", "event_date"]
    old = pr.clients.filter(F.col("ts") < cutoff).select(*v1_cols)
    new = pr.clients.filter(F.col("ts") >= cutoff)
    return conform_clients(new, old).drop("event_date")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    s, lg = SHORT_DAYS, LONG_DAYS
    return {
        "top_users": _q(lambda pr: users.top_users(pr, s, 10)),
        "user_profile": _q(lambda pr: users.user_profile(pr, None, lg)),
        "favorite_channels": _q(lambda pr: users.favorite_channels(pr, None, lg, 5)),
        "user_weekday_activity": _q(lambda pr: users.user_weekday_activity(pr, None, lg)),
        "hourly_heatmap": _q(lambda pr: load.hourly_heatmap(pr, s)),
        "daily_activity": _q(lambda pr: load.daily_activity(pr, lg)),
        "hourly_load_bars": _q(lambda pr: load.relative_load(load.hourly_heatmap(pr, s))),
        "daily_load_bars": _q(lambda pr: load.relative_load(load.daily_activity(pr, lg))),
        "top_idle_users": _q(lambda pr: users.top_idle_users(pr, s, 10)),
        "peak_times": _q(lambda pr: load.peak_times(pr, s, 10)),
        "channel_stats": _q(lambda pr: channels.channel_stats(pr, s)),
        "growth_metrics": _q(lambda pr: users.growth_metrics(pr, s)),
        "online_now": _q(_online_now_flat),
        "summary": _q(lambda pr: load.summary(pr, s)),
        "away_summary": _q(lambda pr: status.away_summary(pr, s)),
        "top_away_users": _q(lambda pr: status.top_away_users(pr, s, 10)),
        "top_away_users_all_time": _q(lambda pr: status.top_away_users(pr, None, 10)),
        "mute_summary": _q(lambda pr: status.mute_summary(pr, s)),
        "top_recorders": _q(lambda pr: users.top_recorders(pr, s, 10)),
        "server_group_stats": _q(lambda pr: channels.server_group_stats(pr, s)),
        "server_group_stats_exact": _q(lambda pr: channels.server_group_stats(pr, s, exact=True)),
        "channel_switches": _q(lambda pr: sequence.channel_switches(pr, s, 10)),
        "session_counts": _q(lambda pr: sequence.session_counts(pr, s, 10)),
        "connection_summary": _q(lambda pr: sequence.connection_summary(pr, s)),
        "sessions": _q(lambda pr: sequence.sessions(pr, s)),
        "lifetime_value": _q(lambda pr: ltv.lifetime_value(pr, None, 50)),
        "ltv_summary": _q(lambda pr: ltv.ltv_summary(pr, None)),
        "dataset_stats": _q(load.dataset_stats),
        "list_channels": _q(channels.list_channels),
        "channel_name_lookup": _q(lambda pr: channels.channel_name_lookup(pr, pr.clients)),
        "active_now": _q(status.active_now),
        "metrics_snapshot": _q(_metrics_flat),
        "daily_user_rollup": _q(_rollup_flat),
        "daily_user_rollup_compat": _q(lambda pr: _rollup_flat(pr, compat=True)),
        "channel_upsert": _channel_upsert,
        "retention_report": _q(lambda pr: maintenance.retention_report(pr, RETENTION_DAYS)),
        "ingest_clients": _ingest_clients,
        "ingest_snapshots": _ingest_snapshots,
        "conform_layouts": _conform_layouts,
        "ingest_channel_updates": _ingest_channel_updates,
        "first_seen": _q(users.first_seen),
        "ingest_rules_clients": _ingest_rules_clients,
        "ingest_rules_snapshots": _ingest_rules_snapshots,
        "ingest_rejected": _ingest_rejected,
        "user_stats": _q(_user_stats_flat),
        "retained_clients": _q(lambda pr: maintenance.retain(pr, pr.latest_ts(), RETENTION_DAYS)[0].clients.select("id", "ts", "client_uid")),
        "rollup_of_day": _q(lambda pr: rollup.rollup_of_day(pr, ROLLUP_DATE).withColumn("date", F.date_format("date", "yyyy-MM-dd"))),
        "session_windows": _q(_session_windows),
        "hourly_windows": _hourly_windows,
        "unique_users_estimate": _q(lambda pr: load.unique_users_estimate(pr, s)),
        "channel_users_estimate": _q(lambda pr: channels.channel_users_estimate(pr, s)),
    }
