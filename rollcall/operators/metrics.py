"""Monitoring gauges as one long DataFrame: ``name, labels, value``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.operators.dimension import with_channel_names
from rollcall.operators.load import poll_summary
from rollcall.operators.ltv import ltv_summary
from rollcall.operators.status import active_now
from rollcall.operators.summaries import user_channel_rows
from rollcall.tables import Presence, TimeRange

# Gauge names of the monitoring endpoint.
USERS_TOTAL = "ts_users_total"
AVG_USERS_ONLINE = "ts_avg_users_online"
PEAK_USERS = "ts_peak_users"
USERS_ONLINE = "ts_users_online"
USERS_ONLINE_ACTIVE = "ts_users_online_active"
LTV_POWER = "ts_ltv_power_users"
LTV_REGULAR = "ts_ltv_regular_users"
LTV_CASUAL = "ts_ltv_casual_users"
LTV_AVG = "ts_ltv_avg_score"
CHANNELS_TOTAL = "ts_channels_total"
CHANNEL_VISITS = "ts_channel_visits"
CHANNEL_UNIQUE_USERS = "ts_channel_unique_users"
SNAPSHOTS_TOTAL = "ts_snapshots_total"

# Fixed value: per-channel gauges cover this many most visited channels by default.
TOP_CHANNELS = 20


def _gauges(one_row: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Unpivot named columns of a one-row frame into gauge rows."""
    entries = F.array(*[F.struct(F.lit(name).alias("name"), F.col(col).cast("double").alias("value"))
                        for name, col in pairs])
    return (one_row.select(F.explode(entries).alias("g"))
            .select(F.col("g.name").alias("name"),
                    F.create_map().cast("map<string,string>").alias("labels"),
                    F.col("g.value").alias("value")))


def _user_gauges(pr: Presence, rng: TimeRange, top_channels: int | None) -> DataFrame:
    """Users in all and per channel, visits and the number of channels, from one read of the range.

    (user, channel) counts are grouped once per channel and once in all; the row
    in all sorts first, so that one top-k serves both.
    """
    pairs = user_channel_rows(pr, rng)
    rows = (pairs.groupingSets([("channel_id",), ()], "channel_id")
            .agg(F.grouping("channel_id").alias("all"), F.sum("n").alias("visits"), F.countDistinct("client_uid").alias("users"),
                 F.countDistinct(F.col("channel_id")).alias("channels")))
    if top_channels is not None:
        rows = rows.orderBy(F.desc("all"), F.desc("visits"), F.asc("channel_id")).limit(top_channels + 1)

    def gauge(name: str, value: str) -> Column:
        return F.struct(F.lit(name).alias("name"), F.col(value).cast("double").alias("value"))

    named = with_channel_names(rows, pr)
    found = named.select("channel_id", "channel_name", "all", F.explode(
        F.when(F.col("all") == 1, F.array(gauge(USERS_TOTAL, "users"), gauge(CHANNELS_TOTAL, "channels")))
        .otherwise(F.array(gauge(CHANNEL_VISITS, "visits"), gauge(CHANNEL_UNIQUE_USERS, "users")))).alias("g"))
    labels = F.create_map(F.lit("channel_id"), F.col("channel_id").cast("string"), F.lit("channel_name"), F.col("channel_name"))
    gauges = found.select(F.col("g.name").alias("name"),
                          F.when(F.col("all") == 1, F.create_map().cast("map<string,string>")).otherwise(labels).alias("labels"),
                          F.col("g.value").alias("value"))
    # an empty range has no row in all: zeros instead
    none = pr.clients_in(rng).limit(1).agg(F.count(F.lit(1)).alias("zero")).filter("zero = 0")
    return gauges.unionByName(_gauges(none, [(USERS_TOTAL, "zero"), (CHANNELS_TOTAL, "zero")]))


def metrics_snapshot(pr: Presence, days: int = 7, as_of: int | None = None,
                     score_summary: DataFrame | None = None, top_channels: int | None = TOP_CHANNELS) -> DataFrame:
    """Every gauge: 7-day summary, online now, all-time scores, channel popularity.

    ``score_summary`` (the one-row result of :func:`ltv_summary`, e.g. a table a
    daily job materializes) replaces recomputing the all-time scores here.
    Per-channel gauges cover the ``top_channels`` most visited channels, or
    every channel with ``None``.
    """
    rng = pr.time_range(days, as_of)
    ltv = score_summary if score_summary is not None else ltv_summary(pr, None, as_of=rng.t1)
    parts = [
        _gauges(poll_summary(pr, rng), [(AVG_USERS_ONLINE, "avg_users_online"), (PEAK_USERS, "max_users_online"),
                                        (SNAPSHOTS_TOTAL, "total_snapshots")]),
        _gauges(active_now(pr), [(USERS_ONLINE, "online_users"), (USERS_ONLINE_ACTIVE, "active_users")]),
        _gauges(ltv, [(LTV_POWER, "power_users"), (LTV_REGULAR, "regular_users"),
                      (LTV_CASUAL, "casual_users"), (LTV_AVG, "avg_ltv_score")]),
        _user_gauges(pr, rng, top_channels),
    ]
    return reduce(DataFrame.unionByName, parts)
