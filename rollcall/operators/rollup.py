"""Daily per-user rollup (the ``user_aggregates`` table).

Per user and UTC day (half-open ``[00:00, 24:00)``): largest nickname, samples,
online seconds, mean idle (double), the most visited channel of that day
(ties to the smaller channel id) and the five flag counts.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions.time import day_bounds, utc_date, utc_day
from rollcall.operators.summaries import user_channel_rows
from rollcall.tables import Presence

_FLAGS = ("is_away", "is_talking", "input_muted", "output_muted", "is_recording")


def daily_user_rollup(pr: Presence, dates: list[_dt.date] | None = None, compat: bool = False) -> DataFrame:
    """Rows for the given UTC dates (all dates when ``None``).

    Aggregation levels, no join: (user, day, channel, nickname) counts over
    the rows, then (user, day, channel), then (user, day) totals with the modal
    channel taken as an arg-max.  The nickname is a grouping key at the first
    level, so the pass over all rows is a hash aggregate (fixed-width buffers
    only); the string maximum runs on the reduced rows.

    ``compat=True`` reproduces the established store's rollup: a day runs
    from midnight to the next midnight inclusive (a sample exactly at
    midnight counts in both days) and the most visited channel is the user's
    modal channel over all their rows, not that day's.
    """
    p = pr.poll_interval_s
    cs = pr.clients
    if compat:
        if dates is not None:   # the days themselves, and the next days for their first second
            cs = cs.filter(F.col("event_date").isin(sorted({d + _dt.timedelta(days=k) for d in dates for k in (0, 1)})))
        # a sample at midnight also belongs to the day before
        day = utc_date("ts")
        at_midnight = F.pmod(F.col("ts"), F.lit(86400)) == 0
        cs = cs.withColumn("_day", F.explode(F.when(at_midnight, F.array(day, F.date_sub(day, 1)))
                                             .otherwise(F.array(day))))
        if dates is not None:
            cs = cs.filter(F.col("_day").isin(list(dates)))
    else:
        if dates is not None:
            cs = cs.filter(F.col("event_date").isin(list(dates)))
        cs = cs.withColumn("_day", utc_date("ts"))
    per_name = (cs.groupBy("client_uid", "_day", "channel_id", "nickname")
                .agg(F.count(F.lit(1)).alias("_n"),
                     F.sum("idle_ms").alias("_idle_sum"),
                     F.count("idle_ms").alias("_idle_n"),
                     *[F.count_if(F.col(f)).alias(f"_{f}") for f in _FLAGS]))
    per_channel = (per_name.groupBy("client_uid", "_day", "channel_id")
                   .agg(F.sum("_n").alias("_n"), F.max("nickname").alias("_nick"),
                        F.sum("_idle_sum").alias("_idle_sum"), F.sum("_idle_n").alias("_idle_n"),
                        *[F.sum(f"_{f}").alias(f"_{f}") for f in _FLAGS]))
    mode_key = F.struct(F.col("_n"), (-F.col("channel_id")).alias("_neg_channel"))
    per_day = (per_channel.groupBy("client_uid", "_day")
               .agg(F.max("_nick").alias("nickname"),
                    F.sum("_n").cast("long").alias("total_samples"),
                    F.sum("_idle_sum").alias("_idle_sum"),
                    F.sum("_idle_n").alias("_idle_n"),
                    F.max_by("channel_id", mode_key).alias("most_visited_channel_id"),
                    *[F.sum(f"_{f}").cast("long").alias(f"{f}_count") for f in _FLAGS]))
    if compat:
        # modal channel over each user's whole history (ties: the smaller id); kept days by their counts per user and channel
        all_time = (user_channel_rows(pr, pr.time_range(None)).groupBy("client_uid", "channel_id").agg(F.sum("n").alias("_n"))
                    .groupBy("client_uid")
                    .agg(F.max_by("channel_id", F.struct(F.col("_n"), (-F.col("channel_id")).alias("_neg")))
                         .alias("_mode")))
        per_day = (per_day.join(all_time, "client_uid", "left")
                   .withColumn("most_visited_channel_id", F.col("_mode")).drop("_mode"))
    return per_day.select(
        "client_uid", F.col("_day").alias("date"), "nickname", "total_samples",
        (F.col("total_samples") * p).cast("long").alias("online_seconds"),
        F.try_divide(F.col("_idle_sum").cast("double"), F.col("_idle_n").cast("double")).alias("avg_idle_ms"),
        "most_visited_channel_id", *[f"{f}_count" for f in _FLAGS])


def write_user_daily(rollup: DataFrame, path: str) -> None:
    """Upsert by day: only the days present in ``rollup`` are replaced; files hold runs of users of few days."""
    (rollup.repartitionByRange("date", "client_uid").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic")
     .partitionBy("date").parquet(path))


def previous_day(as_of: int) -> _dt.date:
    """The UTC day before ``as_of``: the day a periodic rollup job (re)computes."""
    return utc_day(as_of) - _dt.timedelta(days=1)


def rollup_of_day(pr: Presence, date: str, compat: bool = False) -> DataFrame:
    """Rollup rows of one UTC day given as ``YYYY-MM-DD``."""
    return daily_user_rollup(pr, [utc_day(day_bounds(date)[0])], compat)


def rollup_previous_day(pr: Presence, as_of: int | None = None) -> DataFrame:
    """Rollup rows of the day before ``as_of`` (default: the latest poll); upsert them with
    :func:`write_user_daily`.  Re-running it replaces that day only."""
    as_of = pr.latest_ts() if as_of is None else as_of
    return daily_user_rollup(pr, [previous_day(as_of or 0)])
