"""Engagement ("lifetime value") score per user and its distribution.

Per user over the range: samples ``n``, distinct UTC days ``d``, distinct
channels ``c``, talking samples ``k``, sessions ``s``.  The score is

    trunc(40*n/max n + 30*d/max d + 20*k/max k + 10*c/max c)

with maxima over all users in the range (before the ``n > 5`` filter) and the
talking term 0 when nobody talked.  80 and above is a power user, 50 and above
regular, the rest casual.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions.columns import pct, round2, safe_div
from rollcall.operators import summaries
from rollcall.operators.sequence import Kept, SLICE_POLLS, day_runs, slice_polls_for
from rollcall.tables import Presence, check_limit

# Fixed values of the engagement score: term weights (samples, active days,
# talking samples, distinct channels), the minimum samples to be scored, and
# the categories as (code, label, lowest score), highest first.
WEIGHTS = (40, 30, 20, 10)
MIN_SAMPLES = 5
CATEGORIES = [
    ("power_user", "Power User", 80),
    ("regular", "Regular User", 50),
    ("casual", "Casual User", 0),
]


def _category(score, field: int) -> F.Column:
    """Code (``field=0``) or label (``field=1``) of the first category whose lowest score is reached."""
    expr = None
    for entry in CATEGORIES[:-1]:
        cond = score >= entry[2]
        expr = F.when(cond, entry[field]) if expr is None else expr.when(cond, entry[field])
    return expr.otherwise(CATEGORIES[-1][field])


_CHANNELS = Kept("_channels", "channel_id", "set", "set")    # at most one entry per sample of the slice or day


def _users(pr: Presence, days: int | None, slice_polls: int, as_of: int | None) -> DataFrame:
    """Per-user totals over the range.

    Days with summaries contribute their runs and their (user, channel) rows,
    the others the facts, read once: a day's run carries its channels, and the first of
    them carries the day's totals, so that one grouping by (user, channel) and one by user give both,
    without a set that grows with a user's history.
    """
    p, rng = pr.poll_interval_s, pr.time_range(days, as_of)
    kept_days, facts = summaries.split(pr, rng)
    totals = tuple(k for k in summaries.TOTALS if k.name in ("_nick_max", "_talk", "_idle_sum", "_idle_n"))
    names = [k.name for k in totals]
    runs = None
    if facts is not None:
        runs = day_runs(facts, p, slice_polls_for(pr, slice_polls), (*totals, _CHANNELS)).select(
            *summaries.RUN_COLUMNS, *names, "_channels")
    if kept_days:
        stored = summaries.stored_runs(pr, kept_days).select(*summaries.RUN_COLUMNS, *names,
                                                             F.array().cast("array<long>").alias("_channels"))
        runs = stored if runs is None else stored.unionByName(runs)
    w = Window.partitionBy("client_uid").orderBy("_day")
    gap = F.coalesce((F.col("_first_ts") - F.lag("_last_ts").over(w)) > 2 * p, F.lit(True)).cast("long")   # a user's first sample starts a session
    entries = (runs.withColumn("_sessions", F.col("_starts") + gap)
               .select("client_uid", "_n", "_sessions", "_first_ts", "_last_ts", *names, F.posexplode_outer("_channels").alias("_at", "channel_id")))
    head = F.coalesce(F.col("_at") == 0, F.lit(True))       # one entry per day carries its totals
    sums = {"_n": "_n", "_sessions": "_sessions", "_talk": "_talk", "_idle_sum": "_idle_sum", "_idle_n": "_idle_n"}
    per_channel = entries.groupBy("client_uid", "channel_id").agg(
        *[F.sum(F.when(head, F.col(c))).alias(c) for c in sums], F.count_if(head).alias("_days"),
        F.min("_first_ts").alias("_first_ts"), F.max("_last_ts").alias("_last_ts"), F.max("_nick_max").alias("_nick_max"))
    if kept_days:
        # (user, channel) rows of the kept days join in as entries without totals
        more = summaries.stored_channels(pr, kept_days).select("client_uid", "channel_id").distinct()
        more = more.select("client_uid", "channel_id", *[F.lit(None).cast(per_channel.schema[c].dataType).alias(c)
                                                         for c in per_channel.columns if c not in ("client_uid", "channel_id")])
        per_channel = per_channel.unionByName(more)
        channels = F.countDistinct("channel_id")
    else:
        channels = F.count("channel_id")
    return per_channel.groupBy("client_uid").agg(
        F.sum("_n").cast("long").alias("total_samples"), F.sum("_sessions").cast("long").alias("session_count"),
        F.sum("_days").cast("long").alias("days_active"), F.min("_first_ts").alias("first_seen"), F.max("_last_ts").alias("last_seen"),
        F.max("_nick_max").alias("nickname"), F.sum("_talk").cast("long").alias("talking_samples"),
        F.sum("_idle_sum").alias("_idle_sum"), F.sum("_idle_n").alias("_idle_n"), channels.cast("long").alias("channels_visited"))


def ltv_scores(pr: Presence, days: int | None = None, slice_polls: int = SLICE_POLLS,
               as_of: int | None = None) -> DataFrame:
    """All scored users (``n > 5``) with every derived column; unordered.

    Nothing is cached: every call reads the tables as they are, once for the
    users' rows and once (fewer columns) for the normalizers; days with
    summaries are read from these.
    """
    p = pr.poll_interval_s
    users = _users(pr, days, slice_polls, as_of)
    # normalizers: one scalar subquery over the per-user rows (maxima before the
    # n > 5 filter), attached once as a column so it is evaluated once
    norms = users.agg(F.struct(F.max("total_samples").alias("mn"), F.max("days_active").alias("md"),
                               F.max("talking_samples").alias("mk"), F.max("channels_visited").alias("mc"))
                      ).scalar()
    n, d = F.col("total_samples").cast("double"), F.col("days_active").cast("double")
    k, c = F.col("talking_samples").cast("double"), F.col("channels_visited").cast("double")
    mn, md, mk, mc = (F.col(f"_norms.{f}") for f in ("mn", "md", "mk", "mc"))
    w_n, w_d, w_k, w_c = WEIGHTS
    talk_term = F.when(mk > 0, k / mk * w_k).otherwise(F.lit(0.0))
    raw = ((n / mn * w_n) + (d / md * w_d)) + talk_term + (c / mc * w_c)
    scored = (users
              .filter(F.col("total_samples") > MIN_SAMPLES)
              .withColumn("_norms", norms)
              .withColumn("ltv_score", raw.cast("long")))
    avg_idle = safe_div("_idle_sum", "_idle_n")
    hours = F.col("total_samples") * p / 3600.0
    span_days = (F.col("last_seen") - F.col("first_seen")) / 86400.0
    category = _category(F.col("ltv_score"), 0)
    label = _category(F.col("ltv_score"), 1)
    return scored.select(
        "client_uid", "nickname", "ltv_score",
        category.alias("category"), label.alias("category_label"),
        "total_samples", round2(hours).alias("online_hours"), "days_active",
        F.when(span_days > 0, round2(F.col("days_active") / span_days * 100)).otherwise(F.lit(0.0))
         .alias("activity_frequency_percent"),
        "channels_visited", "talking_samples",
        pct("talking_samples", "total_samples").alias("talking_percentage"),
        F.when(avg_idle.isNull() | (avg_idle == 0), F.lit(0.0)).otherwise(round2(avg_idle / 60000.0))
         .alias("avg_idle_minutes"),
        "session_count",
        F.when(F.col("session_count") > 0, round2(hours / F.col("session_count"))).otherwise(F.lit(0.0))
         .alias("avg_session_length_hours"),
        "first_seen", "last_seen")


def lifetime_value(pr: Presence, days: int | None = None, limit: int = 50,
                   slice_polls: int = SLICE_POLLS, as_of: int | None = None) -> DataFrame:
    """Top ``limit`` users by score (ties by user id)."""
    check_limit(limit)
    return (ltv_scores(pr, days, slice_polls, as_of)
            .orderBy(F.desc("ltv_score"), F.asc("client_uid"))
            .limit(limit))


def ltv_summary(pr: Presence, days: int | None = None, slice_polls: int = SLICE_POLLS,
                as_of: int | None = None) -> DataFrame:
    """Score distribution over every scored user; zeros when there is none."""
    scores = ltv_scores(pr, days, slice_polls, as_of)
    agg = scores.agg(
        F.count(F.lit(1)).alias("total_users"),
        F.avg("ltv_score").alias("_avg"),
        *[F.count_if(F.col("category") == code).alias(f"{name}_users")
          for (code, _, _), name in zip(CATEGORIES, ("power", "regular", "casual"))])
    return agg.select(
        "total_users",
        F.coalesce(round2("_avg"), F.lit(0.0)).alias("avg_ltv_score"),
        "power_users", pct("power_users", "total_users").alias("power_users_percent"),
        "regular_users", pct("regular_users", "total_users").alias("regular_users_percent"),
        "casual_users", pct("casual_users", "total_users").alias("casual_users_percent"))
