"""Benchmark: registered questions over presence tables stored as parquet.

The presence tables are derived once from ``$BENCH_SF_DIR`` (events, nation)
and written as date-partitioned parquet in a fresh folder under the session's
checkpoint folder, with the summaries of their days (both timed as ``ingest``, after an untimed warm-up
job); every question then reads those tables, as it would in production.  Each
question is run once to warm up and timed as the median of three runs executed
with the ``noop`` sink.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import uuid
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from rollcall.jobs import refresh_summaries  # noqa: E402
from rollcall.operators import channels, load, ltv, maintenance, metrics, rollup, sequence, status, users  # noqa: E402
from rollcall.session import build_session, checkpoint_dir  # noqa: E402
from rollcall.sources.events_adapter import ADAPTER_POLL_INTERVAL_S, load_adapter  # noqa: E402
from rollcall.sources.parquet import load_presence, write_presence  # noqa: E402
from rollcall.tables import Presence  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
# Scale experiment only: replicate the presence facts this many times with
# distinct users per copy (default 1 = the tables as given).
REPLICATE = int(os.environ.get("BENCH_REPLICATE", "1"))


def questions(pr):
    s, lg = 7, 30
    return {
        "top_users": lambda: users.top_users(pr, s, 10),
        "user_profile": lambda: users.user_profile(pr, None, lg),
        "favorite_channels": lambda: users.favorite_channels(pr, None, lg, 5),
        "hourly_heatmap": lambda: load.hourly_heatmap(pr, s),
        "daily_activity": lambda: load.daily_activity(pr, lg),
        "peak_times": lambda: load.peak_times(pr, s, 10),
        "summary": lambda: load.summary(pr, s),
        "channel_stats": lambda: channels.channel_stats(pr, s),
        "server_group_stats": lambda: channels.server_group_stats(pr, s),
        "growth_metrics": lambda: users.growth_metrics(pr, s),
        "online_now": lambda: status.online_now(pr),
        "mute_summary": lambda: status.mute_summary(pr, s),
        "top_away_users": lambda: status.top_away_users(pr, None, 10),
        "channel_switches": lambda: sequence.channel_switches(pr, s, 10),
        "session_counts": lambda: sequence.session_counts(pr, s, 10),
        "sessions": lambda: sequence.sessions(pr, None),
        "lifetime_value": lambda: ltv.lifetime_value(pr, None, 50),
        "ltv_summary": lambda: ltv.ltv_summary(pr, None),
        "daily_user_rollup": lambda: rollup.daily_user_rollup(pr),
        "metrics_snapshot": lambda: metrics.metrics_snapshot(pr, s),
        "retention_report": lambda: maintenance.retention_report(pr, 7),
    }


def timed(fn) -> float:
    t = time.perf_counter()
    fn().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main() -> None:
    spark = build_session(f"local[{CPUS}]", app="rollcall-bench", shuffle_partitions=int(CPUS),
                          extra={"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    root = os.path.join(checkpoint_dir(spark), f"bench-{uuid.uuid4().hex}")
    # untimed warm-up of the JVM and code generation (one small shuffle job)
    spark.range(100_000).groupBy((F.col("id") % 7).alias("k")).count().collect()
    t = time.perf_counter()
    pr = load_adapter(spark, SF_DIR)
    if REPLICATE > 1:
        copy = F.explode(F.sequence(F.lit(0), F.lit(REPLICATE - 1)))
        cs = (pr.clients.withColumn("_copy", copy)
              .withColumn("client_uid", F.concat("client_uid", F.lit("_"), F.col("_copy").cast("string")))
              .withColumn("id", F.col("id") * REPLICATE + F.col("_copy")).drop("_copy"))
        snaps = pr.snapshots.withColumn("total_clients", F.col("total_clients") * REPLICATE)
        pr = Presence(snaps, cs, pr.channels, pr.poll_interval_s)
    write_presence(pr, root)
    refresh_summaries(spark, root, ADAPTER_POLL_INTERVAL_S)
    ingest = time.perf_counter() - t
    pr = load_presence(spark, root, ADAPTER_POLL_INTERVAL_S)
    out = {"ingest": round(ingest, 3)}
    for name, fn in questions(pr).items():
        timed(fn)
        out[name] = round(statistics.median(timed(fn) for _ in range(RUNS)), 3)
    total = round(sum(out.values()), 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": total, "unit": "sec",
                      "queries": out, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": int(CPUS), **({"replicate": REPLICATE} if REPLICATE > 1 else {})}))


if __name__ == "__main__":
    main()
