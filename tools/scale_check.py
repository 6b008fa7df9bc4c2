"""Scale and skew experiment (not a registered question).

Replicates the sf0.1 presence facts ``R`` times (distinct users per copy) and,
with ``--hot``, gives one user a third (or N tenths) of all rows (many rows per poll).  Runs
the per-user sequence questions and reports wall time and, from Spark's event
log, the largest and median shuffle records read by one task per stage.

    python -m tools.scale_check <scratch_dir> <R> [--hot [--tenths N]]
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollcall.operators import ltv, sequence
from rollcall.session import build_session
from rollcall.sources.events_adapter import ADAPTER_POLL_INTERVAL_S, load_adapter
from rollcall.sources.parquet import load_presence, write_presence
from rollcall.tables import Presence


def naive_switches(pr: Presence):
    """Naive shape for comparison: LAG over each user's whole history (one task per user)."""
    w = Window.partitionBy("client_uid").orderBy("ts", "snapshot_id", "id")
    prev = F.lag("channel_id").over(w)
    return (pr.clients.select("client_uid", "ts", "snapshot_id", "id", "channel_id")
            .withColumn("_sw", F.when(prev.isNotNull() & (F.col("channel_id") != prev), 1).otherwise(0))
            .groupBy("client_uid").agg(F.sum("_sw").alias("channel_switches")))


def stage_skew(log_dir: str, since_stage: int):
    recs = {}
    for path in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        if os.path.isdir(path):
            continue
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                if ev.get("Event") != "SparkListenerTaskEnd" or ev["Stage ID"] < since_stage:
                    continue
                m = ev.get("Task Metrics") or {}
                n = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                recs.setdefault(ev["Stage ID"], []).append(n)
    out = []
    for sid, xs in sorted(recs.items()):
        if max(xs) > 0:
            out.append((sid, len(xs), max(xs), int(statistics.median(xs))))
    return out


def main(argv):
    scratch, reps, hot = argv[1], int(argv[2]), "--hot" in argv
    tenths = int(argv[argv.index("--tenths") + 1]) if "--tenths" in argv else None      # share of the hot identity, instead of a third
    log_dir = os.path.join(scratch, "eventlog")
    os.makedirs(log_dir, exist_ok=True)
    spark = build_session("local[8]", shuffle_partitions=32,
                          extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                 "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false",
                                 "spark.driver.memory": "8g",
                                 "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    base = load_adapter(spark, "/root/testdata/sf0.1")
    cs = base.clients.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    uid = F.concat(F.col("client_uid"), F.lit("_"), F.col("_copy").cast("string"))
    if hot:
        is_hot = F.col("id") % 3 == 0 if tenths is None else F.col("id") % 10 < tenths
        uid = F.when(is_hot, F.lit("hot")).otherwise(uid)
    cs = cs.withColumn("client_uid", uid).withColumn("id", F.col("id") * reps + F.col("_copy")).drop("_copy")
    root = os.path.join(scratch, f"presence_x{reps}{'_hot' if hot else ''}")
    polls = base.snapshots.withColumn("total_clients", F.col("total_clients") * reps)
    write_presence(Presence(polls, cs, base.channels, ADAPTER_POLL_INTERVAL_S), root)
    pr = load_presence(spark, root, ADAPTER_POLL_INTERVAL_S)
    rows = pr.clients.count()
    jobs = {
        "channel_switches": lambda: sequence.channel_switches(pr, None, 10),
        "sessions": lambda: sequence.sessions(pr, None),
        "lifetime_value": lambda: ltv.lifetime_value(pr, None, 50),
        "naive_full_history_lag": lambda: naive_switches(pr),
    }
    report = {"rows": rows, "hot": hot, "queries": {}}
    for name, fn in jobs.items():
        spark.sparkContext.setJobGroup(name, name)
        t = time.perf_counter()
        fn().write.format("noop").mode("overwrite").save()
        report["queries"][name] = {"sec": round(time.perf_counter() - t, 2)}
    spark.stop()
    # stages appear in the order the questions ran
    stages = stage_skew(log_dir, 0)
    report["stages"] = [{"stage": s, "tasks": n, "max_task_records": mx, "median_task_records": md}
                        for s, n, mx, md in stages]
    print(json.dumps(report))


if __name__ == "__main__":
    main(sys.argv)
