"""Maintenance jobs a scheduler (cron, a workflow tool) runs over the stored tables.

Each job is idempotent: re-running it after a failure rewrites the same
output (rollup days are upserted, retention and compaction write new paths).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollcall.operators import ltv, maintenance, rollup, summaries
from rollcall.sources.parquet import load_presence, write_presence
from rollcall.streaming.ingest import committed_first_seen, committed_presence
from rollcall.tables import DEFAULT_POLL_INTERVAL_S


def daily_maintenance(spark: SparkSession, table_root: str, rollup_path: str,
                      poll_interval_s: int = DEFAULT_POLL_INTERVAL_S, as_of: int | None = None,
                      retention_days: int | None = None, retained_root: str | None = None,
                      date: str | None = None) -> DataFrame | None:
    """Upsert the rollup of ``date`` (YYYY-MM-DD; default: the previous day); with ``retention_days``, write the retained tables to
    ``retained_root`` (a new version) and return the removed counts."""
    pr = load_presence(spark, table_root, poll_interval_s)
    as_of = pr.latest_ts() if as_of is None else as_of
    rollup.write_user_daily(rollup.rollup_of_day(pr, date) if date else rollup.rollup_previous_day(pr, as_of), rollup_path)
    if retention_days is None:
        return None
    if not retained_root:
        raise ValueError("retention writes a new version: give retained_root")
    return maintenance.write_retained(pr, as_of or 0, retention_days, retained_root)


def expire_days(spark: SparkSession, table_root: str, days: int, as_of: int | None = None,
                poll_interval_s: int = DEFAULT_POLL_INTERVAL_S) -> tuple[int, int]:
    """Retention of the stored tables by dropping whole days; returns the removed polls and client rows."""
    pr = load_presence(spark, table_root, poll_interval_s)
    as_of = pr.latest_ts() if as_of is None else as_of
    return maintenance.expire(pr, table_root, as_of or 0, days)


def compact_appended(spark: SparkSession, table_root: str, out_root: str, poll_interval_s: int = DEFAULT_POLL_INTERVAL_S) -> None:
    """Fold the channels and first samples that appends left, and write a new version of the tables at ``out_root``."""
    write_presence(load_presence(spark, table_root, poll_interval_s), out_root)


def refresh_summaries(spark: SparkSession, table_root: str, poll_interval_s: int = DEFAULT_POLL_INTERVAL_S) -> list:
    """Summarize the days that have none or whose polls have changed since; only these are read and written."""
    return summaries.refresh(load_presence(spark, table_root, poll_interval_s), table_root)


def compact_first_seen(spark: SparkSession, ingest_root: str, out_path: str) -> None:
    """Fold the per-batch first-seen rows of a streamed table set into one table."""
    committed_first_seen(spark, ingest_root).write.mode("overwrite").parquet(out_path)


def compact_ingested(spark: SparkSession, ingest_root: str, out_root: str,
                     channels: DataFrame | None = None, poll_interval_s: int = DEFAULT_POLL_INTERVAL_S) -> None:
    """Rewrite the committed, streamed tables (many small per-batch files) into the
    clustered layout of :func:`write_presence` at ``out_root`` (a new version)."""
    write_presence(committed_presence(spark, ingest_root, channels, poll_interval_s), out_root)


def materialize_score_summary(spark: SparkSession, table_root: str, out_path: str,
                              poll_interval_s: int = DEFAULT_POLL_INTERVAL_S) -> None:
    """Write the all-time engagement summary (one row) for the gauges to read."""
    pr = load_presence(spark, table_root, poll_interval_s)
    ltv.ltv_summary(pr, None).write.mode("overwrite").parquet(out_path)
