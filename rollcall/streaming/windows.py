"""Event-time windows over streamed polls: sessions and hourly concurrency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.sources import payloads



def session_stream(clients: DataFrame, poll_interval_s: int) -> DataFrame:
    """Sessions per user from a client-row stream (event time ``poll_time``).

    A gap longer than two poll intervals closes a session, as in the batch
    operator.  In append mode a session is emitted once the poll stream's
    watermark passes its end, i.e. after later polls have arrived.
    """
    gap = f"{2 * int(poll_interval_s)} seconds"
    return (clients
            .groupBy("client_uid", F.session_window("poll_time", gap).alias("w"))
            .agg(F.min("ts").alias("session_start"), F.max("ts").alias("session_end"),
                 F.count(F.lit(1)).alias("samples")))


def hourly_concurrency(polls: DataFrame, include_query_clients: bool = False) -> DataFrame:
    """Mean and peak clients per UTC hour from a poll stream.

    Each document is one poll, so its client count is a per-row expression
    (no state before the window); polls later than the watermark are dropped.
    """
    counts = payloads.poll_counts(polls.select("poll_ts", "payload", "poll_time"), include_query_clients)
    return (counts
            .groupBy(F.window("poll_time", "1 hour").alias("hour"))
            .agg(F.avg("total_clients").alias("avg_clients"), F.max("total_clients").alias("max_clients"),
                 F.count(F.lit(1)).alias("polls")))
