"""Structured Streaming: poll documents landing as files, ingested micro-batch by micro-batch."""

from rollcall.streaming.ingest import (
    client_stream, committed_first_seen, committed_presence, current_presence, latest_channels, poll_stream,
    start_channel_upkeep, start_current_presence, start_presence_ingest,
)
from rollcall.streaming.views import maintained_hours, maintained_sessions
from rollcall.streaming.windows import hourly_concurrency, session_stream

__all__ = [
    "client_stream", "committed_first_seen", "committed_presence", "current_presence", "latest_channels", "poll_stream",
    "start_channel_upkeep",
    "start_current_presence", "start_presence_ingest", "hourly_concurrency", "session_stream",
    "maintained_hours", "maintained_sessions",
]
