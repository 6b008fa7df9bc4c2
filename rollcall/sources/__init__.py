"""Where presence tables come from: parquet tables, the event adapter and raw poll payloads."""

from rollcall.sources.events_adapter import ADAPTER_POLL_INTERVAL_S, presence_from_events
from rollcall.sources.parquet import load_presence, write_presence

__all__ = ["ADAPTER_POLL_INTERVAL_S", "presence_from_events", "load_presence", "write_presence"]
