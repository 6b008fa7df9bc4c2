"""Hand-made presence tables for unit tests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from rollcall import schemas
from rollcall.tables import Presence

BASE = 1_704_067_200  # 2024-01-01 00:00:00 UTC


def day_of(ts: int) -> dt.date:
    return dt.datetime.fromtimestamp(ts, dt.timezone.utc).date()


def client(id, ts, uid="a", channel=1, nickname=None, idle=0, away=False, msg="", talk=False,
           mic=False, spk=False, rec=False, groups="", conn=None, snapshot_id=None):
    return dict(id=id, snapshot_id=ts if snapshot_id is None else snapshot_id, ts=ts, client_uid=uid,
                client_database_id=None, nickname=nickname or f"nick_{uid}", channel_id=channel,
                idle_ms=idle, is_away=away, away_message=msg, is_talking=talk, input_muted=mic,
                output_muted=spk, is_recording=rec, server_groups=groups, connected_time=conn,
                event_date=day_of(ts))


def presence(spark, rows, polls=None, channels=None, p=30) -> Presence:
    """Snapshots default to one per distinct client ``ts`` (counting rows)."""
    cs = spark.createDataFrame([tuple(r[f.name] for f in schemas.CLIENTS.fields) for r in rows],
                               schemas.CLIENTS)
    if polls is None:
        counts = {}
        for r in rows:
            counts[r["ts"]] = counts.get(r["ts"], 0) + 1
        polls = sorted(counts.items())
    sn = spark.createDataFrame([(ts, ts, n, day_of(ts)) for ts, n in polls], schemas.SNAPSHOTS)
    ch = spark.createDataFrame(channels or [], schemas.CHANNELS)
    return Presence(sn, cs, ch, p)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def one(df):
    out = rows(df)
    assert len(out) == 1, out
    return out[0]


def col(df, name):
    return [r[name] for r in df.collect()]


__all__ = ["BASE", "client", "presence", "rows", "one", "col", "F"]
