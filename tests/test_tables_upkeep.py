"""Rollup, channel upsert, retention, layout conforming and gauges."""

import datetime as dt
import json

from frames import BASE, client, one, presence, rows

from rollcall import schemas
from rollcall.operators import maintenance, metrics, rollup, users
from rollcall.sources import payloads
from rollcall.sources.conform import conform_clients

P = 30
DAY = 86400


def test_rollup_half_open_day_mode_and_flags(spark):
    midnight = BASE + DAY
    r = [client(1, midnight - P, uid="a", channel=2, idle=None, talk=True),
         client(2, midnight - 2 * P, uid="a", channel=1, idle=100, nickname="zed"),
         client(3, midnight, uid="a", channel=5, away=True, idle=300),   # midnight belongs to the next day
         client(4, midnight + P, uid="a", channel=5, rec=True, idle=None)]
    pr = presence(spark, r)
    out = {x["date"]: x for x in rows(rollup.daily_user_rollup(pr))}
    d0, d1 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    assert set(out) == {d0, d1}
    assert out[d0]["total_samples"] == 2 and out[d0]["online_seconds"] == 60
    assert out[d0]["most_visited_channel_id"] == 1            # tie 1-1, smaller id
    assert out[d0]["avg_idle_ms"] == 100.0 and out[d0]["nickname"] == "zed"
    assert out[d0]["is_talking_count"] == 1 and out[d0]["is_away_count"] == 0
    assert out[d1]["most_visited_channel_id"] == 5 and out[d1]["is_away_count"] == 1
    assert out[d1]["is_recording_count"] == 1 and out[d1]["avg_idle_ms"] == 300.0
    only = rows(rollup.daily_user_rollup(pr, [d1]))
    assert [x["date"] for x in only] == [d1]


def test_rollup_sums_to_top_users(spark):
    r = [client(i, BASE + i * 3000, uid=f"u{i % 3}") for i in range(200)]
    pr = presence(spark, r)
    daily = rollup.daily_user_rollup(pr).groupBy("client_uid").sum("total_samples").collect()
    totals = {x[0]: x[1] for x in daily}
    top = {x["client_uid"]: x["sample_count"] for x in rows(users.top_users(pr, None, 10))}
    assert totals == top


def test_rollup_write_replaces_only_its_days(spark, tmp_path):
    r = [client(1, BASE, uid="a"), client(2, BASE + DAY, uid="a")]
    pr = presence(spark, r)
    path = str(tmp_path / "daily")
    rollup.write_user_daily(rollup.daily_user_rollup(pr), path)
    r2 = [client(3, BASE + DAY, uid="b"), client(4, BASE + DAY + P, uid="b")]
    rollup.write_user_daily(rollup.daily_user_rollup(presence(spark, r2)), path)
    back = {(x["client_uid"], str(x["date"])): x["total_samples"] for x in rows(spark.read.parquet(path))}
    assert back == {("a", "2024-01-01"): 1, ("b", "2024-01-02"): 2}


def test_channel_upsert_last_write_wins(spark):
    cur = spark.createDataFrame([(1, "Lobby", 0, 0, 3, 100), (2, "Old", 0, 1, 0, 100)], schemas.CHANNELS)
    upd = spark.createDataFrame([(2, "New", 0, 1, 4, 200, 1), (2, "Newer", 0, 1, 5, 200, 2),
                                 (3, "Fresh", 1, 2, 0, 150, 1), (1, "Stale", 0, 0, 0, 50, 9)],
                                "channel_id long, channel_name string, parent_channel_id long, "
                                "channel_order long, total_clients long, last_updated long, seq long")
    out = {x["channel_id"]: x for x in rows(maintenance.upsert_channels(cur, upd, seq_col="seq"))}
    assert out[1]["channel_name"] == "Lobby"       # the older update loses
    assert out[2]["channel_name"] == "Newer" and out[2]["total_clients"] == 5
    assert out[3]["channel_name"] == "Fresh"


def test_retention_cutoff_is_strict_and_hits_both_tables(spark):
    as_of = BASE + 10 * DAY
    cut = as_of - 7 * DAY
    r = [client(1, cut - 1), client(2, cut), client(3, as_of)]
    pr = presence(spark, r)
    kept, removed = maintenance.retain(pr, as_of, 7)
    assert one(removed) == {"removed_snapshots": 1, "removed_client_rows": 1}
    assert sorted(x["ts"] for x in rows(kept.clients)) == [cut, as_of]
    assert sorted(x["ts"] for x in rows(kept.snapshots)) == [cut, as_of]
    rep = one(maintenance.retention_report(pr, 7, as_of))
    assert rep["kept_snapshots"] == 2 and rep["kept_client_rows"] == 2


def _payload_frame(spark, docs):
    return spark.createDataFrame([(ts, d if isinstance(d, str) else json.dumps(d)) for ts, d in docs],
                                 "poll_ts long, payload string")


def test_client_payload_ingest(spark):
    ok = {"code": 0, "message": "ok"}
    docs = [
        (BASE, {"status": ok, "body": [
            {"clid": 1, "cid": "5", "client_unique_identifier": "A=", "client_nickname": "amy",
             "client_type": "0", "client_away": "1", "client_is_talker": 1, "client_input_muted": None,
             "client_output_muted": "yes", "client_idle_time": "1500", "client_servergroups": "6,7",
             "connection_connected_time": 60, "client_database_id": "12"},
            {"clid": 2, "client_type": 1, "client_nickname": "query bot"},
            {"clid": 3}]}),
        (BASE, {"status": ok, "body": [{"clid": 1}]}),                  # a second document: united
        (BASE + P, {"status": {"code": "0"}, "body": []}),              # an exact copy of a later poll
        (BASE + P, {"status": {"code": "0"}, "body": []}),              # empty poll
        (BASE + 2 * P, {"status": {"code": 1538, "message": "bad"}, "body": [{"clid": 9}]}),
        (BASE + 3 * P, {"body": [{"clid": 4, "client_away": 1.0, "client_is_talker": True,
                                  "client_input_muted": False, "client_is_recording": 2}]}),  # no status: accepted
        (BASE + 4 * P, "not json"),
        (BASE + 5 * P, '[{"clid": 7, "client_unique_identifier": "Z="}]'),   # bare list: the body
    ]
    pf = _payload_frame(spark, docs)
    sn, cs = payloads.ingest_client_payloads(pf)
    polls = {x["ts"]: x["total_clients"] for x in rows(sn)}
    assert polls == {BASE: 3, BASE + P: 0, BASE + 3 * P: 1, BASE + 5 * P: 1}
    got = {x["client_uid"] + str(x["ts"]): x for x in rows(cs)}
    amy = got[f"A={BASE}"]
    assert (amy["channel_id"], amy["idle_ms"], amy["client_database_id"], amy["connected_time"]) == (5, 1500, 12, 60)
    assert (amy["is_away"], amy["is_talking"], amy["input_muted"], amy["output_muted"]) == (True, True, False, False)
    assert amy["server_groups"] == "6,7" and amy["away_message"] == ""
    anon = got[f"unknown{BASE}"]
    assert anon["nickname"] == "Unknown" and anon["channel_id"] == 0 and anon["server_groups"] == ""
    assert anon["idle_ms"] is None and anon["is_recording"] is False
    late = got[f"unknown{BASE + 3 * P}"]
    flags = (late["is_away"], late["is_talking"], late["input_muted"], late["is_recording"])
    assert flags == (True, True, False, False)
    assert len(got) == 4 and f"Z={BASE + 5 * P}" in got
    with_query = payloads.ingest_client_payloads(pf, include_query_clients=True)[1]
    assert with_query.count() == 6
    rej = rows(payloads.rejected_polls(pf))
    assert sorted(x["poll_ts"] for x in rej) == [BASE + 2 * P, BASE + 4 * P]


def test_channel_payloads_feed_upsert(spark):
    doc = {"status": {"code": 0}, "body": [{"cid": "1", "pid": 0, "channel_name": "Lobby", "total_clients": "2"},
                                          {"cid": 2}]}
    upd = payloads.channel_updates(_payload_frame(spark, [(BASE, doc)]))
    out = {x["channel_id"]: x for x in rows(upd)}
    assert out[1]["channel_name"] == "Lobby" and out[1]["total_clients"] == 2 and out[1]["last_updated"] == BASE
    assert out[2]["channel_name"] == "Unknown Channel" and out[2]["channel_order"] == 0
    cur = spark.createDataFrame([], schemas.CHANNELS)
    assert maintenance.upsert_channels(cur, upd, "_seq").count() == 2


def test_conform_old_layout(spark):
    new = presence(spark, [client(1, BASE, away=True, groups="6", conn=5)]).clients
    old = presence(spark, [client(2, BASE - DAY)]).clients.select(
        "id", "snapshot_id", "ts", "client_uid", "client_database_id", "nickname", "channel_id", "idle_ms",
        "event_date")
    out = {x["id"]: x for x in rows(conform_clients(new, old))}
    assert out[1]["is_away"] is True and out[1]["server_groups"] == "6"
    assert out[2]["is_away"] is False and out[2]["server_groups"] is None and out[2]["connected_time"] is None


def test_metrics_snapshot_gauges(spark):
    chans = [(c, f"ch{c}", 0, c, 0, 0) for c in range(1, 30)]
    r = [client(i, BASE + (i % 5) * P, uid=f"u{i % 7}", channel=1 + i % 25) for i in range(60)]
    pr = presence(spark, r, channels=chans)
    out = rows(metrics.metrics_snapshot(pr, 7))
    names = {x["name"] for x in out}
    assert {"ts_users_total", "ts_users_online", "ts_ltv_avg_score", "ts_channels_total",
            "ts_channel_visits", "ts_snapshots_total"} <= names
    visits = [x for x in out if x["name"] == "ts_channel_visits"]
    assert len(visits) == 20 and all(set(x["labels"]) == {"channel_id", "channel_name"} for x in visits)
    g = {x["name"]: x["value"] for x in out if not x["labels"]}
    assert g["ts_users_total"] == 7.0 and g["ts_channels_total"] == 25.0 and g["ts_snapshots_total"] == 5.0


def test_sql_store_layout_to_presence(spark):
    from rollcall.sources.sql_store import presence_from_sql_tables
    from rollcall.functions.time import duration_text

    snaps = spark.createDataFrame([(1, BASE, 2, "x"), (2, BASE + P, 0, "x")],
                                  "id long, timestamp long, total_clients long, created_at string")
    old = spark.createDataFrame([(10, 1, "a", 5, "amy", 3, 100), (11, 1, "b", None, "bob", 4, None),
                                 (12, 99, "c", None, "orphan", 1, 0)],
                                "id long, snapshot_id long, client_uid string, client_database_id long, "
                                "nickname string, channel_id long, idle_ms long")
    chans = spark.createDataFrame([(3, "Lobby", 0, 0, 2, BASE)],
                                  "channel_id int, channel_name string, parent_channel_id int, channel_order int, "
                                  "total_clients int, last_updated long")
    pr = presence_from_sql_tables(snaps, old, chans, P)
    got = {r["id"]: r for r in rows(pr.clients)}
    assert set(got) == {10, 11}                        # the orphan is dropped
    assert got[10]["ts"] == BASE and got[10]["is_away"] is False and got[10]["server_groups"] is None
    assert got[10]["event_date"] == dt.date(2024, 1, 1)
    flags = spark.createDataFrame([(20, 2, "a", "amy", 3, 1, 0, "2", None)],
                                  "id long, snapshot_id long, client_uid string, nickname string, channel_id long, "
                                  "is_away int, is_talking int, input_muted string, is_recording int")
    r = one(presence_from_sql_tables(snaps, flags, chans, P).clients)
    assert (r["is_away"], r["is_talking"], r["input_muted"], r["is_recording"]) == (True, False, False, False)
    assert one(users.top_users(pr, None, 10).filter("client_uid = 'a'"))["sample_count"] == 1
    hours = [0.5 / 60, 59 / 3600, 0.25, 1.0, 23.95, 25.0, 36.0]
    out = [x[0] for x in spark.createDataFrame([(h,) for h in hours], "h double")
           .select(duration_text("h")).collect()]
    want = [f"{h * 60:.0f}m" if h < 1 else f"{h:.1f}h" if h < 24 else f"{h / 24:.1f}d" for h in hours]
    assert out == want


def test_write_retained_new_version(spark, tmp_path):
    from rollcall.sources.parquet import load_presence, write_presence

    as_of = BASE + 10 * DAY
    r = [client(1, BASE), client(2, as_of - DAY, uid="b"), client(3, as_of, uid="c")]
    old_root, new_root = str(tmp_path / "v1"), str(tmp_path / "v2")
    write_presence(presence(spark, r), old_root)
    pr = load_presence(spark, old_root, P)
    removed = one(maintenance.write_retained(pr, as_of, 7, new_root))
    assert removed == {"removed_snapshots": 1, "removed_client_rows": 1}
    kept = load_presence(spark, new_root, P)
    assert sorted(x["client_uid"] for x in rows(kept.clients)) == ["b", "c"]
    assert kept.snapshots.count() == 2
    assert load_presence(spark, old_root, P).clients.count() == 3      # the version read is untouched


def test_daily_maintenance_job(spark, tmp_path):
    from rollcall import jobs
    from rollcall.sources.parquet import write_presence

    as_of = BASE + 10 * DAY
    r = [client(1, BASE), client(2, as_of - DAY, uid="b"), client(3, as_of - DAY + P, uid="b"),
         client(4, as_of, uid="c")]
    root, daily, kept = str(tmp_path / "t"), str(tmp_path / "daily"), str(tmp_path / "t2")
    write_presence(presence(spark, r), root)
    removed = jobs.daily_maintenance(spark, root, daily, P, as_of, retention_days=7, retained_root=kept)
    assert one(removed)["removed_client_rows"] == 1
    back = rows(spark.read.parquet(daily))
    assert [(x["client_uid"], x["total_samples"]) for x in back] == [("b", 2)]
    jobs.daily_maintenance(spark, root, daily, P, as_of)          # re-run: same day replaced, not doubled
    assert spark.read.parquet(daily).count() == 1


def test_rollup_compat_inclusive_day_and_all_time_mode(spark):
    midnight = BASE + DAY
    r = [client(1, midnight - P, uid="a", channel=2),
         client(2, midnight, uid="a", channel=5),              # counts in both days in compat mode
         client(3, midnight + P, uid="a", channel=5),
         client(4, midnight + 2 * P, uid="a", channel=5)]
    pr = presence(spark, r)
    out = {x["date"]: x for x in rows(rollup.daily_user_rollup(pr, compat=True))}
    d0, d1 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    assert out[d0]["total_samples"] == 2 and out[d1]["total_samples"] == 3
    assert out[d0]["most_visited_channel_id"] == 5 == out[d1]["most_visited_channel_id"]   # all-time mode
    plain = {x["date"]: x for x in rows(rollup.daily_user_rollup(pr))}
    assert plain[d0]["total_samples"] == 1 and plain[d0]["most_visited_channel_id"] == 2
    only = rows(rollup.daily_user_rollup(pr, [d0], compat=True))
    assert [x["total_samples"] for x in only] == [2]


def test_gauges_with_materialized_score_summary(spark, tmp_path):
    from rollcall import jobs
    from rollcall.sources.parquet import write_presence

    r = [client(i, BASE + (i % 9) * P, uid=f"u{i % 4}", talk=i % 3 == 0) for i in range(72)]
    root, out = str(tmp_path / "t"), str(tmp_path / "scores")
    write_presence(presence(spark, r), root)
    jobs.materialize_score_summary(spark, root, out, P)
    from rollcall.sources.parquet import load_presence
    pr = load_presence(spark, root, P)
    direct = sorted((x["name"], x["value"]) for x in rows(metrics.metrics_snapshot(pr, 7)))
    stored = sorted((x["name"], x["value"]) for x in rows(
        metrics.metrics_snapshot(pr, 7, score_summary=spark.read.parquet(out))))
    assert direct == stored


def test_append_folds_channels_and_first_samples(spark, tmp_path):
    from rollcall.operators import channels, load
    from rollcall.sources.parquet import load_presence, write_presence

    root = str(tmp_path / "tables")
    for k, name in enumerate(("Lobby", "Hall")):
        pr = presence(spark, [client(k + 1, BASE + k * 9 * DAY, uid="a", channel=1)])
        pr = pr.__class__(pr.snapshots, pr.clients, spark.createDataFrame([(1, name, 0, 0, 1, BASE + k)], schemas.CHANNELS), P)
        write_presence(pr, root, mode="append" if k else "overwrite")
    pr = load_presence(spark, root, P)
    assert [(r["channel_id"], r["channel_name"]) for r in rows(pr.channels)] == [(1, "Hall")]
    assert [tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in rows(pr.first_seen)] == [("a", BASE)]
    assert pr.clients.count() == 2 and len(rows(channels.channel_stats(pr, None))) == 1
    assert one(load.dataset_stats(pr)) == one(load.dataset_stats(pr.__class__(pr.snapshots, pr.clients, pr.channels, P)))
    growth = one(users.growth_metrics(pr, 1, BASE + 9 * DAY))
    assert growth == one(users.growth_metrics(pr.__class__(pr.snapshots, pr.clients, pr.channels, P), 1, BASE + 9 * DAY))


def test_rollup_of_a_chosen_day(spark):
    from rollcall.functions.time import day_bounds, midnight_of, next_midnight_of

    pr = presence(spark, [client(1, BASE, uid="a"), client(2, BASE + DAY, uid="b"), client(3, BASE + 2 * DAY, uid="c")])
    assert [r["client_uid"] for r in rows(rollup.rollup_of_day(pr, "2024-01-02"))] == ["b"]
    lo, hi = day_bounds("2024-01-02")
    assert hi - lo == DAY and lo % DAY == 0
    texts = spark.createDataFrame([("2024-01-02",), ("2024-02-30",), ("yesterday",), (None,)], "t string")
    got = texts.select(midnight_of("t").alias("a"), next_midnight_of("t").alias("b")).collect()
    assert [tuple(r) for r in got] == [(lo, hi), (None, None), (None, None), (None, None)]
