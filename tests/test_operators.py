"""Hand-computed results on small frames, one test per semantic decision."""

from frames import BASE, client, col, one, presence, rows

from rollcall.sources import payloads
from rollcall.operators import channels, load, ltv, status, users
from rollcall.tables import TimeRange

P = 30
DAY = 86400


def test_top_users_counts_order_and_latest_nickname(spark):
    r = [client(i, BASE + i * P, uid="b") for i in range(3)]
    r += [client(10 + i, BASE + i * P, uid="a", nickname="old" if i < 2 else "new") for i in range(3)]
    r += [client(20, BASE, uid="c")]
    pr = presence(spark, r)
    out = rows(users.top_users(pr, days=7, limit=2))
    assert [x["client_uid"] for x in out] == ["a", "b"]          # tie on count, by uid
    a = out[0]
    assert a["nickname"] == "new" and a["sample_count"] == 3
    assert a["online_seconds"] == 90 and a["online_minutes"] == 1.5 and a["online_hours"] == 0.03
    assert a["first_seen"] == BASE and a["last_seen"] == BASE + 2 * P


def test_range_is_inclusive_at_both_ends(spark):
    as_of = BASE + 10 * DAY
    r = [client(1, as_of - 7 * DAY, uid="edge"), client(2, as_of - 7 * DAY - 1, uid="early"),
         client(3, as_of, uid="now")]
    pr = presence(spark, r)
    got = sorted(col(users.top_users(pr, 7, 10, as_of=as_of), "client_uid"))
    assert got == ["edge", "now"]
    assert TimeRange.lookback(as_of, None).t0 == 0


def test_profile_average_idle_ignores_nulls(spark):
    r = [client(1, BASE, uid="a", idle=None), client(2, BASE + P, uid="a", idle=1001),
         client(3, BASE + 2 * P, uid="a", idle=2000), client(4, BASE, uid="z", idle=None)]
    pr = presence(spark, r)
    out = {x["client_uid"]: x for x in rows(users.user_profile(pr, None, 30))}
    assert out["a"]["avg_idle_ms"] == 1500 and out["a"]["sample_count"] == 3
    assert out["z"]["avg_idle_ms"] == 0
    assert rows(users.user_profile(pr, "nobody", 30)) == []


def test_favorite_channels_top_k_and_label_fallback(spark):
    chans = [(4, "", 0, 1, 0, 0), (5, "Games", 0, 2, 0, 0)]
    r = []
    i = 0
    for ch, n in ((4, 3), (5, 3), (11, 2), (1, 1), (2, 1), (3, 1)):
        for _ in range(n):
            r.append(client(i, BASE + i * P, channel=ch))
            i += 1
    pr = presence(spark, r, channels=chans)
    out = rows(users.favorite_channels(pr, None, 30, 5))
    out.sort(key=lambda x: x["rank"])
    assert [(x["channel_id"], x["visits"]) for x in out] == [(4, 3), (5, 3), (11, 2), (1, 1), (2, 1)]
    assert [x["channel_name"] for x in out[:3]] == ["Channel 4", "Games", "Channel 11"]


def test_weekday_activity_midnight(spark):
    sunday = 1704585600  # 2024-01-07 00:00:00 UTC
    pr = presence(spark, [client(1, sunday), client(2, sunday - 1)])
    out = {x["day_of_week"]: x["sample_count"] for x in rows(users.user_weekday_activity(pr, None, 30))}
    assert out == {0: 1, 6: 1}
    nested = one(users.weekday_map(users.user_weekday_activity(pr, None, 30)))
    assert nested["activity_by_day_of_week"] == {0: 1, 6: 1}


def test_hourly_heatmap_counts_empty_polls(spark):
    polls = [(BASE, 2), (BASE + P, 0), (BASE + 3600, 1)]
    pr = presence(spark, [client(1, BASE), client(2, BASE, uid="b"), client(3, BASE + 3600)], polls=polls)
    out = rows(load.hourly_heatmap(pr, 7))
    assert out == [{"hour": 0, "avg_clients": 1.0, "sample_count": 2},
                   {"hour": 1, "avg_clients": 1.0, "sample_count": 1}]
    bars = rows(load.relative_load(load.hourly_heatmap(pr, 7)))
    assert [b["bar"] for b in bars] == [30, 30]


def test_relative_load_all_zero(spark):
    pr = presence(spark, [], polls=[(BASE, 0)])
    assert [b["bar"] for b in rows(load.relative_load(load.daily_activity(pr, 30)))] == [0]


def test_idle_users_need_more_than_ten_readings(spark):
    r = [client(i, BASE + i * P, uid="ten", idle=5000) for i in range(10)]
    r += [client(100 + i, BASE + i * P, uid="eleven", idle=1000 + i) for i in range(11)]
    r += [client(200, BASE, uid="eleven", idle=None)]
    pr = presence(spark, r)
    out = rows(users.top_idle_users(pr, 7, 10))
    assert [x["client_uid"] for x in out] == ["eleven"]
    assert out[0]["avg_idle_ms"] == 1005 and out[0]["sample_count"] == 11
    assert out[0]["avg_idle_minutes"] == round(1005 / 60000, 2)


def test_peak_times_ties_latest_first(spark):
    pr = presence(spark, [], polls=[(BASE, 5), (BASE + P, 5), (BASE + 2 * P, 1)])
    out = rows(load.peak_times(pr, 7, 2))
    assert [x["timestamp"] for x in out] == [BASE + P, BASE]
    assert out[1]["datetime"] == "2024-01-01T00:00:00"


def test_channel_stats(spark):
    r = [client(1, BASE, uid="a", channel=1, idle=None), client(2, BASE + P, uid="a", channel=1, idle=None),
         client(3, BASE, uid="b", channel=2, idle=10), client(4, BASE, uid="c", channel=2, idle=21)]
    pr = presence(spark, r, channels=[(1, "Lobby", 0, 0, 0, 0)])
    out = rows(channels.channel_stats(pr, 7))
    assert out[0] == {"channel_id": 1, "channel_name": "Lobby", "total_visits": 2, "unique_users": 1,
                      "avg_idle_ms": 0}
    assert out[1] == {"channel_id": 2, "channel_name": "Channel 2", "total_visits": 2, "unique_users": 2,
                      "avg_idle_ms": 15}


def test_growth_new_versus_returning(spark):
    as_of = BASE + 20 * DAY
    r = [client(1, BASE, uid="old"), client(2, as_of - DAY, uid="old"),
         client(3, as_of - 2 * DAY, uid="new"), client(4, BASE, uid="gone")]
    pr = presence(spark, r)
    out = one(users.growth_metrics(pr, 7, as_of=as_of))
    assert out == {"total_unique_users": 2, "new_users": 1, "returning_users": 1, "new_user_percentage": 50.0}
    fs = users.first_seen(pr)
    assert one(users.growth_metrics(pr, 7, as_of=as_of, first_seen_table=fs)) == out


def test_online_now_latest_poll_fields(spark):
    r = [client(1, BASE, uid="x"),
         client(2, BASE + P, uid="b", nickname="bob", idle=None, groups="6, 10", conn=5400, away=True, msg=None),
         client(3, BASE + P, uid="a", nickname="amy", idle=90000, groups="", conn=None)]
    pr = presence(spark, r, channels=[(1, "Lobby", 0, 0, 0, 0)])
    out = rows(status.online_now(pr))
    assert status.latest_snapshot_id(pr) == BASE + P
    assert [x["nickname"] for x in out] == ["amy", "bob"]
    amy, bob = out
    assert amy["idle_minutes"] == 1.5 and amy["server_groups"] == [] and amy["connected_hours"] == 0.0
    assert bob["idle_minutes"] == 0.0 and bob["server_groups"] == ["6", " 10"] and bob["connected_hours"] == 1.5
    assert bob["away_message"] == "" and bob["is_away"] is True and bob["channel_name"] == "Lobby"
    assert bob["snapshot_time"] == BASE + P


def test_online_now_empty_last_poll(spark):
    pr = presence(spark, [client(1, BASE)], polls=[(BASE, 1), (BASE + P, 0)])
    assert rows(status.online_now(pr)) == []
    assert one(status.active_now(pr)) == {"online_users": 0, "active_users": 0}


def test_active_uses_rounded_idle_minutes(spark):
    r = [client(1, BASE, uid="a", idle=299_700),      # 4.995 min rounds to 5.0: not active
         client(2, BASE, uid="b", idle=299_000),      # 4.98: active
         client(3, BASE, uid="c", idle=None),         # NULL counts as 0: active
         client(4, BASE, uid="d", idle=0, away=True)]  # away
    pr = presence(spark, r)
    assert one(status.active_now(pr)) == {"online_users": 4, "active_users": 2}


def test_empty_range_gives_zero_rows_not_nulls(spark):
    pr = presence(spark, [], polls=[(BASE, 0)])
    assert one(load.summary(pr, 7)) == {"total_snapshots": 1, "avg_users_online": 0.0,
                                       "max_users_online": 0, "unique_users": 0}
    assert one(status.away_summary(pr, 7)) == {"total_samples": 0, "away_samples": 0, "away_percentage": 0.0}
    m = one(status.mute_summary(pr, 7))
    assert m["total_samples"] == 0 and m["talking_percentage"] == 0.0
    s = one(ltv.ltv_summary(pr))
    assert s["total_users"] == 0 and s["avg_ltv_score"] == 0.0 and s["power_users_percent"] == 0.0


def test_no_rows_at_all(spark):
    pr = presence(spark, [], polls=[])
    assert one(load.summary(pr, 7))["total_snapshots"] == 0
    assert rows(status.online_now(pr)) == []
    assert rows(users.top_users(pr, 7, 10)) == []
    assert one(load.dataset_stats(pr))["snapshot_count"] == 0


def test_top_away_users_base_is_rows_with_message(spark):
    r = [client(i, BASE + i * P, uid="a", away=i < 6, msg="brb" if i < 11 else "") for i in range(15)]
    r[10]["away_message"] = "lunch"
    pr = presence(spark, r)
    out = one(status.top_away_users(pr, 7, 10))
    assert out["total_samples"] == 11 and out["away_count"] == 6
    assert out["away_percentage"] == round(6 / 11 * 100, 2) and out["last_away_message"] == "lunch"


def test_mute_summary(spark):
    r = [client(1, BASE, mic=True, talk=True), client(2, BASE + P, spk=True), client(3, BASE + 2 * P, rec=True)]
    out = one(status.mute_summary(presence(spark, r), 7))
    assert out == {"total_samples": 3, "mic_muted_percentage": 33.33, "speaker_muted_percentage": 33.33,
                   "recording_percentage": 33.33, "talking_percentage": 33.33}


def test_top_recorders(spark):
    r = [client(1, BASE, uid="a", rec=True), client(2, BASE + P, uid="a"), client(3, BASE, uid="b")]
    out = rows(users.top_recorders(presence(spark, r), 7, 10))
    assert out == [{"client_uid": "a", "nickname": "nick_a", "recording_count": 1, "recording_percentage": 50.0}]


def test_server_groups_compat_and_exact(spark):
    r = [client(1, BASE, uid="a", groups="6,7"), client(2, BASE + P, uid="a", groups="6, 7,  "),
         client(3, BASE, uid="b", groups="8,8"), client(4, BASE, uid="c", groups=""),
         client(5, BASE, uid="d", groups=None)]
    pr = presence(spark, r)
    compat = {x["group_id"]: (x["unique_members"], x["total_samples"])
              for x in rows(channels.server_group_stats(pr, 7))}
    assert compat == {"6": (2, 2), "7": (2, 2), "8": (2, 2)}
    exact = {x["group_id"]: (x["unique_members"], x["total_samples"])
             for x in rows(channels.server_group_stats(pr, 7, exact=True))}
    assert exact == {"6": (1, 2), "7": (1, 2), "8": (1, 1)}


def test_list_and_lookup_channels(spark):
    chans = [(2, "B", 0, None, 0, 0), (1, "A", 0, 1, 0, 0), (3, "", 0, 0, 0, 0)]
    pr = presence(spark, [client(1, BASE, channel=1), client(2, BASE, channel=9)], channels=chans)
    assert col(channels.list_channels(pr), "channel_id") == [2, 3, 1]
    assert rows(channels.channel_name(pr, 1)) == [{"channel_id": 1, "channel_name": "A"}]
    assert rows(channels.channel_name(pr, 42)) == []
    looked = {x["channel_id"]: x["channel_name"] for x in rows(channels.channel_name_lookup(pr, pr.clients))}
    assert looked == {1: "A", 9: None}


def test_dataset_stats_counts_orphans(spark):
    pr = presence(spark, [client(1, BASE), client(2, BASE + P, uid="b")], polls=[(BASE, 1)])
    out = one(load.dataset_stats(pr))
    assert out == {"snapshot_count": 1, "client_snapshot_count": 2, "unique_clients": 2,
                   "first_snapshot_timestamp": BASE, "last_snapshot_timestamp": BASE}
    assert pr.committed_clients().count() == 1


def test_composite_reports(spark):
    from rollcall.operators import reports

    r = [client(i, BASE + i * P, uid=f"u{i % 3}", away=i % 2 == 0, msg="afk", rec=i % 5 == 0) for i in range(60)]
    pr = presence(spark, r)
    away = reports.away_stats(pr, 7, 10)
    assert one(away["summary"])["total_samples"] == 60 and len(rows(away["top_away_users"])) == 3
    mute = reports.mute_stats(pr)
    assert one(mute["summary"])["recording_percentage"] == 20.0
    conn = reports.connection_patterns(pr)
    assert one(conn["summary"])["total_users"] == 3 and len(rows(conn["top_reconnectors"])) == 3
    ur = reports.user_report(pr, "u1")
    assert one(ur["profile"])["sample_count"] == 20
    assert set(reports.overview(pr)) == {"summary", "hourly", "peaks"}
    assert one(reports.overview(pr, 7)["summary"])["period_days"] == 7
    eng = reports.engagement(pr)
    assert one(eng["summary"])["period_days"] is None and one(eng["summary"])["total_users"] == 3
    assert one(reports.growth(pr, 7)["summary"])["total_unique_users"] == 3


def test_user_stats_nested(spark):
    r = [client(i, BASE + i * P, uid="a", channel=1 + (i % 2), idle=1000) for i in range(5)]
    pr = presence(spark, r, channels=[(1, "Lobby", 0, 0, 0, 0)])
    out = one(users.user_stats(pr, "a", 30))
    assert out["sample_count"] == 5 and out["avg_idle_ms"] == 1000
    assert [(c["channel_id"], c["channel_name"], c["visits"]) for c in out["favorite_channels"]] == \
        [(1, "Lobby", 3), (2, "Channel 2", 2)]
    assert out["activity_by_day_of_week"] == {1: 5}          # 2024-01-01 was a Monday


def test_rejected_document_never_displaces_a_valid_one(spark, tmp_path):
    valid = '{"status":{"code":0},"body":[{"client_unique_identifier":"a","cid":1}]}'
    error = '{"status":{"code":5,"message":"' + "x" * 300 + '"}}'
    lines = [f'{{"poll_ts": 1704067230.5, "payload": {p}}}' for p in (valid, error)] + ['{"poll_ts": "soon", "payload": ' + valid + "}"]
    (tmp_path / "polls.json").write_text("\n".join(lines))
    docs = payloads.read_payload_text(spark, str(tmp_path))
    snapshots, clients = payloads.ingest_client_payloads(docs)
    assert [(r.snapshot_id, r.total_clients) for r in snapshots.collect()] == [(1704067230, 1)]
    assert [r.client_uid for r in clients.collect()] == ["a"]
    assert payloads.rejected_polls(docs).count() == 2


def test_documents_of_one_poll_are_united(spark):
    """Different accepted documents of a poll all count; copies, repeated connections and rejected ones add nothing."""
    import json

    def doc(code, *people):
        return json.dumps({"status": {"code": code}, "body": [
            {k: v for k, v in zip(("client_unique_identifier", "clid", "client_type"), p) if v is not None} for p in people]})
    t = 1704067200
    docs = [(t, doc(0, ("a", "1", "0"), ("b", "2", "0"))), (t, doc(0, ("a", "1", "0"), ("b", "2", "0"))),
            (t, doc(0, ("c", "3", "0"), ("b", "2", "0"), ("bot", "9", "1"))),
            (t, doc(7, *[("x" * 50, str(i), "0") for i in range(20)])),
            (t + 60, doc(0, ("a", None, "0"), ("a", None, "0"))), (t + 120, doc(0, ("bot", "9", "1"))),
            (t + 180, doc(0)), (t * 1000, doc(0, ("late", "1", "0"))), (None, doc(0, ("none", "1", "0")))]
    frame = spark.createDataFrame(docs, "poll_ts long, payload string")
    snapshots, clients = payloads.ingest_client_payloads(frame)
    assert {(r.ts, r.total_clients) for r in snapshots.collect()} == {(t, 3), (t + 60, 2), (t + 120, 0), (t + 180, 0)}
    got = clients.collect()
    assert sorted((r.ts, r.client_uid) for r in got) == [(t, "a"), (t, "b"), (t, "c"), (t + 60, "a"), (t + 60, "a")]
    assert len({r.id for r in got}) == len(got)
    assert payloads.rejected_polls(frame).count() == 3
