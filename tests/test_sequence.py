"""Sessions and channel switches: hand cases plus a brute-force check of the sliced engine."""

import random

from frames import BASE, client, one, presence, rows

from rollcall.operators import ltv, sequence

P = 30


def brute(rs, p, t0=None, t1=None):
    """Straight LAG over each user's rows in (ts, snapshot_id, id) order."""
    by_user = {}
    for r in rs:
        if t0 is not None and not (t0 <= r["ts"] <= t1):
            continue
        by_user.setdefault(r["client_uid"], []).append(r)
    out = {}
    for uid, xs in by_user.items():
        xs.sort(key=lambda r: (r["ts"], r["snapshot_id"], r["id"]))
        starts = switches = 0
        sess = []
        for i, r in enumerate(xs):
            prev = xs[i - 1] if i else None
            new = prev is None or r["ts"] - prev["ts"] > 2 * p
            starts += new
            switches += prev is not None and r["channel_id"] != prev["channel_id"]
            if new:
                sess.append([r["ts"], r["ts"], 0])
            sess[-1][1] = r["ts"]
            sess[-1][2] += 1
        out[uid] = dict(n=len(xs), sessions=starts, switches=switches,
                        rows=[(uid, i + 1, a, b, c) for i, (a, b, c) in enumerate(sess)])
    return out


def random_rows(seed, users=6, polls=400, p=P):
    rnd = random.Random(seed)
    rs, i = [], 0
    for u in range(users):
        t = BASE + rnd.randint(0, 50) * p
        for _ in range(rnd.randint(1, polls)):
            t += p * rnd.choice([1, 1, 1, 2, 3, 4]) + rnd.choice([0, 0, 0, 1])  # gaps of 2p and 2p+1 occur
            for _ in range(rnd.choice([1, 1, 1, 1, 2, 3])):                     # same user twice in one poll
                i += 1
                rs.append(client(rnd.randint(0, 10**9) * 1000 + i, t, uid=f"u{u}", channel=rnd.choice([1, 2, 3])))
    return rs


def test_gap_of_exactly_two_intervals_continues_a_session(spark):
    r = [client(1, BASE, channel=1), client(2, BASE + 2 * P, channel=1),   # gap 2p: same session
         client(3, BASE + 4 * P + 1, channel=2),                          # gap 2p+1: new session
         client(4, BASE + 4 * P + 1, channel=1)]                          # same poll twice: no new session
    pr = presence(spark, r)
    m = one(sequence.session_counts(pr, 7, 10))
    assert m["session_count"] == 2 and m["avg_session_length_minutes"] == round(4 / 2 * P / 60, 2)
    sw = one(sequence.channel_switches(pr, 7, 10))
    assert sw["channel_switches"] == 2      # 1 -> 2 across the gap, 2 -> 1 within the poll (by row id)
    assert sw["switches_per_hour"] == round(2 / (4 * P / 3600), 2)
    ses = sorted((x["session_no"], x["session_start"], x["session_end"], x["samples"])
                 for x in rows(sequence.sessions(pr, 7)))
    assert ses == [(1, BASE, BASE + 2 * P, 2), (2, BASE + 4 * P + 1, BASE + 4 * P + 1, 2)]


def test_users_without_switches_are_left_out(spark):
    pr = presence(spark, [client(1, BASE, uid="a"), client(2, BASE + P, uid="a"), client(3, BASE, uid="b")])
    assert rows(sequence.channel_switches(pr, 7, 10)) == []


def test_sliced_engine_equals_brute_force(spark):
    rs = random_rows(3)
    pr = presence(spark, rs, p=P)
    want = brute(rs, P)
    for slice_polls in (1, 2, 7, 120, 100000):
        m = rows(sequence.sequence_metrics(pr.clients, P, slice_polls))
        got = {x["client_uid"]: dict(n=x["total_samples"], sessions=x["session_count"],
                                     switches=x["channel_switches"]) for x in m}
        assert got == {u: {k: v[k] for k in ("n", "sessions", "switches")} for u, v in want.items()}, slice_polls
        ses = sorted((x["client_uid"], x["session_no"], x["session_start"], x["session_end"], x["samples"])
                     for x in rows(sequence.sessions(pr, None, slice_polls)))
        assert ses == sorted(r for v in want.values() for r in v["rows"]), slice_polls


def test_range_cut_restarts_history(spark):
    rs = random_rows(5, users=3, polls=200)
    pr = presence(spark, rs, p=P)
    as_of = max(r["ts"] for r in rs)
    t0 = as_of - 1 * 86400 // 24
    want = brute(rs, P, t0, as_of)
    got = {x["client_uid"]: x["session_count"] for x in rows(sequence.sequence_metrics(pr.clients_in(
        pr.time_range(None, as_of).__class__(t0, as_of)), P, 5))}
    assert got == {u: v["sessions"] for u, v in want.items()}


def test_connection_summary(spark):
    r = [client(i, BASE + i * P, uid="a") for i in range(3)] + [client(9, BASE, uid="b")]
    out = one(sequence.connection_summary(presence(spark, r), 7))
    assert out == {"total_users": 2, "avg_online_time_hours": round(2 * P / 3600, 2)}
    empty = one(sequence.connection_summary(presence(spark, [], polls=[(BASE, 0)]), 7))
    assert empty == {"total_users": 0, "avg_online_time_hours": 0.0}


def test_ltv_score_by_hand_and_no_talkers(spark):
    day = 86400
    r = []
    i = 0
    # user a: 8 samples over 2 days, 2 channels; user b: 6 samples one day one channel; c: 3 samples (filtered)
    for k in range(8):
        i += 1
        r.append(client(i, BASE + (k // 4) * day + k * P, uid="a", channel=1 + k % 2, nickname=f"a{k % 3}"))
    for k in range(6):
        i += 1
        r.append(client(i, BASE + k * P, uid="b", channel=1, idle=600000))
    for k in range(3):
        i += 1
        r.append(client(i, BASE + k * P, uid="c", channel=3))
    pr = presence(spark, r, p=P)
    out = {x["client_uid"]: x for x in rows(ltv.ltv_scores(pr, None))}
    assert set(out) == {"a", "b"}
    a, b = out["a"], out["b"]
    # maxima over all users (c included): n 8, d 2, k 0 (talk term 0), c 2
    assert a["ltv_score"] == int(8 / 8 * 40 + 2 / 2 * 30 + 0.0 + 2 / 2 * 10) == 80
    assert b["ltv_score"] == int(6 / 8 * 40 + 1 / 2 * 30 + 0.0 + 1 / 2 * 10) == 50
    assert a["category"] == "power_user" and b["category_label"] == "Regular User"
    assert a["nickname"] == "a2" and a["session_count"] == 2 and b["session_count"] == 1
    assert b["avg_idle_minutes"] == 10.0 and a["avg_idle_minutes"] == 0.0
    span = (a["last_seen"] - a["first_seen"]) / 86400
    assert a["activity_frequency_percent"] == round(2 / span * 100, 2)
    assert b["avg_session_length_hours"] == round(6 * P / 3600 / 1, 2)
    s = one(ltv.ltv_summary(pr))
    assert s["total_users"] == 2 and s["avg_ltv_score"] == 65.0 and s["power_users"] == 1
    assert s["power_users_percent"] == 50.0 and s["casual_users"] == 0
    top = rows(ltv.lifetime_value(pr, None, 1))
    assert [x["client_uid"] for x in top] == ["a"]


def test_ltv_keeps_no_cache(spark):
    r = [client(i, BASE + i * P, uid=f"u{i % 2}", talk=i % 3 == 0) for i in range(40)]
    pr = presence(spark, r, p=P)
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert ltv.ltv_summary(pr).first()["total_users"] == 2
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held


def test_one_sample_per_user(spark):
    pr = presence(spark, [client(1, BASE, uid="a"), client(2, BASE + 5 * P, uid="b")], p=P)
    m = {r["client_uid"]: r for r in rows(sequence.sequence_metrics(pr.clients, P))}
    assert all(r["session_count"] == 1 and r["channel_switches"] == 0 for r in m.values())
    assert rows(sequence.channel_switches(pr, None, 10)) == []
    assert [r["session_count"] for r in rows(sequence.session_counts(pr, None, 10))] == [1, 1]
    assert rows(ltv.ltv_scores(pr)) == []                      # n <= 5: not scored
    assert one(ltv.ltv_summary(pr))["total_users"] == 0
    six = [client(i, BASE, uid="c", channel=1) for i in range(6)]   # six rows, one poll: span 0
    s = one(ltv.ltv_scores(presence(spark, six, p=P)))
    assert s["activity_frequency_percent"] == 0.0 and s["session_count"] == 1
