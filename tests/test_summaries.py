"""Day summaries give what the facts give, follow late polls, and spare the facts."""

import os
import random
import re

import pytest
from frames import BASE, client, presence, rows

from rollcall import jobs
from rollcall.operators import channels, load, ltv, maintenance, metrics, sequence, summaries, users
from rollcall.sources.parquet import load_presence, write_presence
from rollcall.tables import Presence

P, DAY = 30, 86400

QUESTIONS = {
    "ltv": lambda pr, days: ltv.lifetime_value(pr, days, 100),
    "ltv_summary": lambda pr, days: ltv.ltv_summary(pr, days),
    "switches": lambda pr, days: sequence.channel_switches(pr, days, 100),
    "counts": lambda pr, days: sequence.session_counts(pr, days, 100),
    "sessions": lambda pr, days: sequence.sessions(pr, days),
    "connections": lambda pr, days: sequence.connection_summary(pr, days),
    "channels": lambda pr, days: channels.channel_stats(pr, days),
    "favorites": lambda pr, days: users.favorite_channels(pr, None, days),
    "summary": lambda pr, days: load.summary(pr, days),
    "growth": lambda pr, days: users.growth_metrics(pr, days or 30),
    "metrics": lambda pr, days: metrics.metrics_snapshot(pr, days or 30),
    "channel_estimate": lambda pr, days: channels.channel_users_estimate(pr, days),
    "users_estimate": lambda pr, days: load.unique_users_estimate(pr, days),
}


def history(days=4, seed=3):
    """Samples of a few users over some days: gaps, runs over midnight, two rows in one poll, empty days."""
    rnd = random.Random(seed)
    out, at = [], 0
    for day in range(days):
        if day == 2:
            continue
        for uid in "abcd":
            t = BASE + day * DAY + rnd.choice([0, DAY - 20 * P, 40_000])
            for _ in range(rnd.randint(5, 40)):
                t += rnd.choice([P, P, P, 2 * P, 2 * P + 1, 3000])
                for _ in range(1 + (rnd.random() < 0.1)):
                    out.append(client(at := at + 1, t, uid, rnd.randint(1, 4), f"n{rnd.randint(0, 3)}", rnd.choice([None, 0, 5000]), talk=rnd.random() < 0.3))
    return out


def answers(pr, days):
    return {name: sorted(map(str, rows(op(pr, days)))) for name, op in QUESTIONS.items()}


SEQUENCES = ("ltv", "switches", "counts", "sessions", "channels", "summary")


def sequence_answers(pr, days):
    return {name: sorted(map(str, rows(QUESTIONS[name](pr, days)))) for name in SEQUENCES}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    write_presence(presence(spark, history(), p=P), root)
    plain = load_presence(spark, root, P)
    assert plain.summaries is None
    done = jobs.refresh_summaries(spark, root, P)
    assert len(done) >= 3 and jobs.refresh_summaries(spark, root, P) == []
    return root, plain, load_presence(spark, root, P)


@pytest.mark.parametrize("days", [None, 2])
def test_same_answers_with_and_without(stored, days):
    _, plain, kept = stored
    assert kept.summaries is not None
    assert answers(kept, days) == answers(plain, days)


def test_whole_history_reads_no_fact(spark, stored):
    _, _, kept = stored
    for name, op in QUESTIONS.items():
        if name not in ("metrics", "growth"):     # metrics also reads the newest poll, growth looks back 30 days
            text = op(kept, None)._jdf.queryExecution().toString()
            assert "summaries" in text and not re.search(r"Location: InMemoryFileIndex[^\n]*/clients", text), name
    assert summaries.split(kept, kept.time_range(None))[1] is None
    days, facts = summaries.split(kept, kept.time_range(1))
    assert days and facts is not None


def test_late_poll_makes_its_day_open_until_the_next_refresh(spark, tmp_path):
    root = str(tmp_path / "t")
    data = history()
    late = [client(9001, BASE + DAY + 77 * P, "a", 9, "late"), client(9002, BASE + DAY + 77 * P, "z", 9, "new")]
    data = [r for r in data if r["ts"] != late[0]["ts"]]
    write_presence(presence(spark, data, p=P), root)
    jobs.refresh_summaries(spark, root, P)
    write_presence(presence(spark, late, p=P), root, mode="append")
    want = sequence_answers(presence(spark, data + late, p=P), None)
    now = load_presence(spark, root, P)
    _, facts = summaries.split(now, now.time_range(None))
    assert {r["event_date"] for r in rows(facts.select("event_date").distinct())} == {late[0]["event_date"]}
    assert sequence_answers(now, None) == want
    assert jobs.refresh_summaries(spark, root, P) == [late[0]["event_date"]]
    again = load_presence(spark, root, P)
    assert summaries.split(again, again.time_range(None))[1] is None
    assert sequence_answers(again, None) == want
    assert sequence_answers(again.with_interval(60), None) == sequence_answers(presence(spark, data + late, p=60), None)   # another interval: not used


def test_slices_get_shorter_for_large_polls(spark):
    pr = presence(spark, [], polls=[(BASE, 5)], p=P)
    assert sequence.slice_polls_for(pr) == sequence.SLICE_POLLS
    assert sequence.slice_polls_for(presence(spark, [], polls=[(BASE, 5_000)], p=P)) == 6
    assert sequence.slice_polls_for(presence(spark, [], polls=[(BASE, 1 << 30)], p=P)) == 1


def test_numbering_needs_no_window_over_all_pieces(spark):
    """The windows are over one day's pieces and over one row per user and day."""
    text = sequence.sessions(presence(spark, history(), p=P), None)._jdf.queryExecution().toString()
    keys = set(re.findall(r"hashpartitioning\(([^)]*)\)", text))
    assert any("_slice" in k for k in keys) and any("_day" in k for k in keys)
    assert not [line for line in text.splitlines() if line.lstrip(" +-:").startswith("Window") and "end_ts" in line and "_day" not in line]


def test_sketches_of_days_merge_within_their_error(spark, tmp_path):
    people = [client(i, BASE + (i % 3) * DAY, f"u{i % 30_000}", i % 2) for i in range(60_000)]
    pr = presence(spark, people, p=P)
    write_presence(pr, str(tmp_path))
    jobs.refresh_summaries(spark, str(tmp_path), P)
    kept = load_presence(spark, str(tmp_path), P)
    got = rows(load.unique_users_estimate(kept, None))[0]
    assert got["total_samples"] == 60_000 and abs(got["unique_users_estimate"] - 30_000) < 0.03 * 30_000
    exact = {r["channel_id"]: r["unique_users"] for r in rows(channels.channel_stats(kept, None))}
    for r in rows(channels.channel_users_estimate(kept, None)):
        assert abs(r["unique_users_estimate"] - exact[r["channel_id"]]) < 0.03 * exact[r["channel_id"]]
    assert rows(load.unique_users_estimate(presence(spark, [], p=P), None)) == [{"total_samples": 0, "unique_users_estimate": 0}]


def files(root):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f))
            for t in ("clients", "snapshots") for d, _, names in os.walk(os.path.join(root, t)) for f in names}


def test_retention_drops_whole_days_and_hides_the_rest(spark, tmp_path):
    root = str(tmp_path / "t")
    data = history(days=5)
    write_presence(presence(spark, data, p=P), root)
    jobs.refresh_summaries(spark, root, P)
    before = files(root)
    as_of = max(r["ts"] for r in data)
    want, gone = maintenance.retain(presence(spark, data, p=P), as_of, 2)
    want_gone = rows(gone)[0]
    removed = jobs.expire_days(spark, root, 2, poll_interval_s=P)
    assert removed == (want_gone["removed_snapshots"], want_gone["removed_client_rows"]) and removed[1] > 0
    now = load_presence(spark, root, P)
    assert sequence_answers(now, None) == sequence_answers(Presence(want.snapshots, want.clients, want.channels, P), None)
    assert sorted(map(str, rows(now.first_seen))) == sorted(map(str, rows(users.first_seen(want))))
    after = files(root)
    assert set(after) < set(before) and all(before[f] == m for f, m in after.items())        # nothing of a kept day was written
    assert jobs.expire_days(spark, root, 2, poll_interval_s=P) == (0, 0)


def test_tables_written_anew_forget_what_was_kept_beside_the_old_ones(spark, tmp_path):
    root = str(tmp_path / "t")
    old = presence(spark, history(days=5), channels=[(1, "Old", 0, 0, 0, 5)], p=P)
    write_presence(old, root)
    write_presence(presence(spark, [client(5000, BASE - DAY, "early")], channels=[(1, "Newer", 0, 0, 0, 9)], p=P), root, mode="append")
    jobs.refresh_summaries(spark, root, P)
    now = load_presence(spark, root, P)
    assert [r["channel_name"] for r in rows(now.channels)] == ["Newer"]
    assert {r["client_uid"]: r["first_ts"] for r in rows(now.first_seen)}["early"] == BASE - DAY
    jobs.compact_appended(spark, root, str(tmp_path / "c"), P)
    again = load_presence(spark, str(tmp_path / "c"), P)
    assert sorted(map(str, rows(again.first_seen))) == sorted(map(str, rows(now.first_seen))) and again.clients.count() == now.clients.count()
    jobs.expire_days(spark, root, 1, poll_interval_s=P)
    fresh = presence(spark, [client(1, BASE, "a")], channels=[(1, "First", 0, 0, 0, 1)], p=P)
    write_presence(fresh, root)
    now = load_presence(spark, root, P)
    assert [r["channel_name"] for r in rows(now.channels)] == ["First"] and [r["client_uid"] for r in rows(now.first_seen)] == ["a"]
    assert now.clients.count() == 1 and summaries.split(now, now.time_range(None))[0] == []
