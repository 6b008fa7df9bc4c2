"""Streaming ingest over landing files: several micro-batches, late and duplicate polls."""

import json
import os

import pytest
from frames import BASE, rows

from rollcall.operators import sequence, users
from rollcall.sources import payloads
from rollcall.streaming import (
    client_stream, committed_first_seen, committed_presence, current_presence, hourly_concurrency, latest_channels, poll_stream,
    session_stream,
    start_channel_upkeep, start_current_presence, start_presence_ingest,
)
from rollcall.tables import Presence

P = 30


def doc(ts, clients, code=0):
    return {"poll_ts": ts, "payload": {"status": {"code": code}, "body": clients}}


def person(uid, cid=1, **extra):
    return {"client_unique_identifier": uid, "client_nickname": f"n_{uid}", "cid": cid, "client_type": 0, **extra}


def land(folder, name, docs):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as fh:
        for d in docs:
            fh.write(json.dumps(d) + "\n")


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_ingest_in_batches_with_duplicates_and_late_polls(spark, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "tables")
    first = [doc(BASE, [person("a"), person("b", 2)]), doc(BASE + P, [person("a", 2)])]
    land(landing, "f1.json", first)
    run(start_presence_ingest(spark, landing, root, str(tmp_path / "ck")))
    # second batch: a duplicate of the first poll, a late poll, an error poll, an empty poll
    second = [doc(BASE, [person("a"), person("b", 2)]), doc(BASE + 3 * P, [person("a")]),
              doc(BASE + 2 * P, [person("b", 3)]), doc(BASE + 4 * P, [person("x")], code=5),
              doc(BASE + 5 * P, [])]
    land(landing, "f2.json", second)
    run(start_presence_ingest(spark, landing, root, str(tmp_path / "ck")))
    pr = committed_presence(spark, root, poll_interval_s=P)
    polls = {r["ts"]: r["total_clients"] for r in rows(pr.snapshots)}
    assert polls == {BASE: 2, BASE + P: 1, BASE + 2 * P: 1, BASE + 3 * P: 1, BASE + 5 * P: 0}
    counts = {r["client_uid"]: r["sample_count"] for r in rows(users.top_users(pr, None, 10))}
    assert counts == {"a": 3, "b": 2}
    # same answer as ingesting all documents in one batch
    texts = spark.createDataFrame([(d["poll_ts"], json.dumps(d["payload"])) for d in first + second],
                                  "poll_ts long, payload string")
    sn, cs = payloads.ingest_client_payloads(texts)
    batch = Presence(sn, cs, pr.channels, P)
    assert rows(users.top_users(batch, None, 10)) == rows(users.top_users(pr, None, 10))
    fs = committed_first_seen(spark, root)
    assert sorted(rows(fs), key=lambda r: r["client_uid"]) == \
        sorted(rows(users.first_seen(pr)), key=lambda r: r["client_uid"])
    as_of = BASE + 5 * P
    assert rows(users.growth_metrics(pr, 1, as_of, first_seen_table=fs)) == rows(users.growth_metrics(pr, 1, as_of))


def test_torn_batch_is_hidden_until_its_snapshots_exist(spark, tmp_path):
    root = str(tmp_path / "tables")
    texts = spark.createDataFrame([(BASE, json.dumps(doc(BASE, [person("a")])["payload"]))],
                                  "poll_ts long, payload string")
    sn, cs = payloads.ingest_client_payloads(texts)
    cs.write.partitionBy("event_date").parquet(os.path.join(root, "clients", "batch=000000001"))
    sn.limit(0).write.partitionBy("event_date").parquet(os.path.join(root, "snapshots", "batch=000000001"))
    assert committed_presence(spark, root).clients.count() == 0


def test_streaming_sessions_match_batch(spark, tmp_path):
    landing = str(tmp_path / "landing")
    times = [0, P, 2 * P, 4 * P, 6 * P + 1, 7 * P + 1, 100 * P]       # gap 2p joins, 2p+1 splits
    land(landing, "f.json", [doc(BASE + t, [person("a")]) for t in times])
    q = (session_stream(client_stream(poll_stream(spark, landing, "0 seconds", dedupe=False)), P)
         .writeStream.outputMode("append").format("memory").queryName("sessions_out")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    run(q)
    got = sorted((r["session_start"], r["session_end"], r["samples"]) for r in rows(spark.table("sessions_out")))
    texts = spark.createDataFrame([(BASE + t, json.dumps(doc(BASE + t, [person("a")])["payload"])) for t in times],
                                  "poll_ts long, payload string")
    sn, cs = payloads.ingest_client_payloads(texts)
    batch = sorted((r["session_start"], r["session_end"], r["samples"])
                   for r in rows(sequence.sessions(Presence(sn, cs, sn.limit(0), P), None)))
    # the last session stays open (no later poll has moved the watermark past it)
    assert got == batch[:-1]
    assert batch[:2] == [(BASE, BASE + 4 * P, 4), (BASE + 6 * P + 1, BASE + 7 * P + 1, 2)]


def test_hourly_concurrency_stream(spark, tmp_path):
    landing = str(tmp_path / "landing")
    land(landing, "f.json", [doc(BASE, [person("a"), person("b")]), doc(BASE + 600, [person("a")]),
                             doc(BASE + 3600, []), doc(BASE + 3 * 3600, [person("c")])])
    q = (hourly_concurrency(poll_stream(spark, landing, "0 seconds"))
         .writeStream.outputMode("append").format("memory").queryName("hourly_out")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    run(q)
    got = sorted((r["hour"]["start"].hour if hasattr(r["hour"]["start"], "hour") else r["hour"]["start"],
                  r["avg_clients"], r["max_clients"], r["polls"]) for r in rows(spark.table("hourly_out")))
    assert [g[1:] for g in got][:2] == [(1.5, 2, 2), (0.0, 0, 1)]


def test_current_presence_and_channel_upkeep(spark, tmp_path):
    landing, cur = str(tmp_path / "landing"), str(tmp_path / "current")
    land(landing, "f1.json", [doc(BASE, [person("a")]), doc(BASE + P, [person("b"), person("c")])])
    run(start_current_presence(spark, landing, cur, str(tmp_path / "ck1")))
    land(landing, "f2.json", [doc(BASE - P, [person("old")])])        # an older poll arriving late
    run(start_current_presence(spark, landing, cur, str(tmp_path / "ck1")))
    assert sorted(r["client_uid"] for r in rows(spark.read.parquet(cur))) == ["b", "c"]

    chl, dim = str(tmp_path / "chl"), str(tmp_path / "dim")
    land(chl, "c1.json", [{"poll_ts": BASE, "payload": {"body": [{"cid": 1, "channel_name": "Lobby"},
                                                                  {"cid": 2, "channel_name": "AFK"}]}}])
    run(start_channel_upkeep(spark, chl, dim, str(tmp_path / "ck2")))
    land(chl, "c2.json", [{"poll_ts": BASE + 3600, "payload": {"body": [{"cid": 1, "channel_name": "Hall"}]}}])
    run(start_channel_upkeep(spark, chl, dim, str(tmp_path / "ck2")))
    names = {r["channel_id"]: r["channel_name"] for r in rows(latest_channels(spark, dim))}
    assert names == {1: "Hall", 2: "AFK"}


def test_poll_later_than_the_watermark_is_dropped(spark, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "tables")
    land(landing, "f1.json", [doc(BASE + 3600, [person("a")]), doc(BASE + 3600 + P, [person("a")])])
    run(start_presence_ingest(spark, landing, root, str(tmp_path / "ck"), lateness="1 minute",
                              dedupe="watermark"))
    land(landing, "f2.json", [doc(BASE, [person("late")]),                       # an hour behind: dropped
                              doc(BASE + 3600 + P - 20, [person("b")])])         # within a minute: kept
    run(start_presence_ingest(spark, landing, root, str(tmp_path / "ck"), lateness="1 minute",
                              dedupe="watermark"))
    pr = committed_presence(spark, root, poll_interval_s=P)
    assert sorted(r["ts"] for r in rows(pr.snapshots)) == [BASE + 3600, BASE + 3600 + P - 20, BASE + 3600 + P]
    assert "late" not in {r["client_uid"] for r in rows(pr.clients)}


def test_compact_first_seen_job(spark, tmp_path):
    from rollcall import jobs

    landing, root, out = str(tmp_path / "landing"), str(tmp_path / "tables"), str(tmp_path / "fs")
    land(landing, "f1.json", [doc(BASE, [person("a")]), doc(BASE + P, [person("a"), person("b")])])
    run(start_presence_ingest(spark, landing, root, str(tmp_path / "ck")))
    land(landing, "f2.json", [doc(BASE + 2 * P, [person("b"), person("c")])])
    run(start_presence_ingest(spark, landing, root, str(tmp_path / "ck")))
    jobs.compact_first_seen(spark, root, out)
    got = {r["client_uid"]: r["first_ts"] for r in rows(spark.read.parquet(out))}
    assert got == {"a": BASE, "b": BASE + P, "c": BASE + 2 * P}


def test_compact_ingested_tables(spark, tmp_path):
    from rollcall import jobs
    from rollcall.sources.parquet import load_presence

    landing, root, out = str(tmp_path / "landing"), str(tmp_path / "tables"), str(tmp_path / "compact")
    for i in range(3):
        land(landing, f"f{i}.json", [doc(BASE + i * P, [person("a"), person(f"u{i}")])])
        run(start_presence_ingest(spark, landing, root, str(tmp_path / "ck")))
    jobs.compact_ingested(spark, root, out, poll_interval_s=P)
    pr = load_presence(spark, out, P)
    assert pr.clients.count() == 6 and pr.snapshots.count() == 3 and pr.first_seen.count() == 4
    assert rows(users.top_users(pr, None, 10)) == rows(users.top_users(committed_presence(spark, root,
                                                                                          poll_interval_s=P),
                                                                       None, 10))



def test_committed_dedupe_keeps_late_polls_and_drops_repeats(spark, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "tables")
    land(landing, "f1.json", [doc(BASE + 3600, [person("a")]), doc(BASE + 3600 + P, [person("a")])])
    run(start_presence_ingest(spark, landing, root, str(tmp_path / "ck"), lateness="1 minute"))
    land(landing, "f2.json", [doc(BASE, [person("late")]),                       # an hour late: kept
                              doc(BASE + 3600, [person("a")])])                  # already committed: dropped
    run(start_presence_ingest(spark, landing, root, str(tmp_path / "ck"), lateness="1 minute"))
    pr = committed_presence(spark, root, poll_interval_s=P)
    assert sorted(r["ts"] for r in rows(pr.snapshots)) == [BASE, BASE + 3600, BASE + 3600 + P]
    assert sorted(r["client_uid"] for r in rows(pr.clients)) == ["a", "a", "late"]


def test_replayed_batch_rewrites_its_own_output(spark, tmp_path):
    from rollcall.streaming.ingest import _write_batch

    root = str(tmp_path / "tables")
    batch = spark.createDataFrame([(BASE, json.dumps(doc(BASE, [person("a"), person("b")])["payload"]))],
                                  "poll_ts long, payload string")
    _write_batch(batch, 7, root, False)
    _write_batch(batch, 7, root, False)           # the same batch again after a failure
    pr = committed_presence(spark, root, poll_interval_s=P)
    assert pr.clients.count() == 2 and [r["total_clients"] for r in rows(pr.snapshots)] == [2]
    _write_batch(batch, 8, root, False)           # a later batch repeating the poll adds nothing
    pr = committed_presence(spark, root, poll_interval_s=P)
    assert pr.clients.count() == 2 and pr.snapshots.count() == 1


def test_batch_read_of_landing_files(spark, tmp_path):
    from rollcall.sources.payloads import ingest_client_payloads, read_payload_text

    landing = str(tmp_path / "landing")
    land(landing, "f1.json", [doc(BASE, [person("a"), person("b")]), doc(BASE + P, [])])
    land(landing, "f2.json", [doc(BASE, [person("a"), person("b")])])          # a copy of the first poll
    sn, cs = ingest_client_payloads(read_payload_text(spark, landing))
    assert sorted((r["ts"], r["total_clients"]) for r in rows(sn)) == [(BASE, 2), (BASE + P, 0)]
    assert cs.count() == 2


def test_second_query_keeps_the_first_ones_rows(spark, tmp_path):
    root = str(tmp_path / "tables")
    for k in range(2):      # each with a landing folder and a checkpoint of its own, both at batch 0
        landing = str(tmp_path / f"landing{k}")
        land(landing, "f.json", [doc(BASE + k * P, [person(f"u{k}")])])
        run(start_presence_ingest(spark, landing, root, str(tmp_path / f"ck{k}"), max_files_per_trigger=1))
    pr = committed_presence(spark, root, poll_interval_s=P)
    assert sorted(r["client_uid"] for r in rows(pr.clients)) == ["u0", "u1"] and pr.snapshots.count() == 2


def test_current_presence_after_an_empty_poll(spark, tmp_path):
    landing, cur, ck = str(tmp_path / "landing"), str(tmp_path / "current"), str(tmp_path / "ck")
    assert current_presence(spark, cur).count() == 0
    land(landing, "f1.json", [doc(BASE, [person("a"), person("b")])])
    run(start_current_presence(spark, landing, cur, ck))
    assert sorted(r["client_uid"] for r in rows(current_presence(spark, cur))) == ["a", "b"]
    land(landing, "f2.json", [doc(BASE + P, []), doc(BASE + 2 * P, [person("x")], code=5)])     # empty; rejected
    run(start_current_presence(spark, landing, cur, ck))
    assert current_presence(spark, cur).count() == 0
    land(landing, "f3.json", [doc(BASE - P, [person("late")])])
    run(start_current_presence(spark, landing, cur, ck))
    assert current_presence(spark, cur).count() == 0


def test_channel_versions_go_on_after_a_new_checkpoint(spark, tmp_path):
    from rollcall.streaming.ingest import _upkeep_batch

    dim = str(tmp_path / "dim")
    for k, name in enumerate(("A", "B", "C")):
        landing = str(tmp_path / f"chl{k}")
        land(landing, "c.json", [{"poll_ts": BASE + k, "payload": {"body": [{"cid": 1, "channel_name": name}]}}])
        run(start_channel_upkeep(spark, landing, dim, str(tmp_path / f"ck{k}")))
        assert [r["channel_name"] for r in rows(latest_channels(spark, dim))] == [name]
    batch = spark.createDataFrame([(BASE + 9, json.dumps({"body": [{"cid": 2, "channel_name": "D"}]}))], "poll_ts long, payload string")
    for _ in range(2):      # a replay writes the same version again
        _upkeep_batch(batch, "q-5", dim)
        assert sorted(r["channel_name"] for r in rows(latest_channels(spark, dim))) == ["C", "D"]
    assert sorted(p for p in os.listdir(dim) if p.startswith("v=")) == ["v=0", "v=1", "v=2", "v=3"]


SPLIT = [doc(BASE, [person("a", clid=1), person("b", clid=2)]), doc(BASE, [person("c", clid=3), person("a", clid=1)]),
         doc(BASE, [person("x")], code=7), doc(BASE + P, [person("a", clid=1)]), doc(BASE, [person("a", clid=1), person("b", clid=2)]),
         doc(BASE + P, []), doc(BASE + P, [person("d", clid=9)])]


@pytest.mark.parametrize("dedupe", ["committed", "watermark"])
@pytest.mark.parametrize("files", [None, 1, 2, 3])
def test_documents_of_a_poll_are_united_for_any_batch_size(spark, tmp_path, dedupe, files):
    landing, root, current = (str(tmp_path / n) for n in ("landing", "tables", "current"))
    for k, d in enumerate(SPLIT):
        land(landing, f"f{k}.json", [d])
        os.utime(os.path.join(landing, f"f{k}.json"), (1_000_000 + k, 1_000_000 + k))
    run(start_presence_ingest(spark, landing, root, str(tmp_path / "ck"), dedupe=dedupe, max_files_per_trigger=files))
    pr = committed_presence(spark, root, poll_interval_s=P)
    texts = spark.createDataFrame([(d["poll_ts"], json.dumps(d["payload"])) for d in SPLIT], "poll_ts long, payload string")
    sn, cs = payloads.ingest_client_payloads(texts)
    assert sorted(map(tuple, pr.snapshots.collect())) == sorted(map(tuple, sn.collect()))
    assert sorted(map(str, pr.clients.collect())) == sorted(map(str, cs.collect()))
    assert {r["ts"]: r["total_clients"] for r in rows(pr.snapshots)} == {BASE: 3, BASE + P: 2}
    assert sorted(r["client_uid"] for r in rows(pr.clients)) == ["a", "a", "b", "c", "d"]
    if dedupe == "committed":
        run(start_current_presence(spark, landing, current, str(tmp_path / "ck2")))
        assert sorted(r["client_uid"] for r in rows(current_presence(spark, current))) == ["a", "d"]


def test_current_presence_unites_documents_of_several_batches(spark, tmp_path):
    from rollcall.streaming.ingest import _write_current

    cur = str(tmp_path / "current")
    texts = [spark.createDataFrame([(d["poll_ts"], json.dumps(d["payload"]))], "poll_ts long, payload string")
             for d in (SPLIT[0], SPLIT[1], doc(BASE - P, [person("old")]))]
    for k, want in ((0, "ab"), (1, "abc"), (1, "abc"), (2, "abc"), (0, "abc")):      # a replay, a late poll, a replay
        _write_current(texts[k], f"q-{k}", cur)
        assert "".join(sorted(r["client_uid"] for r in rows(current_presence(spark, cur)))) == want


def test_streamed_sessions_count_a_connection_once(spark, tmp_path):
    landing = str(tmp_path / "landing")
    docs = [doc(BASE, [person("a", clid=1)]), doc(BASE, [person("b", clid=2), person("a", clid=1)]), doc(BASE, [person("a", clid=1)]),
            doc(BASE + P, [person("a", clid=1)]), doc(BASE + 100 * P, [])]
    land(landing, "f.json", docs)
    land(landing, "g.json", [doc(BASE + 200 * P, [person("z", clid=1)])])
    q = (session_stream(client_stream(poll_stream(spark, landing, "0 seconds")), P)
         .writeStream.outputMode("append").format("memory").queryName("united_sessions")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    run(q)
    got = {r["client_uid"]: r["samples"] for r in rows(spark.table("united_sessions"))}
    assert got == {"a": 2, "b": 1}
