"""Hours and sessions maintained by the ingest: equal to batch after every micro-batch, late polls included."""

import json
import os
import random

import pytest
from frames import BASE, rows
from pyspark.sql import functions as F
from test_streaming import doc, land, person, run

from rollcall.operators import sequence
from rollcall.streaming import committed_presence, maintained_hours, maintained_sessions, start_presence_ingest

P, DAY = 30, 86400


def ingest(spark, tmp_path, **options):
    run(start_presence_ingest(spark, str(tmp_path / "landing"), str(tmp_path / "tables"), str(tmp_path / "ck"), views_interval_s=P, **options))
    return committed_presence(spark, str(tmp_path / "tables"), poll_interval_s=P)


def views(spark, tmp_path):
    root = str(tmp_path / "tables")
    return (sorted(map(tuple, maintained_sessions(spark, root, P).collect())), sorted(map(tuple, maintained_hours(spark, root).collect())))


def batch(pr):
    hours = pr.snapshots.groupBy((F.floor(F.col("ts") / 3600) * 3600).alias("h")).agg(
        F.round(F.avg("total_clients"), 2), F.max("total_clients"), F.count("*"))
    return sorted(map(tuple, sequence.sessions(pr, None).collect())), sorted(map(tuple, hours.collect()))


def test_late_and_split_polls_correct_exactly_their_rows(spark, tmp_path):
    landing = str(tmp_path / "landing")
    day = [doc(BASE + DAY + t * P, [person("a", clid=1)] + ([person("b", clid=2)] if t < 3 else [])) for t in (0, 1, 2, 6, 7, 200)]
    before = [doc(BASE + DAY - P, [person("a", clid=1), person("c", clid=3)])]
    land(landing, "f1.json", before + day)
    pr = ingest(spark, tmp_path)
    first = views(spark, tmp_path)
    assert first == batch(pr)
    # a day late: joins the two stretches of a, in an hour that was closed long ago
    land(landing, "f2.json", [doc(BASE + 3 * DAY, [person("z", clid=9)])])
    pr = ingest(spark, tmp_path)
    land(landing, "f3.json", [doc(BASE + DAY + 4 * P, [person("a", clid=1)])])
    pr = ingest(spark, tmp_path)
    second = views(spark, tmp_path)
    assert second == batch(pr)
    gone = set(first[0]) - set(second[0])
    assert gone == {("a", 1, BASE + DAY - P, BASE + DAY + 2 * P, 4), ("a", 2, BASE + DAY + 6 * P, BASE + DAY + 7 * P, 2), ("a", 3, BASE + DAY + 200 * P, BASE + DAY + 200 * P, 1)}
    assert set(second[0]) - set(first[0]) == {("a", 1, BASE + DAY - P, BASE + DAY + 7 * P, 7), ("a", 2, BASE + DAY + 200 * P, BASE + DAY + 200 * P, 1), ("z", 1, BASE + 3 * DAY, BASE + 3 * DAY, 1)}
    # another document of a poll that is there: only its new connection counts
    land(landing, "f4.json", [doc(BASE + DAY, [person("a", clid=1), person("d", clid=4)]), doc(BASE + DAY, [person("x")], code=3)])
    pr = ingest(spark, tmp_path)
    third = views(spark, tmp_path)
    assert third == batch(pr)
    assert set(third[0]) - set(second[0]) == {("d", 1, BASE + DAY, BASE + DAY, 1)} and not set(second[0]) - set(third[0])


@pytest.mark.parametrize("files", [1, 3])
def test_any_order_and_batch_size_gives_the_batch_answer(spark, tmp_path, files):
    rnd = random.Random(files)
    docs = []
    for k in range(9):
        t = BASE + rnd.choice([0, DAY - 3 * P, 2 * DAY]) + rnd.randint(0, 6) * P
        docs.append(doc(t, [person(u, clid=i) for i, u in enumerate("abc") if rnd.random() < 0.6]))
    for k, d in enumerate(docs):
        land(str(tmp_path / "landing"), f"f{k}.json", [d])
        os.utime(str(tmp_path / "landing" / f"f{k}.json"), (1_000_000 + k, 1_000_000 + k))
    pr = ingest(spark, tmp_path, max_files_per_trigger=files)
    assert views(spark, tmp_path) == batch(pr)


def test_replayed_batch_changes_nothing(spark, tmp_path):
    from rollcall.streaming.ingest import _write_tagged

    root = str(tmp_path / "tables")
    frames = [spark.createDataFrame([(BASE + k * P, json.dumps(doc(0, [person("a", clid=1)])["payload"]))], "poll_ts long, payload string") for k in (0, 5, 3)]
    for k in (0, 1, 1, 2, 2):
        _write_tagged(frames[k], f"q-{k}", root, False, P)
    assert views(spark, tmp_path)[0] == [("a", 1, BASE, BASE, 1), ("a", 2, BASE + 3 * P, BASE + 5 * P, 2)]
    assert views(spark, tmp_path) == batch(committed_presence(spark, root, poll_interval_s=P))
