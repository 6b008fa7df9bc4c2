"""Physical-plan properties: pruning reaches the scan, no Cartesian products, no Python UDFs."""

import os
import re

import pytest

import __spark_entry__ as entry
from rollcall.operators import channels, load, ltv, maintenance, rollup, sequence, status, users
from rollcall.sources.events_adapter import ADAPTER_POLL_INTERVAL_S, load_adapter
from rollcall.sources.parquet import load_presence, write_presence

SMOKE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMOKE), reason="test tables not present")

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas")


def plan_text(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_registered_plans_have_no_cartesian_or_python_steps(spark, name):
    text = plan_text(entry.queries()[name](spark, SMOKE))
    assert not [f for f in FORBIDDEN if f in text]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("presence"))
    write_presence(load_adapter(spark, SMOKE), root)
    return load_presence(spark, root, ADAPTER_POLL_INTERVAL_S)


@pytest.mark.parametrize("op", [
    lambda pr: users.top_users(pr, 7, 10),
    lambda pr: load.hourly_heatmap(pr, 7),
    lambda pr: channels.channel_stats(pr, 7),
    lambda pr: status.mute_summary(pr, 7),
    lambda pr: sequence.channel_switches(pr, 7, 10),
    lambda pr: sequence.session_counts(pr, 7, 10),
])
def test_time_range_reaches_the_scan(stored, op):
    text = plan_text(op(stored))
    assert re.search(r"PartitionFilters: \[[^\]]*event_date", text)
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts,", text)
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(ts,", text)


def test_scan_reads_only_needed_columns(stored):
    text = plan_text(status.mute_summary(stored, 7))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and all("nickname" not in s and "server_groups" not in s for s in schemas)


def test_online_now_reads_one_poll(stored):
    text = plan_text(status.online_now(stored))
    assert re.search(r"PartitionFilters: \[[^\]]*event_date#\d+ = ", text)
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(snapshot_id,", text)


def test_sequence_plan_shuffles_twice(stored):
    text = plan_text(sequence.channel_switches(stored, None, 10))
    exchanges = re.findall(r"Exchange\s*\n?\s*Input \[\d+\]: \[[^\]]*\]\s*\n?\s*Arguments: hashpartitioning\(([^)]*)\)",
                           text)
    assert sorted(e.split(",")[0].split("#")[0] for e in exchanges) == ["client_uid", "client_uid"]
    keys = [tuple(k.strip().split("#")[0] for k in e.split(",")[:-1]) for e in exchanges]
    assert ("client_uid", "_slice") in keys and ("client_uid",) in keys


def test_ltv_keeps_no_cache_and_reads_the_fact_twice(stored):
    """Once for the users' rows, once (fewer columns) for the normalizers; nothing stays persisted."""
    before = stored.spark.sparkContext._jsc.getPersistentRDDs().size()
    text = plan_text(ltv.lifetime_value(stored, None, 50))
    scans = re.findall(r"Location: InMemoryFileIndex [^\n]*clients", text)
    assert len(scans) == 2 and "InMemoryTableScan" not in text
    assert stored.spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_retention_and_compatible_rollup_prune_days(stored):
    day = stored.latest_poll()[2]
    assert re.search(r"PartitionFilters: \[[^\]]*event_date[^\]]* IN ", plan_text(rollup.daily_user_rollup(stored, [day])) +
                     plan_text(rollup.daily_user_rollup(stored, [day], compat=True)))
    kept, removed = maintenance.retain(stored, stored.latest_ts(), 1)
    for df, side in ((kept.clients, ">="), (kept.snapshots, ">="), (removed, "<=")):
        assert re.search(r"PartitionFilters: \[[^\]]*event_date#\d+ " + side, plan_text(df))


def test_growth_reads_first_seen_table_not_history(stored):
    assert stored.first_seen is not None
    text = plan_text(users.growth_metrics(stored, 7))
    assert re.search(r"Location: InMemoryFileIndex [^\n]*first_seen", text)
    client_scans = re.findall(r"Location: InMemoryFileIndex [^\n]*clients", text)
    assert len(client_scans) == 1                                   # only the range scan
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts,", text)


def test_dataset_stats_same_with_side_table(stored):
    with_table = load.dataset_stats(stored).first()
    without = load.dataset_stats(stored.__class__(stored.snapshots, stored.clients, stored.channels,
                                                   stored.poll_interval_s)).first()
    assert with_table == without
