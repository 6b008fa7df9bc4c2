import random

from pyspark.sql import functions as F

from rollcall.functions.columns import channel_label, round2, split_groups, trim_groups
from rollcall.functions.time import day_name, hour_utc, iso_datetime, weekday_sun0


def test_round2_matches_python_round(spark):
    rnd = random.Random(7)
    values = [9.415, 2.675, 0.125, 0.375, 1.005, -9.415, -0.125, 0.0, 4.995, 12345.675]
    values += [rnd.randint(0, 10**6) / 1000 for _ in range(300)]
    values += [rnd.random() * 1000 for _ in range(300)]
    values += [rnd.randint(1, 5000) / rnd.randint(1, 97) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(round2("x")).collect()]
    assert got == [round(v, 2) for v in values]


def test_time_buckets_utc(spark):
    # 2024-01-07 00:00:00 UTC is a Sunday at midnight
    df = spark.createDataFrame([(1704585600,), (1704585599,)], "ts long")
    out = df.select(hour_utc("ts").alias("h"), weekday_sun0("ts").alias("d"),
                    day_name(weekday_sun0("ts")).alias("n"), iso_datetime("ts").alias("iso")).collect()
    assert (out[0].h, out[0].d, out[0].n, out[0].iso) == (0, 0, "Sunday", "2024-01-07T00:00:00")
    assert (out[1].h, out[1].d, out[1].n) == (23, 6, "Saturday")


def test_group_splitting(spark):
    df = spark.createDataFrame([("6, 10",), ("",), (None,), ("8,8, ,",)], "g string")
    out = df.select(split_groups("g").alias("s"), trim_groups("g").alias("t")).collect()
    assert out[0].s == ["6", " 10"] and out[0].t == ["6", "10"]
    assert out[1].s == [] and out[1].t == []
    assert out[2].s == [] and out[2].t == []
    assert out[3].t == ["8", "8"]


def test_channel_label(spark):
    df = spark.createDataFrame([(1, "Lobby"), (2, ""), (3, None)], "id long, name string")
    assert [r[0] for r in df.select(channel_label("id", "name")).collect()] == ["Lobby", "Channel 2", "Channel 3"]


def test_cluster_settings_size_partitions():
    from rollcall.session import cluster_settings

    big = cluster_settings(100 * 2**40, cores=8000)          # 100 TiB on 8000 cores
    assert int(big["spark.sql.shuffle.partitions"]) == 100 * 2**40 // (256 << 20) + 1
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"
    small = cluster_settings(10 << 20, cores=8)
    assert int(small["spark.sql.shuffle.partitions"]) == 16


def test_time_buckets_ignore_session_zone(spark):
    from rollcall.functions.time import datetime_text, utc_date

    zone = spark.conf.get("spark.sql.session.timeZone")
    df = spark.createDataFrame([(1704585600,), (1704585599,), (0,), (1706644800 + 3661,)], "ts long")
    cols = [hour_utc("ts").alias("h"), weekday_sun0("ts").alias("d"), utc_date("ts").alias("day"),
            iso_datetime("ts").alias("iso"), datetime_text("ts").alias("txt")]
    try:
        spark.conf.set("spark.sql.session.timeZone", "Pacific/Chatham")
        shifted = [tuple(r) for r in df.select(*cols).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    utc = [tuple(r) for r in df.select(*cols).collect()]
    assert shifted == utc
    assert utc[0][:2] == (0, 0) and utc[2][3] == "1970-01-01T00:00:00" and utc[3][4] == "2024-01-30 21:01:01"
