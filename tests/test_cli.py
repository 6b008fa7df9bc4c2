import json
import os

import pytest
from frames import BASE, client, presence

from rollcall import cli
from rollcall.operators import users
from rollcall.sources.parquet import write_presence

P = 30


def test_cli_questions_run_and_write(spark, tmp_path):
    rs = [client(i, BASE + (i % 40) * P, uid=f"u{i % 6}", channel=1 + i % 3, talk=i % 4 == 0)
          for i in range(240)]
    root = str(tmp_path / "tables")
    write_presence(presence(spark, rs, channels=[(1, "Lobby", 0, 0, 0, 0)]), root)
    for q in sorted(cli.QUESTIONS):
        extra = ["--uid", "u1"] if q in ("user-stats",) else []
        df = cli.run([root, q, "--poll-interval", str(P), "--out", str(tmp_path / q), *extra])
        assert df.columns, q
    lines = []
    for name in os.listdir(tmp_path / "top-users"):
        if name.endswith(".json"):
            lines += [json.loads(x) for x in open(tmp_path / "top-users" / name)]
    assert sorted(x["client_uid"] for x in lines) == [f"u{i}" for i in range(6)]
    assert all(x["sample_count"] == 40 for x in lines)


def test_write_result_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    for fmt in ("parquet", "csv", "json"):
        cli.write_result(df, str(tmp_path / fmt), fmt)
    assert spark.read.parquet(str(tmp_path / "parquet")).collect()[0]["b"] == "x"
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).collect()[0]["a"] == "1"
    assert spark.read.json(str(tmp_path / "json")).collect()[0]["a"] == 1


def test_written_facts_are_clustered_by_user(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    from rollcall.sources.parquet import load_presence

    rs = [client(i, BASE + (i % 50) * 1800, uid=f"u{(i * 7) % 23:02d}") for i in range(600)]
    root = str(tmp_path / "t")
    write_presence(presence(spark, rs), root)
    files = glob.glob(f"{root}/clients/event_date=*/*.parquet")
    assert files
    for f in files:
        t = pq.read_table(f, columns=["client_uid", "ts"]).to_pylist()
        keys = [(r["client_uid"], r["ts"]) for r in t]
        assert keys == sorted(keys)                     # sorted runs of users inside each file
    pr = load_presence(spark, root)
    assert pr.clients.count() == 600 and pr.first_seen.count() == 23


def test_reports_print_every_row_of_every_part(spark, tmp_path, capsys):
    rs = [client(i, BASE + (i // 70) * P, uid=f"u{i % 70:02d}", rec=True) for i in range(140)]
    root = str(tmp_path / "tables")
    write_presence(presence(spark, rs), root)
    cli.run([root, "user-profile"])
    assert len(capsys.readouterr().out.splitlines()) == 70           # more than a screen, whole
    for q in sorted(cli.REPORTS):
        parts = cli.run([root, q, *(["--uid", "u01"] if q == "user-report" else []), *(["--out", str(tmp_path / q)] if q == "overview" else [])])
        out = capsys.readouterr().out.splitlines()
        if q == "overview":
            assert all(os.path.isdir(tmp_path / q / name) for name in parts) and not out
        else:
            assert [x[2:] for x in out if x.startswith("# ")] == list(parts)
            assert all(json.loads(x) for x in out if not x.startswith("# "))


def test_bounds_are_the_command_lines(spark):
    def checked(*argv):
        return cli.checked(cli.parser().parse_args(["tables", *argv]))
    assert checked("top-users").poll_interval == 30 and checked("daily-rollup").poll_interval == 60
    assert checked("ltv", "--limit", "500").limit == 500 and checked("top-users", "--poll-interval", "14400", "--any-interval").poll_interval == 14400
    for bad in (["top-users", "--limit", "101"], ["ltv", "--limit", "501"], ["top-users", "--limit", "0"], ["summary", "--poll-interval", "9"],
                ["summary", "--poll-interval", "3601"], ["user-stats"]):
        with pytest.raises(ValueError):
            checked(*bad)
    assert users.top_users(presence(spark, [client(i, BASE + i * P, f"u{i}") for i in range(150)]), None, 150).count() == 150
