"""Every registered question against its DuckDB SQL on the sf0.01 tables (driver contract)."""

import os

import pytest

import __spark_entry__ as entry
from rollcall.plans import oracle, registry
from tools.compare import compare, duck

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_question_has_an_oracle():
    assert set(registry.queries()) == set(oracle.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_question_matches_oracle(spark, con, name):
    problems, _, n_spark, _ = compare(spark, con, name, registry.queries()[name], oracle.oracle_sql()[name], SF)
    assert not problems, problems


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "ltv_score" in df.columns
