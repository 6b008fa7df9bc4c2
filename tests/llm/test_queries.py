"""The registered queries: oracles, the pipeline, names."""

import os

import pytest

import corpus_pipeline
from rollcall.llm import registry
from tools.compare import compare, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_oracle(spark, name):
    problems, _, _, _ = compare(spark, duck(SF), name, registry.queries()[name], registry.oracle_sql()[name], SF)
    assert not problems, problems


def test_pipeline_stages_work_on_what_was_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids
        ids = now
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    want = {tuple(r) for r in docs.collect()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == want
    assert 0 < len(want) < 200
