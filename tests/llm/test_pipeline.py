"""The pipeline's stages on awkward tables, and the whole against its stages written down plainly."""

import collections
import os

import pytest

import corpus_pipeline
from rollcall.llm import bpe, decontaminate, line_dedup, quality, simhash

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, `__doc_id` long, `__bad_id` string, `__stay` int, "
          "`__row` string, `a.b` int, DOC string, facts map<string,int>, c0 int, kept boolean")
GOOD = "the first of many words that stand in this text and are all different from each other so that no window of three comes twice here "


def _rows():
    more = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(i, f"{GOOD}\n{more(i)}\nlast line {i}", "en" if i % 3 else None, "s" if i % 5 else None, i) for i in range(30)]
    rows += [(100, None, "en", "s", None), (101, "", None, None, 0), (102, " \n\t\n ", "en", "s", 4), (103, "short", "en", "s", 5),
             (None, rows[1][1], "en", "s", 1), (None, None, None, None, None), rows[2], rows[2], (104, rows[3][1], "en", "s", 9),
             (105, "long " + " ".join(f"q{j}" for j in range(20_000)), "en", "s", 9)]
    return [(*r, 7, "x", 1, "r", 3, "D", {"k": 1, "m": k}, 5, True) for k, r in enumerate(rows)]


@pytest.fixture(scope="module")
def benchmark_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, "w5x3 w5x4 w5x5 w5x6 w5x7 w5x8 w5x9 w5x10 w5x11 w5x12 w5x13"), (2, None), (None, "x y")],
                          "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_any_table(spark, benchmark_dir, name, stage):
    docs = spark.createDataFrame(_rows(), SCHEMA).repartition(3)
    out = stage(spark, docs, benchmark_dir)
    rows = out.collect()
    empty = stage(spark, docs.limit(0), benchmark_dir)
    assert empty.count() == 0 and empty.columns == out.columns
    if name != "bpe":
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        assert 0 < len(rows) <= docs.count()
    else:
        assert len(rows) == docs.count()
    ids = collections.Counter(r.doc_id for r in rows)
    if name == "quality_rules":
        assert not {100, 101, 102, 103} & set(ids) and ids[1] == 1 and ids[2] == 3
    if name == "simhash_dedup":
        assert ids[2] == 1 and ids[104] == 0 and ids[None] == 2
    if name == "decontamination":
        assert ids[5] == 0 and ids[6] == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_whole_pipeline_equals_its_stages_decided_plainly(spark):
    """Each decision is taken again from the operators' own per-document answers, in Python, on what the one before kept."""
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema

    def frame():
        return spark.createDataFrame([tuple(d[f.name] for f in schema.fields) for d in docs], schema)
    good = {r.doc_id for r in quality.quality_rules(frame()).collect() if r.kept}
    docs = [d for d in docs if d["doc_id"] in good]
    text = {r.doc_id: r.text for r in line_dedup.dedup_passages(frame()).collect()}
    docs = [d | {"text": text[d["doc_id"]], "n_chars": None if text[d["doc_id"]] is None else len(text[d["doc_id"]])} for d in docs]
    prints = {r.doc_id: int(r.fingerprint, 16) for r in simhash.simhash_groups(frame()).collect()}
    group = {i: i for i in prints}
    order = sorted(prints)
    changed = True
    while changed:      # every pair compared
        changed = False
        for i in order:
            for j in order:
                if (prints[i] ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    docs = [d for d in docs if group[d["doc_id"]] == d["doc_id"]]
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    bad = {r.doc_id for r in decontaminate.contamination(frame(), items).collect() if r.contaminated}
    docs = [d for d in docs if d["doc_id"] not in bad]
    want = bpe.bpe_digests(frame(), bpe.read_vocabulary(corpus_pipeline.VOCABULARY)).collect()
    assert collections.Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == collections.Counter(map(tuple, want))
