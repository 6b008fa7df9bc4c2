"""Language identification against a plain version, and on awkward tables."""

import collections
import math
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.llm import language_mixture as lm

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, held_out int, lang_pred string, __id long"


def _buckets(text):
    """Counts of hashed byte trigrams, written down plainly."""
    flat = re.sub(rb"[^a-z\x80-\xff]+", b" ", text.lower().encode()).strip()
    raw = b" " + flat + b" "
    n = collections.Counter()
    for i in range(len(raw) - 2):
        code = raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]
        n[(code * 2654435769 % (1 << 32)) >> 17] += 1
    return n


def _docs(spark):
    en = "the house and the garden with the old tree are there then "
    fr = "la maison et le jardin avec un vieil arbre sont là où été "
    rows = []
    for i in range(60):
        lang, text = ("en", en) if i % 2 else ("fr", fr)
        rows.append((i, text * (1 + i % 4) + str(i), lang if i % 7 else None, "s", 1, "x", 2))
    rows += [(100, None, "en", None, None, None, None), (101, "", None, "", 0, "", 0), (102, " 12 34 ! ", "en", "", 0, "", 0),
             (103, en * 30 + fr * 30, None, "", 0, "", 0), (104, en * 3000, None, "", 0, "", 0), (None, fr, None, "", 0, "", 0),
             (1, en, "en", "", 0, "", 0), (1, en, "en", "", 0, "", 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_equals_plain_version(spark):
    docs = _docs(spark)
    rows = docs.collect()
    train = collections.defaultdict(collections.Counter)
    for r in rows:
        if r.lang and r.text and zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 and re.search("[a-z]", r.text):
            train[r.lang] += _buckets(r.text)
    names = sorted(train)
    p = {k: {} for k in names}
    for k in names:
        total = sum(train[k].values()) + lm.SMOOTHING * lm.BUCKETS
        p[k] = lambda b, k=k, total=total: (train[k][b] + lm.SMOOTHING) / total
    got = sorted(map(tuple, lm.identify_languages(docs).select("doc_id", "held_out", "lang_pred", "score").collect()), key=str)
    want = []
    for r in rows:
        out = zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0
        if not r.text or not re.search("[a-z]", r.text):
            want.append((r.doc_id, out, "und", 0.0))
            continue
        n = {b: c / lm.GRAM for b, c in _buckets(r.text).items()}
        total = sum(n.values())
        alone = {k: sum(c * math.log(p[k](b)) for b, c in n.items()) for k in names}
        first = max(names, key=lambda k: alone[k])
        share = 0.5     # of the first, two languages at most here
        for _ in range(5000):
            other = [k for k in names if k != first][0]
            share = sum(c * share * p[first](b) / (share * p[first](b) + (1 - share) * p[other](b)) for b, c in n.items()) / total
            if r.doc_id != 103:
                break
        both = sum(c * math.log(share * p[first](b) + (1 - share) * p[other](b)) for b, c in n.items())
        mixed = r.doc_id == 103 and both > alone[first] + lm.PENALTY * 0.5 * math.log(total)
        largest = (share, first) if share >= 0.5 else (1 - share, other)
        want.append((r.doc_id, out, *(largest[::-1] if mixed else (first, 1.0))))
    want.sort(key=str)
    assert [w[:3] for w in got] == [w[:3] for w in want]
    assert [w[3] for w in got] == pytest.approx([w[3] for w in want], abs=0.01)
    assert 0.3 < {w[0]: w[3] for w in got}[103] < 0.7


def test_pieces_change_no_count(monkeypatch):
    text = "Été, the old house; và 12 – trees…  and   MORE\n\n" * 40 + "end"
    whole = lm.gram_counts(text)
    assert dict(zip(np.flatnonzero(whole).tolist(), whole[whole > 0].tolist())) == dict(_buckets(text))
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(lm, "PIECE", size)
        assert (lm.gram_counts(text) == whole).all()


def test_three_languages_are_told_apart():
    rnd = np.random.default_rng(3)
    p = rnd.dirichlet(np.full(400, 0.05), size=6) + 1e-6
    p /= p.sum(axis=1, keepdims=True)
    for chosen, share in (([2], [1.0]), ([0, 4], [0.7, 0.3]), ([1, 3, 5], [0.5, 0.3, 0.2])):
        n = rnd.multinomial(3000, np.array(share) @ p[chosen])
        found, got = lm.infer(p, n.astype(float))
        assert sorted(found) == chosen
        assert dict(zip(found, got)) == pytest.approx(dict(zip(chosen, share)), abs=0.05)


def test_labels_of_held_out_documents_are_never_read(spark):
    docs = _docs(spark)
    changed = docs.withColumn("lang", F.when(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0, F.lit("xx"))
                              .otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    key = ["doc_id", "held_out", "lang_pred", "score"]
    assert sorted(map(str, lm.identify_languages(changed).select(key).collect())) == sorted(
        map(str, lm.identify_languages(docs).select(key).collect()))


def test_empty_and_unlabelled_tables(spark):
    assert lm.identify_languages(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = lm.identify_languages(_docs(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(rows) == 68 and {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = lm.identify_languages(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, n = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("long")), F.count("lang")).first()
    assert n > 100 and right / n > 0.98
