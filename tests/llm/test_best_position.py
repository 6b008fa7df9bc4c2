"""Ranked search against plain scoring, and on awkward tables."""

import collections
import math
import random
import re

import numpy as np
import pytest

from rollcall.llm import best_position as bp

SCHEMA = "doc_id long, text string, item_id long, shard long, term string, score long, rank int"
ITEMS = "item_id long, text string, doc_id long, slice int"


def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _plain(docs, items, k):
    """Every document scored against every item as the definition says."""
    kept = [(i, collections.Counter(_terms(t))) for i, t in docs if _terms(t)]
    n, total = len(kept), sum(sum(c.values()) for _, c in kept)
    df = collections.Counter(t for _, c in kept for t in c)
    asked = collections.defaultdict(collections.Counter)
    for item, text in items:
        if item is not None:
            asked[item].update(_terms(text))
    out = []
    for item, q in asked.items():
        scored = []
        for doc_id, c in kept:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m))
                        for t, times in q.items() if t in c)
            if score > 0 and doc_id is not None:
                scored.append((-score, doc_id))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def _tables():
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdeé0") for _ in range(rnd.randint(1, 4))) for _ in range(80)]
    weights = [1 / (1 + i) for i in range(80)]

    def text(n):
        return " ".join(rnd.choices(vocabulary, weights, k=n))

    docs = [(i * 7 % 151, text(rnd.randint(0, 60))) for i in range(151)]
    docs += [(500 + i, docs[3][1]) for i in range(30)]        # copies: ties
    docs += [(600, None), (601, ""), (602, "\n ?!"), (603, (text(50) + ", ") * 400), (None, text(30)), docs[5], docs[5],
             (604, "X" * 5000), (605, "ABCÉ abcé")]
    items = [(i, text(rnd.randint(1, 25))) for i in range(20)]
    items += [(50, None), (51, ""), (52, "unknownword"), (None, text(9)), (3, items[3][1]), (53, docs[3][1]), (54, "É é A a")]
    return docs, items


@pytest.mark.parametrize("shard_bytes,slice_terms", [(1 << 20, 1 << 18), (2000, 40)])
def test_equals_plain_scoring(spark, monkeypatch, shard_bytes, slice_terms):
    docs, items = _tables()
    monkeypatch.setattr(bp, "SLICE_TERMS", slice_terms)
    d = spark.createDataFrame([(*r, 1, 2, "t", 3, 4) for r in docs], SCHEMA).repartition(3)
    q = spark.createDataFrame([(*r, 1, 2) for r in items], ITEMS)
    got = sorted(map(tuple, bp.search(d, q, k=7, shard_bytes=shard_bytes).collect()))
    assert got == _plain(docs, items, 7)


def test_whole_texts_are_counted_in_pieces(monkeypatch):
    text = "Aé-b9 c\n" * 50 + "x" * 100
    want = collections.Counter(t.encode() for t in _terms(text))
    for size in (1, 5, 1000):
        monkeypatch.setattr(bp, "PIECE", size)
        assert bp.term_counts(text) == want


def test_stops_before_the_end_of_the_lists_and_keeps_ties():
    rnd = np.random.default_rng(2)
    lists, n = [], 20_000
    for _ in range(4):
        docs = np.sort(rnd.choice(n, 15_000, replace=False)).astype(np.int32)
        lists.append(bp.ImpactList(docs, (1e6 * rnd.random(15_000) ** 8).astype(np.int64)))
    lists[0].impact[:60] = lists[0].impact.max()
    lists[0] = bp.ImpactList(lists[0].docs, lists[0].impact)
    score = np.zeros(n, np.int64)
    for x, f in zip(lists, (3, 1, 2, 1)):
        score[x.docs] += f * x.impact
    kth = np.sort(score)[-20]
    d, s, depth = bp.best_positions(lists, [3, 1, 2, 1], 20, 1, n)
    keep = s >= kth
    assert sorted(d[keep].tolist()) == np.flatnonzero(score >= kth).tolist()
    assert (score[d] == s).all() and depth < 15_000


def test_empty_tables(spark):
    d, q = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], ITEMS)
    docs = spark.createDataFrame([(1, "a b", 0, 0, "", 0, 0)], SCHEMA)
    items = spark.createDataFrame([(1, "a", 0, 0)], ITEMS)
    assert bp.search(d, items).count() == bp.search(docs, q).count() == bp.search(d, q).count() == 0
