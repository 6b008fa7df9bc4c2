"""Hard negatives against plain search, the curve, the bounds, and awkward tables."""

import math
import random

import numpy as np
import pytest

from rollcall.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, id long, anchor long, score double, dim string"


def _plain(rows, every, k):
    """Every anchor multiplied with every row."""
    used = {}
    for vec_id, v, label in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        used[vec_id, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = 1
    out = []
    for a, la, va in used:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v)), i, lab) for i, lab, v in used if i != a and len(v) == len(va)]
        for p, pid, _ in sorted(s for s in scored if s[2] == la)[:k]:
            near = sorted(s for s in scored if s[2] != la and -80 * p <= -100 * s[0] <= -100 * p)[:k]
            out += [(a, pid, r + 1, i, -p, -s) for r, (s, i, _) in enumerate(near)]
    return sorted(out)


def _rows(dim=6, n=700, spread=1.0, seed=1):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = [(i, [c + spread * rnd.gauss(0, 0.3) for c in centres[rnd.randrange(5)]], rnd.randrange(10) if i % 3 else 4) for i in range(n)]
    rows += [(n + i, rows[20][1], 5 + i % 3) for i in range(40)]      # ties
    return rows


AWKWARD = [(None, [1.0] * 6, 1), (2000, None, 1), (2100, [1.0] * 6, None), (2200, [None] + [1.0] * 5, 1), (2300, [float("nan")] * 6, 1),
           (2400, [float("inf")] * 6, 2), (2500, [], 3), (2501, [], 4), (2502, [], 3), (2600, [1.0, 2.0], 3), (2601, [1.5, 2.5], 3), (2602, [1.4, 2.5], 2),
           (2700, [0.0] * 6, 6), (2701, [0.0] * 6, 6)]


@pytest.mark.parametrize("spread,block,chunk", [(1.0, 512, 4096), (0.05, 16, 3)])
def test_equals_plain_search(spark, monkeypatch, spread, block, chunk):
    monkeypatch.setattr(hn, "BLOCK_ROWS", block)
    monkeypatch.setattr(hn, "CHUNK", chunk)
    monkeypatch.setattr(hn, "ANCHORS", 20 if chunk == 3 else 1 << 18)
    monkeypatch.setattr(hn, "ZONES", 3 if chunk == 3 else 4096)
    rows = _rows(spread=spread) + AWKWARD
    rows += rows[98:101] + rows[98:101]                       # repeated rows, an anchor among them
    frame = spark.createDataFrame([(*r, 1, 2, 0.5, "d") for r in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, hn.hard_negatives(frame, anchors_every=20).collect()))
    assert got == _plain(rows, 20, hn.K) and len(got) > 500


def test_large_components(spark):
    rows = [(i, [float(3 ** (i % 13)), -float(2 ** (i % 20)), 1.0], i % 3) for i in range(120)] + [(200, [3e38, 1.0, 1.0], 1)]
    frame = spark.createDataFrame([(*r, 1, 2, 0.5, "d") for r in rows[:-1] if r[0] % 40 < 20], SCHEMA)
    got = sorted(map(tuple, hn.hard_negatives(frame, anchors_every=10).collect()))
    assert got == _plain([r for r in rows[:-1] if r[0] % 40 < 20], 10, hn.K)
    assert hn.hard_negatives(spark.createDataFrame([(*r, 1, 2, 0.5, "d") for r in rows], SCHEMA)).count() >= 0


def test_empty_table(spark):
    assert hn.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0


def test_curve_visits_neighbouring_cells():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")).reshape(dims, -1).T
        key = hn.hilbert_key(cells, bits)
        path = cells[np.argsort(key)]
        assert sorted(key.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_blocks_are_skipped():
    rnd = np.random.default_rng(4)
    centres = rnd.normal(0, 200, (8, 5))
    rows = [np.floor(c + rnd.normal(0, 5, (64, 5))).astype(np.int64) for c in centres]
    q = np.floor(centres[:3]).astype(np.int64)
    lo, hi = np.array([r.min(axis=0) for r in rows]), np.array([r.max(axis=0) for r in rows])
    least, largest = hn.bounds(q, lo, hi)
    for b, r in enumerate(rows):
        s = hn.products(q, r)
        assert (s.min(axis=1) >= least[:, b]).all() and (s.max(axis=1) <= largest[:, b]).all()
    unpacked = []
    blocks = [{"ids": np.arange(64 * b, 64 * b + 64).astype("<i8").tobytes(), "vectors": _Counted(hn.pack(r), unpacked)} for b, r in enumerate(rows)]
    asked = hn.Asked.__new__(hn.Asked)
    asked.dim, asked.q, asked.anchor, asked.ids = 5, q, np.arange(3), np.full(3, -1)
    asked.low, asked.high = np.full((3, 1), hn._LEAST), np.full((3, 1), hn._MOST)
    a, _, i, s = hn._search(asked, blocks, [lo, hi], True)
    every = hn.products(q, np.concatenate(rows))
    for k in range(3):
        order = np.lexsort((np.arange(512), -every[k]))[:hn.K]
        assert i[a == k].tolist() == order.tolist() and s[a == k].tolist() == every[k][order].tolist()
    assert len(unpacked) < len(rows)


class _Counted(bytes):
    """Bytes that note when they are measured, which unpack() does first."""

    def __new__(cls, data, log):
        out = super().__new__(cls, data)
        out.log = log
        return out

    def __len__(self):
        self.log.append(1)
        return super().__len__()
