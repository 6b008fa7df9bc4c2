"""The whole url query against a dense solution of the two PageRanks."""

import collections
import random

import numpy as np
import pytest

from rollcall.llm import linkgraph

PAGES = "page_id long, url string, html string, host string, trust double, src string"


def _parents(host):
    labels = host.split(".")
    chain = [".".join(labels[i:]) for i in range(len(labels))]
    return [(a, b) for a, b in zip(chain, chain[1:]) if "." in b and b != "co.uk"]


def _dense(pages, rules):
    """(trust, distrust) per host by solving the linear systems; pages are (host, [linked host])."""
    verdict = {h: v for h, _, v in rules}
    crawled = collections.defaultdict(list)
    weight = collections.Counter()
    linked = set()
    for host, out in pages:
        crawled[host].append(verdict.get(host))
        for to in out:
            if to != host:
                weight[host, to] += 1
                linked.add(to)
    nodes = set(crawled) | linked
    for h in list(nodes):
        for a, b in _parents(h):
            weight[a, b] = max(weight[a, b], 0)
            nodes |= {a, b}
    up = {e for h in nodes for e in _parents(h)}
    for a, b in up:
        weight[a, b] += 1
        weight[b, a] += 1
    names = sorted(nodes)
    at = {h: i for i, h in enumerate(names)}
    m = np.zeros((len(names),) * 2)
    for (a, b), w in weight.items():
        m[at[a], at[b]] = w
    seeds = np.zeros((3, len(names)))
    for h in names:
        of = crawled.get(h) or ([verdict.get(h)] if h in linked else [])
        if of:
            seeds[:, at[h]] = of.count("allow") / len(of), of.count("block") / len(of), 1.0

    def rank(m, s):
        share = m / np.maximum(m.sum(1, keepdims=True), 1e-300)
        return np.linalg.solve(np.eye(len(m)) - 0.85 * share.T, 0.15 * s) - 0.15 * s      # what comes in

    out = {}
    for k, way in ((0, m), (1, m.T)):
        got, of = rank(way, seeds[k]), rank(way, seeds[2])
        out[k] = np.maximum(seeds[k], np.where(of > 1e-12, 0.85 * got / np.maximum(of, 1e-300), 0))
    return {h: (out[0][i], out[1][i]) for h, i in at.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_query_matches_dense_pagerank(spark, seed):
    rnd = random.Random(seed)
    hosts = [f"h{i}.info" for i in range(12)] + [f"s{i}.shop.info" for i in range(4)] + ["a.co.uk", "b.co.uk", "deep.x.y.net"]
    rules = [(h, "/", rnd.choice(["allow", "block"])) for h in rnd.sample(hosts, 7)]
    pages = [(rnd.choice(hosts[:-1]), [rnd.choice(hosts + ["dark.org", "far.org"]) for _ in range(rnd.randint(0, 4))]) for _ in range(60)]
    rows = [(i, f"http://{h}/p", "".join(f"<a href='https://{x}/'>l</a>" for x in out), "h", 1.0, "s") for i, (h, out) in enumerate(pages)]
    rows += [(900, None, None, None, None, None), (901, "http://", "<a href=//x>", "", 0.0, "")]
    got = linkgraph.url_verdicts(spark.createDataFrame(rows, PAGES), rules).collect()
    want = _dense(pages, rules)
    assert len(got) == len(rows)
    ruled = {h: v for h, _, v in rules}
    for r in got:
        if r.host:
            t, d = want[r.host]
            assert (r.trust, r.distrust) == pytest.approx((t, d), abs=0.01), r
            if abs(d - t - linkgraph.THRESHOLD) > 0.02:
                assert r.verdict == ruled.get(r.host, "block" if d - t >= linkgraph.THRESHOLD else "allow")


def test_owners_below_a_public_domain_do_not_judge_each_other(spark):
    rules = [("one.co.uk", "/", "block"), ("two.co.uk", "/", "block"), ("x.github.io", "/", "block"), ("w.github.io", "/", "block")]
    rows = [(i, f"http://{h}/", "") for i, h in enumerate(["one.co.uk", "two.co.uk", "three.co.uk", "x.github.io", "w.github.io", "y.github.io"])]
    df = spark.createDataFrame([(*r, "", 0.0, "") for r in rows], PAGES)
    got = {r.page_id: r.verdict for r in linkgraph.url_verdicts(df, rules).collect()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "block", 4: "block", 5: "allow"}


def test_ties_at_the_threshold_block(spark):
    page = "<a href='http://bad.net/'>x</a>"
    df = spark.createDataFrame([(1, "http://bad.net/", "", "", 0.0, ""), (2, "http://linker.info/", page, "", 0.0, "")], PAGES)
    rules = [("bad.net", "/", "block")]
    score = {r.page_id: r.distrust - r.trust for r in linkgraph.url_verdicts(df, rules).collect()}
    for threshold, verdict in ((score[2], "block"), (np.nextafter(score[2], 2), "allow")):
        got = {r.page_id: r.verdict for r in linkgraph.url_verdicts(df, rules, threshold=float(threshold)).collect()}
        assert got == {1: "block", 2: verdict}
