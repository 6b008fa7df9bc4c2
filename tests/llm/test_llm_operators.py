"""Each operator against a brute-force version, and on awkward tables."""

import collections
import hashlib

import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rollcall.llm import (bpe, debruijn, decontaminate, elias_fano, html_density, licenses, line_dedup, linkgraph,
                          ngram_lm, quality, simhash, words)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, at int, __id long, words string"
VOCABULARY = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def _texts():
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(60)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(40))
    block = "\n".join(" ".join(rnd.choice(vocabulary) for _ in range(8)) for _ in range(12))
    out = []
    for i in range(40):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 90))]
        if i % 4 == 0:
            w[len(w) // 2:len(w) // 2] = passage.split()
        text = " ".join(w).replace(" " + vocabulary[0] + " ", "\n")
        out.append(text + "\n" + block if i % 5 == 0 else text)
    return out + out[:3] + [None, "", "   \n\t ", "A B c", "x " * 5000, "Word", passage.upper()]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 % 53, t, "en" if i % 3 else None, f"s{i % 2}" if i % 7 else None, 7, "r", 1, 2, "w")
            for i, t in enumerate(_texts())]
    rows += [rows[4], rows[4], (None, "no id here " * 20, None, None, None, None, None, None, None), (None, None, None, None, 1, "", 0, 0, "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _low(text))


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _bag(rows):
    return collections.Counter(map(tuple, rows))


def test_word_hashes_follow_all_bytes():
    w = words.hashed(["abcdefghijk1 abcdefghijk2", None, "", "abcdefghijk1"], words.SPACED)
    assert w.first.tolist() == [0, 2, 2, 2, 3]
    assert w.hashes[0] == w.hashes[2] != w.hashes[1]


def test_quality(docs, empty):
    got = {}
    for r in quality.quality_rules(docs, min_group=5).collect():
        got.setdefault(r.doc_id, []).append(r)
    for d in docs.collect():
        w, text = _words(d.text), d.text or ""
        lines = [x for x in text.split("\n") if _words(x)]
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {k + j for k in range(len(w) - 2) if tri[tuple(w[k:k + 3])] > 1 for j in range(3)}
        want = (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit),
                len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert want in [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got[d.doc_id]]
    assert not any(r.kept and r.base_failed for rs in got.values() for r in rs)
    assert quality.quality_rules(empty).count() == 0
    kept = [r for rs in got.values() for r in rs if r.kept]
    assert quality.good_documents(docs, min_group=5).count() == len(kept)


def test_sketch_buckets_are_ordered_and_close(spark):
    df = spark.range(0, 5000).withColumn("b", quality.bucket(F.col("id")))
    rows = df.withColumn("low", quality.bucket_low(df.b)).orderBy("id").collect()
    assert all(r.low <= r.id <= r.low * 17 / 16 + 1 for r in rows)
    assert [r.b for r in rows] == sorted(r.b for r in rows)


def test_outlier_is_rejected_and_others_stay(spark):
    rnd = random.Random(1)
    text = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(80)) for _ in range(60)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(text)] + [(99, "### " .join(text[0].split()), "en", "s", 0)]
    out = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert [r.doc_id for r in out if not r.kept] == [99]


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, _texts()[4]), (2, "word"), (3, None), (4, _texts()[0][:300]), (5, "a b"), (2, "word")],
                                  "item_id long, text string")
    windows = {}
    for i in items.collect():
        w = _alnum(i.text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(i.item_id)
    want = []
    for d in docs.collect():
        w, hit, found = _alnum(d.text), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                ids = windows.get(tuple(w[k:k + n]))
                if ids:
                    hit |= set(range(k, k + n))
                    found |= ids
        want.append((d.doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    out = decontaminate.contamination(docs, items)
    assert _bag(r[:6] for r in out.collect()) == _bag(want)
    assert decontaminate.clean_documents(docs, items).count() == sum(not r[5] for r in want)
    assert decontaminate.contamination(empty, items).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, items.limit(0)).collect())


def _fingerprint(text):
    w = _low(text).encode().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(docs, empty):
    rows = docs.collect()
    prints = [_fingerprint(r.text) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    want = [(r.doc_id, f"{prints[i]:016x}", least.get(find(i))) for i, r in enumerate(rows)]
    assert _bag(simhash.simhash_groups(docs).collect()) == _bag(want)
    assert simhash.simhash_groups(empty).count() == 0
    kept = simhash.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(
        {r.doc_id for i, r in enumerate(rows) if r.doc_id is not None and least[find(i)] == r.doc_id})


@pytest.mark.parametrize("size", [10, 3000])
def test_forest_connects_what_is_near(size):
    values = np.unique(np.random.default_rng(size).integers(0, 1 << 16, size).astype(np.uint64))
    a, b = simhash._forest(values, 2)
    got = {int(v): int(v) for v in values}
    got |= dict(zip(a.tolist(), b.tolist()))
    for v in values.tolist()[:200]:
        for w in values.tolist():
            if (v ^ w).bit_count() <= 2:
                assert got[v] == got[w]


def test_url_rules_and_propagation(spark):
    page = '<a href="http://bad.net/x">x</a><a href=//Good.Example.net/>y</a>'
    rows = [(1, "http://bad.net/a", ""), (2, "https://LINKER.info/a?x#y", page.replace("//Good", "//bad.net/?Good") * 3),
            (3, "http://m.example.net/en/1", None), (4, "http://x.org/fr/", ""), (5, "http://x.org/de/", ""), (6, None, None),
            (7, "no scheme", ""), (8, "http://notexample.com/de/", ""), (9, "http://a.example.com/de/q", ""), (9, "http://a.example.com/de/q", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = linkgraph.url_verdicts(df, threshold=0.4).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}
    assert len(out) == 10
    assert got == {1: ("bad.net", "/a", "net/", "block"), 2: ("linker.info", "/a", None, "block"),
                   3: ("m.example.net", "/en/1", "example.net/en/", "allow"), 4: ("x.org", "/fr/", "org/fr/", "allow"),
                   5: ("x.org", "/de/", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
                   8: ("notexample.com", "/de/", None, "allow"), 9: ("a.example.com", "/de/q", "example.com/de/", "block")}
    assert linkgraph.url_verdicts(df.limit(0)).count() == 0


def test_propagation_matches_dense_iteration(spark):
    rnd = np.random.default_rng(3)
    n, edges = 12, {(int(a), int(b)): int(w) for a, b, w in rnd.integers(0, 12, (40, 3)) if a != b and w}
    seeds = rnd.random((n, 2)).round(2)
    m = np.zeros((n, n))
    for (a, b), w in edges.items():
        m[a, b] = w

    def rank(m, s):
        share = m / np.maximum(m.sum(1, keepdims=True), 1)
        r = (1 - 0.85) * s
        for _ in range(300):
            r = (1 - 0.85) * s + 0.85 * share.T @ r
        return r
    out = linkgraph.propagate(spark.createDataFrame([(f"h{i}", float(a), float(b)) for i, (a, b) in enumerate(seeds)], "host string, trust double, distrust double"),
                              spark.createDataFrame([(f"h{a}", f"h{b}", w) for (a, b), w in edges.items()], "src string, dst string, weight long"), tolerance=1e-4)
    got = {r.host: (r.trust, r.distrust) for r in out.collect()}
    for i, (t, d) in enumerate(zip(rank(m, seeds[:, 0]), rank(m.T, seeds[:, 1]))):
        assert got[f"h{i}"] == pytest.approx((t, d), abs=2e-3)


def test_language_model(docs, empty):
    rows = docs.collect()
    tok = [[w.encode() for w in _words(_low(r.text))] + [None] for r in rows]
    train = [zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 != 1 for r in rows]
    c, p = collections.Counter(), collections.Counter()
    for w, t in zip(tok, train):
        if t:
            c.update(w)
            p.update(zip([0, *w[:-1]], w))
    n, v = sum(c.values()), len(c)
    total, kinds = collections.Counter(), collections.Counter()
    for (a, _), k in p.items():
        total[a] += k
        kinds[a] += 1

    def model(a, b):
        uni = (max(c[b] - 0.75, 0) + 0.75 * v / (v + 1)) / n
        return (max(p[a, b] - 0.75, 0) + 0.75 * kinds[a] * uni) / total[a] if total[a] else uni
    want = collections.defaultdict(list)
    for r, w, t in zip(rows, tok, train):
        want[r.doc_id].append((not t, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + .5) / (n + .5 * (v + 1))) for x in w),
                               sum(math.log10(model(a, b)) for a, b in zip([0, *w[:-1]], w))))
    out = ngram_lm.score_documents(docs, chunk_bytes=3000).collect()
    assert len(out) == len(rows)
    for r in out:
        assert any(tuple(r[1:5]) == x[:4] and r.base_score == pytest.approx(x[4], rel=1e-9) and abs(r.score - x[5]) <= 2e-4 * x[1]
                   for x in want[r.doc_id])
    assert ngram_lm.score_documents(empty).count() == 0


def test_elias_fano():
    rnd = np.random.default_rng(0)
    for top, n in ((10, 50), (1 << 40, 1000), (5000, 4000), (3, 1), (0, 5)):
        x = np.sort(rnd.integers(0, top + 1, n).astype(np.uint64))
        ef = elias_fano.EliasFano(x)
        assert np.array_equal(ef[np.arange(n)], x)
        q = rnd.integers(0, top + 2, 200).astype(np.uint64)
        assert np.array_equal(ef.successor(q, np.zeros(200, np.int64), np.full(200, n)), np.searchsorted(x, q))


def test_line_dedup(docs, empty, spark):
    def chunks(text):
        lines = text.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        cuts = sorted({i + 1 for i in range(1, len(lines)) if (h[i - 1] * 31 + h[i]) % 3 == 0} | {len(lines)})
        return ["\n".join(lines[a:b]) for a, b in zip([0, *cuts], cuts)]

    def multi(c):
        return sum(x.strip(" ") != "" for x in c.split("\n")) > 1
    rows = docs.collect()
    seen, first = collections.Counter(), {}
    for r in rows:
        for ch in chunks(r.text or ""):
            if multi(ch):
                seen[ch] += 1
                if r.doc_id is not None:
                    first[ch] = min(first.get(ch, r.doc_id), r.doc_id)
    want = []
    for r in rows:
        kept, here = [], set()
        for ch in chunks(r.text or ""):
            if not (multi(ch) and seen[ch] > 1 and (ch in here or r.doc_id is None or first[ch] != r.doc_id)):
                kept.append(ch)
            if multi(ch):
                here.add(ch)
        want.append((r.doc_id, None if r.text is None else "\n".join(kept)))
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "__n_lines", "__n_removed"]
    assert _bag((r.doc_id, r.text) for r in out.collect()) == _bag(want)
    assert sum(r["__n_removed"] for r in out.collect()) > 0
    assert line_dedup.dedup_lines(empty).count() == 0


def test_license_scan(docs, empty, spark):
    texts = ["Released under teh MIT license!", "All rights reserved. ALL RIGHTS RESERVED", "cc by cc by-nc", None, "",
             "licensed under the apache licence, version 2.0 x", "the mit of the under", "x " * 9000 + "all rights reservd"]
    out = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: r for r in out}
    for i, t in enumerate(texts):
        w = _alnum(t)
        places = [(k, lab) for ph, lab in licenses.PHRASES.items() for k in range(len(w)) if w[k:k + len(ph.split())] == ph.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            len(w), len(places), min(places, default=(None,))[0], max(places, default=(None,))[0], ",".join(sorted({x for _, x in places})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert [got[i].labels for i in range(8)] == ["mit", "reserved", "cc-by", "", "", "apache-2.0", "", "reserved"]
    assert got[0].spans[0].first_word == 0 and got[0].spans[0].edits == 2
    assert licenses.license_scan(docs).count() == docs.count() and licenses.license_scan(empty).count() == 0


def test_seeds_lose_no_match():
    scanner = licenses.Scanner(licenses.NOTICES, licenses.ERROR_SHARE)
    rnd = random.Random(2)
    for _ in range(150):
        label, notice = rnd.choice(licenses.NOTICES)
        k = max(1, int(licenses.ERROR_SHARE * len(notice)))
        x = list(notice)
        for _ in range(rnd.randint(0, k)):
            at = rnd.randrange(1, len(x) - 1)
            x[at:at + rnd.randint(0, 1)] = rnd.choice(["", "q", "zz"[:1]])
        text = "ab cd " + "".join(x) + " ef gh"
        whole = regex.search(r"(?<!\S)(?:%s){e<=%d}(?!\S)" % (regex.escape(notice, literal_spaces=True), k), text, regex.BESTMATCH)
        assert bool(whole) <= any(True for _ in scanner.find(text))


PAGES = [
    ("<html><body><nav><a href=/>Home</a></nav><div class='ad'>Buy</div><article><h1>Title &amp; more</h1><p>One <b>two<br>three."
     "<p>Four&nbsp;five   six.</article><div class='comments'><p>Nice post, really nice post!</p></div><footer>&copy; x</footer>",
     "Title & more One two three. Four five six."),
    ("<body><header><h1>Site</h1></header><main><header><h1>Head</h1></header><p>Some long text here that matters a lot.</p>"
     "<aside>Related things</aside><ul><li>first<li>second</ul><form><input><button>Go</button></form></main><script>if(a</b)x</script>",
     "Head Some long text here that matters a lot. first second"),
    ("<div id=cookie-notice>We use cookies</div><div><p>Only paragraph of the page.</p></div>", "Only paragraph of the page."),
    ("<title>x</title><body></body>", ""), ("", ""), (None, ""), ("<!-- c --><p>a<!-- <p>no</p> -->b</p>", "ab"),
    ("plain text only", "plain text only"), ("<p>" + "word " * 30000 + "</p><p>end</p>", " ".join(["word"] * 30000) + " end"),
]


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_main_text(k):
    assert html_density.extract(PAGES[k][0]) == PAGES[k][1]


def test_main_text_table(spark):
    df = spark.createDataFrame([(i, None, p, "clash") for i, (p, _) in enumerate(PAGES)] * 2, "page_id long, url string, html string, text string")
    out = html_density.main_text(df).collect()
    assert _bag((r.page_id, r.text, r.n_chars) for r in out) == _bag([(i, t, len(t)) for i, (_, t) in enumerate(PAGES)] * 2)
    assert html_density.main_text(df.limit(0)).count() == 0


ODD = ["a  b   c \n d\n  e\t f \x1c g  ", "x  y  z \x85 q", " lead", "trail ", "<|endoftext|>a<|endoftext|>", "a" * 3000,
       " " * 2500 + "x", "=-" * 900, "é" * 700, "日本語テキスト" * 50, "\x00\x01" * 50, "don't we'll I'd", "a " * 70000 + "b\n " * 3000, "", "-" * 1000]


def test_bpe_equals_the_library(spark, docs, empty):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(4)
    texts = ODD + ["".join(chr(rnd.choice([rnd.randint(1, 300), rnd.randint(0x400, 0xD7FF), rnd.randint(0x10000, 0x1FFFF)])) for _ in range(200)) for _ in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "doc_id long, text string")
    encoded = bpe.bpe_encode(df, VOCABULARY)
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in encoded.collect()}
    back = {r.doc_id: r.text for r in bpe.bpe_decode(encoded, VOCABULARY).collect()}
    digests = {r.doc_id: r for r in bpe.bpe_digests(df, VOCABULARY).collect()}
    for i, t in [*enumerate(texts), (-1, "")]:
        want = library.encode(t, add_special_tokens=False).ids
        text = library.decode(want, skip_special_tokens=False)
        assert ids[i] == want and back[i] == text == t
        assert digests[i][1:] == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.bpe_digests(docs, VOCABULARY).count() == docs.count() and bpe.bpe_digests(empty, VOCABULARY).count() == 0


def test_bpe_lookahead_and_compatibility():
    codec = bpe.Codec(VOCABULARY)
    assert codec.lookahead == max(len(a) + len(b) for a, b in codec.ranks)
    rnd, tokens = random.Random(7), list(codec.whole)
    for _ in range(1500):
        a, b = rnd.choice(tokens), rnd.choice(tokens)
        assert codec.compatible(a, b) == (codec.merge(a + b) == [a, b])
    raw = bytes(rnd.choice(b"aehinrst") for _ in range(1500))
    want = [codec.ids[t] for t in codec.merge(raw)]
    for step in (1, 7, 1500):
        assert list(codec.transduce(raw[i:i + step] for i in range(0, len(raw), step))) == want
    assert list(codec.decode([codec.ids[b"\xc3"], codec.ids[b"a"]])) and "".join(codec.decode([codec.ids[b"\xc3"], codec.ids[b"a"]])) == "�a"


def test_substring_dedup(docs, empty):
    rows = docs.collect()
    first = {}
    for r in rows:
        w = _words(r.text)
        for k in range(len(w) - 12):
            if r.doc_id is not None:
                g = tuple(w[k:k + 13])
                first[g] = min(first.get(g, r.doc_id), r.doc_id)
    want = []
    for r in rows:
        w = _words(r.text)
        gone = {k + j for k in range(len(w) - 12) if r.doc_id is not None and first[tuple(w[k:k + 13])] < r.doc_id for j in range(13)}
        want.append((r.doc_id, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    for size in (2000, 1 << 22):
        assert _bag(debruijn.substring_dedup(docs, chunk_bytes=size).collect()) == _bag(want)
    assert debruijn.substring_dedup(empty).count() == 0


def test_wrong_edges_are_found():
    import pyarrow as pa
    chunk = debruijn.Chunk(pa.table({"doc_id": [1], "text": [" ".join(f"w{i}" for i in range(40))]}), 13, 256)
    good = " ".join(f"w{i}" for i in range(5, 30)).encode()
    bad = " ".join(f"w{i}" for i in [*range(5, 18), 3, *range(18, 25)]).encode()
    wrong = chunk.wrong_edges([good, bad])
    assert set(wrong) == {1} and len(wrong[1]) == 8



def test_bpe_every_piece_of_several_tokens_goes_through_the_transducer(monkeypatch):
    codec = bpe.Codec(VOCABULARY)
    reference = Tokenizer.from_str(VOCABULARY)
    reference.no_truncation()
    reference.no_padding()
    calls = []
    real = codec.transduce
    monkeypatch.setattr(codec, "transduce", lambda data: calls.append(1) or real(data))
    texts = [t for t in _texts() if t] + ["qzxv" * 3000, "é漢" * 500 + "zq", "a" * 1000, "\n" * 300 + "=" * 777, "0" * 129 + "-" * 200]
    for text in texts:
        want = reference.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(codec.encode(text)), "<u4").tolist() == want
    assert len(calls) > len(texts)


def test_bpe_memory_of_a_long_piece_is_bounded():
    codec = bpe.Codec(VOCABULARY)
    rnd = random.Random(3)
    raw = bytes(rnd.choice(b"abcdefgz") for _ in range(200_000))
    held, done = [], 0
    step = 2 * codec.lookahead
    fed = 0

    def blocks():
        nonlocal fed
        for i in range(0, len(raw), step):
            fed = i + step
            yield raw[i:i + step]

    for token in codec.transduce(blocks()):
        done += codec.sizes[token]
        held.append(fed - done)
    assert done == len(raw) and max(held) < 8 * codec.lookahead
