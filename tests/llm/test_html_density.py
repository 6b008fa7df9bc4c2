"""Main text: split articles, marks, broken pages, and the densities against a plain computation."""

import math
import os
import random
import re
import time

import pytest

from rollcall.llm import html_density as h

SF = "/root/testdata/sf0.01"


def _pages(spark):
    return [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]


def _split(page, n, tag, around):
    m = re.search(r"<article>(.*?)</article>", page, re.S)
    paragraphs = re.split(r"(?<=</p>)(?=<)", m[1])
    size = max(1, -(-len(paragraphs) // n))
    inner = "".join(f"<{tag}>{''.join(paragraphs[i:i + size])}</{tag}>" for i in range(0, len(paragraphs), size))
    return page[:m.start()] + (f"<{around}>{inner}</{around}>" if around else inner) + page[m.end():]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("tag,around", [("div", ""), ("section", "div"), ("div", "main"), ("section", "")])
def test_an_article_in_several_containers_stays_whole(spark, tag, around):
    pages = _pages(spark)
    assert len(pages) == 250
    for n in (1, 2, 3, 4):
        assert [h.extract(_split(p, n, tag, around)) for p in pages] == [h.extract(p) for p in pages]


def test_containers_of_other_kinds_are_not_joined():
    text = "<p>The main text goes on and on here.</p>" * 6
    page = f"<body><div>{text}</div><div><a href=x>one link</a> <a href=y>two links</a></div><section>{text}</section><div>Imprint</div><div>{text}</div></body>"
    want = " ".join(["The main text goes on and on here."] * 12)
    assert h.extract(page) == want


CLASSES = ["comment-list", "user-comments", "reader-comments", "comments-area", "related-posts", "share-buttons", "cookie-bar", "ad-slot",
           "side-bar", "site-footer", "commentList", "post-comments", "ads", "newsletter-box", "social_links", "x comments y"]


@pytest.mark.parametrize("name", CLASSES)
@pytest.mark.parametrize("around", ["<article>%s</article>", "<div>%s</div>", "<main><div>%s</div></main>"])
def test_marked_nodes_inside_the_article_are_left_out(name, around):
    inner = "<p>%s</p><p>%s</p><div class='%s'><p>%s</p></div>" % ("Main text here. " * 10, "More main text. " * 8, name, "A long reader comment. " * 20)
    assert "reader" not in h.extract("<body>" + around % inner + "</body>")


@pytest.mark.parametrize("name", ["has-sidebar", "with-comments", "search-results", "no-ads-page", "loadable", "headers", "navy", "padding"])
def test_words_that_only_look_like_marks_change_nothing(name):
    inner = "<p>%s</p><div class='%s'><p>%s</p></div>" % ("Main text here. " * 10, name, "A second part. " * 8)
    assert "second part" in h.extract(f"<body><article>{inner}</article></body>")


BROKEN = {"quotes": '<a href="x>' * 90_000, "both quotes": "<a '\"" * 200_000, "quoted ends": '<a ">" ' * 140_000, "no ends": "<a " * 330_000,
          "angles": "<" * 1_000_000, "stray ends": "<i>" * 100_000 + "</x>" * 150_000, "comments": "<!-- x " * 140_000, "script": "<script>" + "<a b='" * 160_000}


@pytest.mark.parametrize("kind", BROKEN)
def test_a_megabyte_of_broken_tags_takes_linear_time(kind):
    page = BROKEN[kind]
    assert len(page) > 600_000
    began = time.process_time()
    h.extract(page)
    assert time.process_time() - began < 3       # about half a second; quadratic scans would take minutes


def test_tags_end_outside_quotes():
    assert h.extract("<body><article><p title='a > b'>One.</p><p title=\"it's\">Two.</p><p title=it's>Three.</p></article></body>") == "One. Two. Three."
    assert h.extract("<body><p>1 < 2 and 3 > 2</p></body>") == "1 < 2 and 3 > 2"


def _random_tree(rnd, depth=0):
    node = h.Node(rnd.choice(["div", "p", "section", "a", "b", "li"]), False)
    for _ in range(rnd.randint(0, 4)):
        node.parts.append("x" * rnd.randint(1, 60) if depth > 3 or rnd.random() < 0.5 else _random_tree(rnd, depth + 1))
    return node


def test_densities_equal_a_plain_computation():
    def kids(n):
        return [p for p in n.parts if isinstance(p, h.Node)]

    def below(n):
        return [m for k in kids(n) for m in [k, *below(k)]]

    def chars(n):
        return sum(len(p) if isinstance(p, str) else chars(p) for p in n.parts)

    def link_chars(n):
        return chars(n) if n.tag == "a" else sum(link_chars(k) for k in kids(n))

    def density(n, ratio):
        c, t = chars(n), max(1, sum(m.tag in h.BLOCKS or m.tag == "a" for m in below(n)))
        lc, lt = link_chars(n), max(1, sum(m.tag == "a" for m in below(n)))
        if not lc:
            return c / t
        base = math.log(c / max(1, c - lc) * max(1, lc) + ratio * c + math.e)
        return c / t * max(0.0, math.log(max(c / lc * t / lt, 1.0)) / math.log(max(base, 1 + 1e-9)))

    def total(n, ratio):
        return sum(density(k, ratio) if k.tag in h.BLOCKS or k.tag == "a" else total(k, ratio) for k in kids(n))

    for seed in range(30):
        rnd = random.Random(seed)
        body = h.Node("body", False)
        body.parts = [_random_tree(rnd) for _ in range(3)]
        ratio = link_chars(body) / max(1, chars(body))
        for n in h.densities(body):
            assert (n.chars, n.link_chars) == (chars(n), link_chars(n))
            assert n.density == pytest.approx(density(n, ratio)) and n.total == pytest.approx(total(n, ratio))
        blocks = [n for n in [body, *below(body)] if n.tag in h.BLOCKS]
        dense = max([n for n in blocks if any(isinstance(p, str) for p in n.parts)] or blocks, key=lambda n: n.density)
        path = [dense]
        while path[-1] is not body:
            path.append(next(n for n in [body, *below(body)] if path[-1] in kids(n)))
        least = min(n.density for n in path if n.tag in h.BLOCKS)
        inside = [n for n in [body, *below(body)] if n.tag in h.BLOCKS and n.density >= least and n.total > 0]
        if inside:
            want = max(inside, key=lambda n: n.total)
            got = h.main_node(body)
            assert got is want or {id(n) for n in [want, *below(want)]} <= {id(n) for n in [got, *below(got)]}
