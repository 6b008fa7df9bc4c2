"""Main text of web pages by composite text density.

The page is read into a tree (tolerating unclosed and stray tags); boilerplate
elements (navigation, adverts, forms, scripts, ...) are left out, by tag or by a
marking class, id or role unless they hold the densest part.  Each block
element and link gets a composite density: characters per tag, damped by the
share of link text (inline formatting belongs to the text of its block).  Nodes
at least as dense as the sparsest node on the path from body to the densest
node are candidates; the candidate whose children's densities sum highest is
the main content, widened to an enclosing article or main element that is a
candidate, too, or joined by the containers beside it that are built alike.
"""

from __future__ import annotations

import bisect
import html as entities
import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import map_rows

# fixed: element kinds of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hgroup html li main nav ol p pre section summary table tbody "
                   "td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# an opening tag of the key ends these elements if they are open (up to the nearest of the listed limits)
ENDS = ({b: ({"p"}, {"table", "td", "th"}) for b in BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}}
        | {"li": ({"li", "p"}, {"ul", "ol"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}),
           "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
           "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"}),
           "tbody": ({"tbody", "thead", "tr"}, {"table"}), "tfoot": ({"tbody", "thead", "tr"}, {"table"})})
# elements that are never main text
SKIPPED = frozenset("script style noscript template iframe nav footer aside form button select textarea input svg canvas "
                    "object embed head title dialog menu map audio video".split())
# words of class, id or role tokens: those that mark such elements, and those that may stand beside them (comment-list, site-footer)
MARKING = re.compile(r"ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|complementary|consent|contentinfo|cookies?|disqus|"
                     r"footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pagination|popup|promo\w*|related|"
                     r"replies|search|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget")
BESIDE = frozenset("area bar block body bottom box button buttons container form global group inner item items left links list main "
                   "outer page panel post posts reader readers right section site slot stories story thread top unit user users "
                   "wrap wrapper".split())
_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_SPECIAL = re.compile("[\"'>]")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Node:
    __slots__ = ("tag", "parts", "skipped", "marked", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, skipped: bool, marked: bool = False):
        self.tag, self.skipped, self.marked = tag, skipped, marked
        self.parts: list[Node | str] = []


def _marks(token: str) -> bool:
    """Whether a class, id or role token marks boilerplate: at least one marking word, and beside it only neutral ones."""
    words = [w for w in re.split(r"[_\-]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()) if w]
    if len(words) > 1 and MARKING.fullmatch("".join(words)):      # side-bar
        return True
    marking = [bool(MARKING.fullmatch(w)) for w in words]
    return any(marking) and all(m or w in BESIDE for m, w in zip(marking, words))


def _is_marked(tag: str, attrs: str) -> bool:
    if tag in ("html", "body", "article", "main") or "=" not in attrs:
        return False
    return any(_marks(token) for _, a, b, c in _ATTR.findall(attrs) for token in (a or b or c).split())


class TagEnds:
    """Where a tag that begins at a position ends: the next > outside quotes.

    Computed for all quotes and > of the page in one pass from its end, so that broken quotes cost no
    repeated scans.  A quote that is never closed is an ordinary character.
    """

    def __init__(self, page: str):
        found = [(m.start(), m[0]) for m in _SPECIAL.finditer(page)]
        self.at = [i for i, _ in found]
        self.end = [-1] * (len(found) + 1)
        later = {'"': -1, "'": -1}
        for k in range(len(found) - 1, -1, -1):
            i, c = found[k]
            if c == ">":
                self.end[k] = i
            else:
                close = later[c]
                self.end[k] = self.end[close + 1 if close >= 0 else k + 1]
                later[c] = k

    def __call__(self, start: int) -> int:
        return self.end[bisect.bisect_left(self.at, start)]


def parse(page: str) -> Node:
    """The page's element tree; text is kept undecoded.  The time grows with the page's length, however broken it is."""
    root = Node("html", False)
    stack, at, raw = [root], 0, ""
    is_open: Counter = Counter()
    ends = TagEnds(page)

    def close(i: int) -> None:
        for node in stack[i:]:
            is_open[node.tag] -= 1
        del stack[i:]

    pos = 0
    while True:
        m = _OPEN.search(page, pos)
        if m is None:
            break
        tag, closing, attrs = (m[4] or "").lower(), m[3], ""
        if m[1]:
            end = page.find("-->", m.end())
            end = len(page) if end < 0 else end + 3
        elif m[2]:
            end = page.find(">", m.end())
            end = len(page) if end < 0 else end + 1
        else:
            end = ends(m.end())
            if end < 0 or raw and not (closing and tag == raw):
                pos = m.end()
                continue
            attrs, end = page[m.end():end], end + 1
        if raw and not tag:
            pos = m.end()
            continue
        if m.start() > at:
            stack[-1].parts.append(page[at:m.start()])
        pos = at = end
        raw = ""
        if not tag:
            continue
        if closing:
            if is_open[tag] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                    if stack[i].tag in ("td", "th", "table") and tag not in BLOCKS:
                        break
            continue
        if tag in ENDS:
            ended, limits = ENDS[tag]
            if any(is_open[e] > 0 for e in ended):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in limits:
                        break
                    if stack[i].tag in ended:
                        close(i)
                        break
        # an article's own header holds its headings
        skipped = not (is_open["article"] > 0 or is_open["main"] > 0) if tag == "header" else tag in SKIPPED
        node = Node(tag, skipped, _is_marked(tag, attrs))
        stack[-1].parts.append(node)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCKS:
            continue
        stack.append(node)
        is_open[tag] += 1
        if tag in RAW:
            raw = tag
    if at < len(page) and raw not in SKIPPED:
        rest = page[at:]
        broken = rest.rfind("<")
        if broken >= 0 and ">" not in rest[broken:] and re.match(r"<[/a-zA-Z]", rest[broken:broken + 2]):
            rest = rest[:broken]
        stack[-1].parts.append(rest)
    return root


def _preorder(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [p for p in reversed(node.parts) if isinstance(p, Node) and not p.skipped]
    return out


def densities(root: Node) -> list[Node]:
    """Composite density and density sum of every kept node, in page order."""
    nodes = _preorder(root)
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.total = 0.0
        for p in node.parts:
            if isinstance(p, str):
                node.chars += len("".join(p.split()))
            elif not p.skipped:
                node.chars += p.chars
                node.tags += p.tags + (p.tag in BLOCKS or p.tag == "a")
                node.link_chars += p.link_chars
                node.link_tags += p.link_tags + (p.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    body = next((n for n in nodes if n.tag == "body"), root)
    page_ratio = body.link_chars / max(1, body.chars)
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
        rest = max(1, c - lc)
        base = math.log(c / rest * max(1, lc) + page_ratio * c + math.e) if c else 1.0
        inner = max(c / max(1, lc) * (t / lt), 1.0)
        node.density = c / t * max(0.0, math.log(inner) / math.log(max(base, 1.0 + 1e-9)) if lc else 1.0)
        node.total = 0.0
        for p in node.parts:
            if isinstance(p, Node) and not p.skipped:
                node.total += p.density if p.tag in BLOCKS or p.tag == "a" else p.total
    return nodes


def _own_chars(nodes: list[Node]) -> int:
    return sum(len("".join(p.split())) for n in nodes for p in n.parts if isinstance(p, str))


def leave_out_marked(root: Node) -> None:
    """Skip marked nodes, but none that holds the page's articles (or main) or the densest block of these or of the page.

    Articles inside marked nodes (comments) count only if there are no others.
    """
    nodes = _preorder(root)
    if not any(n.marked for n in nodes):
        return
    densities(root)
    parent = {id(p): n for n in nodes for p in n.parts if isinstance(p, Node)}
    marked = {}      # whether a node or one around it is
    for n in nodes:
        marked[id(n)] = n.marked or marked.get(id(parent.get(id(n))), False)
    articles = [n for n in nodes if n.tag in ("article", "main") and n.chars]
    held = [n for n in articles if not marked[id(n)]] or articles
    outer = {id(n) for n in held}
    inside = {}
    for n in nodes:
        inside[id(n)] = id(n) in outer or inside.get(id(parent.get(id(n))), False)
    region = [n for n in nodes if inside[id(n)]] or nodes
    plain = [n for n in region if not marked[id(n)]]
    if _own_chars(plain) * 5 >= _own_chars(region):      # else the marks are on the main text itself
        region = plain
    densest = max((n for n in region if n.tag in BLOCKS), key=lambda n: n.density, default=root)
    keep = set()
    for n in [densest, *held]:
        while n is not None and id(n) not in keep:
            keep.add(id(n))
            n = parent.get(id(n))
    for n in nodes:
        n.skipped = n.marked and id(n) not in keep


def _shapes(node: Node) -> set[tuple[str, ...]]:
    """How blocks with text stand in a node: the tags on the way to each."""
    out, todo = set(), [(node, ())]
    while todo:
        n, way = todo.pop()
        for p in n.parts:
            if isinstance(p, str):
                if n is not node and p.strip():
                    out.add(way)
            elif not p.skipped and len(way) < 8:
                todo.append((p, (*way, p.tag) if p.tag in BLOCKS else way))
    return out


def _alike(a: Node, b: Node) -> bool:
    """Whether b is a part of the main text as a is: the same element, text in blocks that stand the same way, few links."""
    return b.tag == a.tag and not b.skipped and 2 * b.link_chars <= b.chars and bool(_shapes(a) & _shapes(b))


def main_node(root: Node) -> Node:
    """The subtree with the largest density sum among nodes at least as dense as the body path's sparsest.

    A sum of child densities cannot see that a text goes on in the next container (two dense
    containers sum to less than one container's paragraphs).  So the subtree is joined by the siblings, and
    those of the nodes around it, that are built like it, with the headings before and between them.
    """
    leave_out_marked(root)
    nodes = densities(root)
    parent = {id(p): n for n in nodes for p in n.parts if isinstance(p, Node)}

    def path(node: Node) -> list[Node]:
        out = [node]
        while id(out[-1]) in parent and out[-1].tag != "body":
            out.append(parent[id(out[-1])])
        return out

    shown = [n for n in nodes if n.tag in BLOCKS]
    # the path starts at a block with text of its own: a few links raise the density of everything around them
    texts = [n for n in shown if any(isinstance(p, str) and p.strip() for p in n.parts)] or shown
    threshold = min(n.density for n in path(max(texts, key=lambda n: n.density)) if n.tag in BLOCKS)
    within = [n for n in shown if n.density >= threshold and n.total > 0]
    best = max(within, key=lambda n: n.total, default=root)
    around = path(best)
    article = next((n for n in reversed(around) if n.tag in ("article", "main") and n.density >= threshold), None)
    if article is not None:
        return article
    joined = best
    for node, above in zip(around, around[1:]):
        if node.tag in ("body", "html"):
            break
        children = [p for p in above.parts if isinstance(p, Node)]
        parts = {id(p) for p in children if p is node or node.tag in BLOCKS and _alike(node, p)}
        if len(parts) > 1:
            last = max(k for k, p in enumerate(children) if id(p) in parts)
            whole = Node(above.tag, False)
            whole.parts = [joined if p is node else p for k, p in enumerate(children)
                           if id(p) in parts or k < last and p.tag in HEADINGS and not p.skipped]
            joined = whole
    return joined


def text_blocks(node: Node) -> list[str]:
    """Decoded text of the node's blocks in page order, white space collapsed, empty blocks left out."""
    out, current = [], []

    def flush() -> None:
        if current:
            block = " ".join(entities.unescape("".join(current)).split())
            current.clear()
            if block:
                out.append(block)

    todo: list[Node | str | None] = [node]
    while todo:
        p = todo.pop()
        if p is None:
            flush()
        elif isinstance(p, str):
            current.append(p)
        elif not p.skipped:
            if p.tag == "br":
                current.append(" ")
            elif p.tag in BLOCKS:
                flush()
                todo.append(None)
            todo += reversed(p.parts)
    flush()
    return out


def extract(page: str | None) -> str:
    """The main text of one page ('' for null, empty or text-free pages)."""
    if not page:
        return ""
    return " ".join(text_blocks(main_node(parse(page))))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null and empty pages give an empty text; pages of any length are read
    whole; repeated rows are extracted each.
    """
    def make() -> Callable[..., tuple]:
        def run(page_id: object, url: str | None, page: str | None) -> tuple:
            text = extract(page)
            return page_id, url, text, len(text)
        return run

    kind = dict(pages.dtypes)
    return map_rows(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")),
                    make, f"page_id {kind[id_col]}, url {kind[url_col]}, text string, n_chars long")
