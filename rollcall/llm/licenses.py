"""License scans: exact phrases, and short notices found with a bounded number of edits.

Texts are reduced to their words joined by one space.  A notice that may differ
in k characters is cut into k + 2 parts: in any match with at most k edits two
parts stand unchanged (pigeonhole), shifted against each other by at most k
characters.  One Aho-Corasick pass over all parts finds every such pair of
seeds, and the regex library's bounded-error matching verifies the
neighbourhood and reports span and edits.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import map_rows
from rollcall.llm.words import ALNUM, split

# fixed: phrases whose words are counted exactly, and their labels
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# short notices searched with edits: label and text (lower case, words only)
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", "licensed under the gnu general public license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license"),
    ("cc-by", "licensed under a creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "dedicated to the public domain"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("reserved", "all rights reserved"),
]
ERROR_SHARE = 0.1   # edits allowed per character of a notice (at least 1)


def parts_of(notice: str, k: int) -> list[tuple[int, str]]:
    """The notice cut into k + 2 parts of about the same length: (offset, part)."""
    cuts = [round(i * len(notice) / (k + 2)) for i in range(k + 3)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """Compiled notices; ``notices`` are (label, text) pairs, ``error_share`` bounds the edits."""

    def __init__(self, notices: list[tuple[str, str]], error_share: float):
        self.notices, seeds = [], {}
        for n, (label, text) in enumerate(notices):
            k = max(1, int(error_share * len(text)))
            pattern = regex.compile(r"(?<!\S)(?:%s){e<=%d}(?!\S)" % (regex.escape(text, literal_spaces=True), k), regex.BESTMATCH)
            self.notices.append((label, text, k, pattern))
            for offset, part in parts_of(text, k):
                seeds.setdefault(part, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for part, where in seeds.items():
            self.automaton.add_word(part, (len(part), where))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[str, int, int, int]]:
        """Matches (label, start, end, edits) in text order; of overlapping ones the one with the fewest edits."""
        near: dict[int, list[tuple[int, int]]] = {}
        recent: dict[int, list[tuple[int, int]]] = {}     # per notice: (part offset, where the notice would start)
        for last, (size, where) in self.automaton.iter(text):
            for n, offset in where:
                _, notice, k, _ = self.notices[n]
                start = last + 1 - size - offset
                before = recent.get(n, ())
                if before and before[-1][1] < start - len(notice) - k:
                    before = ()
                if any(o != offset and abs(s - start) <= k for o, s in before):
                    a, b = max(0, start - 2 * k - 1), min(len(text), start + len(notice) + 2 * k + 1)
                    spans = near.setdefault(n, [])
                    if spans and a <= spans[-1][1]:
                        spans[-1] = (min(spans[-1][0], a), max(spans[-1][1], b))
                    else:
                        spans.append((a, b))
                recent[n] = [(o, s) for o, s in before if s >= start - len(notice) - k] + [(offset, start)]
        found = [m for n, spans in near.items() for a, b in spans for m in self.best_matches(n, text, a, b)]
        kept: list[tuple[str, int, int, int]] = []
        for m in sorted(found, key=lambda x: (x[3], x[1] - x[2], x[1], x[0])):
            at = bisect.bisect_left(kept, m[1], key=lambda x: x[1])
            if (at == 0 or kept[at - 1][2] <= m[1]) and (at == len(kept) or kept[at][1] >= m[2]):
                kept.insert(at, m)
        return kept

    def best_matches(self, n: int, text: str, a: int, b: int) -> list[tuple[str, int, int, int]]:
        """Matches of notice n between a and b, the best first, then the best of what is left.

        The best match of a long region is the best of overlapping stretches, each a few times
        as long as the notice; a stretch is searched again only when a better match took a piece
        of it, so the time grows with the region's length.
        """
        label, notice, k, pattern = self.notices[n]
        step = len(notice) + 2 * k + 2
        heap: list[tuple[int, int, int, int, int, int]] = []
        taken: list[tuple[int, int]] = []

        def search(lo: int, hi: int) -> None:
            m = pattern.search(text, lo, hi) if lo < hi else None
            if m is not None:
                heapq.heappush(heap, (sum(m.fuzzy_counts), m.start() - m.end(), m.start(), m.end(), lo, hi))

        for lo in range(a, b, step):
            hi = lo + 2 * step
            if hi < b:      # up to the end of the word there; a word longer than any match is left out
                end = text.find(" ", hi, hi + 2 * step)
                hi = end if end >= 0 else max(lo, text.rfind(" ", lo, hi))
            search(lo, min(hi, b))
        out = []
        while heap:
            edits, _, start, end, lo, hi = heapq.heappop(heap)
            at = bisect.bisect_left(taken, (start, end))
            near = [t for t in taken[max(0, at - 1):at + 1] if t[0] < end and t[1] > start]
            if near:        # a better match overlaps: search what it leaves of the stretch
                search(lo, min(near[0][0], hi))
                search(max(near[-1][1], lo), hi)
                if len(near) > 1:
                    search(near[0][1], near[1][0])
                continue
            out.append((label, start, end, edits))
            taken.insert(at, (start, end))
            search(lo, min(start, hi - 1))
            search(max(end, lo + 1), hi)
        return list(dict.fromkeys(out))


def exact_places(joined: str, phrase: str) -> list[int]:
    """Character positions in ' w w w ' where the phrase's words stand consecutively, overlapping ones included."""
    out, needle = [], f" {phrase} "
    at = joined.find(needle)
    while at >= 0:
        out.append(at)
        at = joined.find(needle, at + 1)
    return out


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 notices: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None,
                 error_share: float = ERROR_SHARE) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts all places of the exact phrases, first_word and last_word are
    their smallest and largest word positions (null without one).  labels adds
    the fuzzy notices' labels to the phrases'.  score is the best match's share
    of unchanged characters (1.0 for an exact phrase, 0.0 without a match).
    spans lists the fuzzy matches: label, first word, last word, edits.  Null
    and empty texts match nothing; repeated rows are scanned each.
    """
    notices, phrases = notices or NOTICES, phrases or PHRASES

    def make() -> Callable[..., tuple]:
        scanner = Scanner(notices, error_share)

        def scan(doc_id: object, text: str | None) -> tuple:
            words = split(text, ALNUM)
            joined = b" ".join(words).decode()
            framed = f" {joined} "
            base, starts = set(), []
            for phrase, label in phrases.items():
                places = exact_places(framed, phrase)
                if places:
                    base.add(label)
                    starts += places
            labels, spans, score = set(base), [], 1.0 if base else 0.0
            at = word = 0
            for label, a, b, edits in scanner.find(joined):     # in text order
                labels.add(label)
                score = max(score, 1.0 - edits / max(1, b - a))
                word, at = word + joined.count(" ", at, a), a
                spans.append((label, word, word + joined.count(" ", a, b), edits))
            return (doc_id, len(words), len(starts),
                    framed.count(" ", 0, min(starts)) if starts else None,
                    framed.count(" ", 0, max(starts)) if starts else None,
                    ",".join(sorted(base)), ",".join(sorted(labels)), min(1.0, max(0.0, score)),
                    [dict(zip(("label", "first_word", "last_word", "edits"), s)) for s in spans])

        return scan

    kind = dict(docs.dtypes)[id_col]
    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make,
                    f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
                    "labels string, score double, "
                    "spans array<struct<label:string,first_word:long,last_word:long,edits:int>>")
