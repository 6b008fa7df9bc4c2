"""Byte-level BPE as a bounded-lookahead streaming transducer, and its decoder.

A BPE result is the one segmentation whose neighbouring tokens are compatible:
merging the two tokens' bytes on their own gives the same two tokens back.  So
every prefix of a piece has one last token: of the tokens that end there (an
Aho-Corasick automaton lists them) the one that is compatible with the last
token of the prefix before it.  And the last tokens of the prefixes that end within
one longest token of the read position (the merge list's lookahead) are all
that the future can depend on.  Tokens on which all of those agree are emitted
at once and forgotten; memory does not grow with the text.

Decoding feeds the tokens' bytes, one by one, to an incremental UTF-8 state
machine.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import map_rows

# fixed: how byte-level BPE files split text before merging
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_PIECES = 1 << 19    # pieces remembered per worker
CACHE_BYTES = 64          # longer pieces are not remembered
TEXT_BLOCK = 1 << 16      # characters, or decoded tokens, per block
_NONE, _NOTHING = -1, -2  # no last token known (yet); no token before the position
_BLOCK_END = regex.compile(r" [a-z]")


def printable_bytes() -> dict[str, int]:
    """The characters that stand for the 256 bytes in byte-level BPE files.

    Printable Latin-1 characters stand for themselves, the rest for U+0100 and up in order.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in shown}
    hidden = (b for b in range(256) if b not in set(shown))
    return out | {chr(256 + i): b for i, b in enumerate(hidden)}


class Remembered(dict):
    """Values computed once per key; cleared when CACHE_PIECES are held, long keys are not kept."""

    def __init__(self, compute: Callable[[str], bytes]):
        super().__init__()
        self.compute = compute

    def __missing__(self, key: str) -> bytes:
        value = self.compute(key)
        if len(key) <= CACHE_BYTES:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[key] = value
        return value


def blocks(text: str) -> Iterator[str]:
    """The text in blocks of about TEXT_BLOCK characters, cut before a space that a letter a-z follows."""
    at = 0
    while len(text) - at > 2 * TEXT_BLOCK:
        found = _BLOCK_END.search(text, at + TEXT_BLOCK)
        if found is None:
            break
        yield text[at:found.start()]
        at = found.start()
    yield text[at:] if at else text


class Codec:
    """A byte-level BPE vocabulary file, its encoder and decoder."""

    def __init__(self, content: str):
        spec = json.loads(content)
        table = printable_bytes()

        def raw(token: str) -> bytes:
            return bytes(table[c] for c in token)

        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.ranks = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[raw(left), raw(right)] = rank
        self.halves = {a + b: (a, b) for a, b in self.ranks}
        self.made = {a + b: rank for (a, b), rank in self.ranks.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self._proper: dict[bytes, bool] = {}
        self._pieces = regex.compile(PIECES)
        self._special = (regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
                         if self.special else None)
        self._compatible: dict[int, bool] = {}     # by the two tokens' ids
        self._cuts = regex.compile(r" (?=\S)")
        self._known_pieces = Remembered(self.encode_piece)
        self._after_space = Remembered(lambda segment: self.encode_segment(" " + segment))
        self.whole = {t for t in self.ids if self.proper(t)}
        self.single = {t: self.ids[t].to_bytes(4, "little") for t in self.whole}   # pieces of one token
        self.sizes = {self.ids[t]: len(t) for t in self.whole}
        self._packed = {i: i.to_bytes(4, "little") for i in self.sizes}
        self._size = [self.sizes.get(i, 0) for i in range(max(self.sizes) + 1)]
        self.automaton = ahocorasick.Automaton()
        for t in self.whole:
            self.automaton.add_word(t.decode("latin-1"), self.ids[t])
        self.automaton.make_automaton()
        self.lookahead = self.sufficient_lookahead()

    def sufficient_lookahead(self) -> int:
        """Bytes beyond a position that can still change the tokens before it.

        A token that reaches beyond the read position began at most the longest token before it, so
        only the last tokens of the prefixes ending that close matter: the length of the longest token that the
        merge list really makes (a listed one whose own bytes merge differently never occurs).
        """
        return max(map(len, self.whole))

    def proper(self, token: bytes) -> bool:
        """Whether the merges of the token's own bytes give the token (then its halves are so made, too)."""
        halves = self.halves.get(token)
        if halves is None:
            return len(token) == 1
        known = self._proper.get(token)
        if known is None:
            made = self.made[token]
            known = self._proper[token] = (all(self.proper(h) and self.made.get(h, -1) < made for h in halves)
                                           and self.compatible(*halves, before=made))
        return known

    def merge(self, data: bytes) -> list[bytes]:
        """The definition: apply the earliest listed merge, leftmost first, until none applies."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.ranks:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def compatible(self, left: bytes, right: bytes, before: int = 1 << 60) -> bool:
        """Whether the two tokens stay as they are when they meet (through the merges ranked under ``before``).

        Undo the tokens' merges, the latest first (of one rank, the right one:
        merges go left to right), and look at each moment at the two parts that
        touch: they must not have a merge of their own that would come earlier.
        """
        a, b, until = left, right, before
        while True:
            if self.ranks.get((a, b), 1 << 61) < until:
                return False
            made_a, made_b = self.made.get(a, -1), self.made.get(b, -1)
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                a, until = self.halves[a][1], made_a
            else:
                b, until = self.halves[b][0], made_b + 1

    def _pair(self, key: int) -> bool:
        """Whether two tokens, by their ids, are compatible; remembered."""
        if len(self._compatible) >= 4 * CACHE_PIECES:
            self._compatible.clear()
        known = self._compatible[key] = self.compatible(self.bytes_of[key >> 32], self.bytes_of[key & 0xFFFFFFFF])
        return known

    def transduce(self, data: Iterable[bytes]) -> Iterator[int]:
        """Token ids of one piece that arrives in blocks of bytes, each emitted once it is stable.

        Live state: the state of the automaton and, per position since the last
        stable cut (a few times ``lookahead``), the last token of the prefix that ends there.
        """
        size, known, pair, ahead, none = self._size, self._compatible.get, self._pair, self.lookahead, _NONE
        last, base, found = [_NOTHING], 0, None     # last[i]: of the prefix that ends at base + i
        for block in data:
            text = block.decode("latin-1")
            found = self.automaton.iter(text) if found is None else found.set(text, False) or found
            last += [none] * len(text)
            shift = 1 - base
            for end, token in found:
                end += shift
                if last[end] == none:
                    left = last[end - size[token]]
                    if left >= 0:
                        fits = known(left << 32 | token)
                        if fits or fits is None and pair(left << 32 | token):
                            last[end] = token
                    elif left == _NOTHING:
                        last[end] = token
            if len(last) > 4 * ahead:
                stable = self._agreed(last, len(last) - ahead)
                if stable:
                    yield from self._back(last, stable)
                    last, base = last[stable:], base + stable
        yield from self._back(last, len(last) - 1)

    def _back(self, last: list[int], end: int) -> list[int]:
        """The tokens up to a position."""
        out, size = [], self._size
        while end > 0:
            token = last[end]
            out.append(token)
            end -= size[token]
        out.reverse()
        return out

    def _agreed(self, last: list[int], first: int) -> int:
        """The last cut that the segmentations of all prefixes ending at ``first`` or later share."""
        live = set(range(first, len(last)))
        order = [-p for p in live]
        heapq.heapify(order)
        while len(live) > 1:
            p = -heapq.heappop(order)
            live.remove(p)
            p -= self.sizes[last[p]]
            if p not in live:
                live.add(p)
                heapq.heappush(order, -p)
        return live.pop()

    def encode_piece(self, piece: str) -> bytes:
        """Ids of a piece as little-endian unsigned 32-bit integers: one token, or through the transducer in blocks."""
        raw, step = piece.encode(), 2 * self.lookahead
        token = self.single.get(raw)
        if token is not None:
            return token
        blocks = (raw,) if len(raw) <= step else (raw[i:i + step] for i in range(0, len(raw), step))
        return b"".join(map(self._packed.__getitem__, self.transduce(blocks)))

    def encode_segment(self, segment: str) -> bytes:
        """Ids of a stretch of pieces."""
        return b"".join(map(self._known_pieces.__getitem__, self._pieces.findall(segment)))

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of a text as little-endian unsigned 32-bit integers, in blocks; listed special strings are one id.

        Pieces never extend over a space that a non-space follows, so the text
        is cut there and frequent stretches are remembered with their ids.
        """
        parts = self._special.split(text) if self._special and any(s in text for s in self.special) else [text]
        for part in parts:
            if part in self.special:
                yield self.special[part].to_bytes(4, "little")
                continue
            for block in blocks(part):
                segments = self._cuts.split(block)
                yield self.encode_segment(segments[0]) if segments[0] else b""
                yield b"".join(map(self._after_space.__getitem__, segments[1:]))

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of the ids, in blocks; bytes that are no UTF-8 become U+FFFD."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        block = bytearray()
        for i in ids:
            block += self.bytes_of[i]
            if len(block) >= TEXT_BLOCK:
                yield state.decode(bytes(block))
                block.clear()
        yield state.decode(bytes(block), True)


_codecs: dict[int, Codec] = {}


def _codec(content: str) -> Codec:
    key = hash(content)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(content)
    return _codecs[key]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary): the token ids of each whole text, little-endian unsigned 32-bit.

    ``vocabulary`` is the content of a byte-level BPE file (a file of fixed size, broadcast).
    Null and empty texts have no ids; repeated rows and very long texts are encoded like any other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make() -> Callable[..., tuple]:
        codec = _codec(shared.value)
        return lambda doc_id, text: (doc_id, b"".join(codec.encode(text or "")))

    kind = dict(docs.dtypes)[id_col]
    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make,
                    f"doc_id {kind}, ids binary")


def bpe_decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the texts of token ids; null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def make() -> Callable[..., tuple]:
        codec = _codec(shared.value)
        return lambda doc_id, ids: (doc_id, "".join(codec.decode(np.frombuffer(ids or b"", "<u4").tolist())))

    kind = dict(encoded.dtypes)[id_col]
    return map_rows(encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")), make,
                    f"doc_id {kind}, text string")


def bpe_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode each text, decode the ids, digest both.

    Blocks of ids go to the digest and the decoder as they are emitted, so no
    text's ids are held whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make() -> Callable[..., tuple]:
        codec = _codec(shared.value)

        def digest(doc_id: object, text: str | None) -> tuple:
            ids_sha, text_sha, n = hashlib.sha256(), hashlib.sha256(), 0
            state = codecs.getincrementaldecoder("utf-8")("replace")
            block: list[bytes] = []

            def flush(final: bool) -> int:
                packed = b"".join(block)
                block.clear()
                ids_sha.update(packed)
                ids = np.frombuffer(packed, "<u4").tolist()
                text_sha.update(state.decode(b"".join(map(codec.bytes_of.__getitem__, ids)), final).encode())
                return len(ids)

            for ids in codec.encode(text or ""):
                block.append(ids)
                if len(block) >= TEXT_BLOCK:
                    n += flush(False)
            return doc_id, n + flush(True), ids_sha.hexdigest(), text_sha.hexdigest()

        return digest

    kind = dict(docs.dtypes)[id_col]
    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make,
                    f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
