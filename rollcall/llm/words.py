"""Words of texts as bytes and as vectors of 64-bit hashes.

Both word rules used by the operators separate words at ASCII characters only,
so they can be applied to UTF-8 bytes with a translation table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

_UPPER_TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# words [^\x20\x09-\x0D]+ in lower case (bytes.split() separates at exactly these characters)
LOWER = _UPPER_TO_LOWER
# words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: letters, digits and all non-ASCII
ALNUM = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in _UPPER_TO_LOWER)
# words [^\x20\x09-\x0D]+ unchanged; separators become spaces
SPACED = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
LOWER_SPACED = bytes(_UPPER_TO_LOWER[b] for b in SPACED)

_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 22


def split(text: str | None, table: bytes | None = None) -> list[bytes]:
    """The words of a text (null: none), as UTF-8 bytes."""
    if not text:
        return []
    raw = text.encode()
    return (raw.translate(table) if table else raw).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads all bits of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        m = max(64, 2 * n)
        factors = np.full(m, _BASE, np.uint64)
        factors[0] = 1
        _powers = np.cumprod(factors, dtype=np.uint64)
    return _powers


def _hash_piece(arr: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lens = ends - starts
    kept = arr[arr != 32]
    at = np.cumsum(lens) - lens
    within = np.arange(len(kept), dtype=np.int64) - np.repeat(at, lens)
    values = (kept.astype(np.uint64) + np.uint64(1)) * _power(int(lens.max()))[within]
    return mix(np.add.reduceat(values, at) ^ (lens.astype(np.uint64) << np.uint64(48)))


@dataclass
class Words:
    """The words of several texts, one after the other."""
    data: bytes          # translated texts, separated by a space
    starts: np.ndarray   # byte positions in data
    ends: np.ndarray
    hashes: np.ndarray   # 64-bit word hashes
    first: np.ndarray    # first[i]..first[i+1]: the words of text i

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, lo: int, hi: int) -> bytes:
        """Words lo..hi-1, joined by one space."""
        return b" ".join(self.data[s:e] for s, e in zip(self.starts[lo:hi].tolist(), self.ends[lo:hi].tolist()))


def hashed(texts: list[str | bytes | None], table: bytes) -> Words:
    """Words and word hashes of texts; temporary memory is bounded per piece of a few MB."""
    raw = [b"" if not t else t.encode() if isinstance(t, str) else t for t in texts]
    data = b" ".join(raw).translate(table)
    arr = np.frombuffer(data, np.uint8)
    is_word = np.empty(len(arr) + 2, bool)
    is_word[0] = is_word[-1] = False
    np.not_equal(arr, 32, out=is_word[1:-1])
    edges = np.flatnonzero(is_word[1:] != is_word[:-1])
    starts, ends = edges[::2], edges[1::2]
    offsets = np.cumsum([0] + [len(r) + 1 for r in raw])
    first = np.searchsorted(starts, offsets)
    first[-1] = len(starts)
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + _PIECE)))
        a, b = starts[lo], ends[hi - 1]
        out[lo:hi] = _hash_piece(arr[a:b], starts[lo:hi] - a, ends[lo:hi] - a)
        lo = hi
    return Words(data, starts, ends, out, first)


def windows(words: Words, n: int, size: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(start word, hash) of every window of n words that lies inside one text."""
    h, total = words.hashes, len(words.hashes)
    if total < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    acc = np.zeros(total - n + 1, np.uint64)
    for j in range(n):
        acc = acc * np.uint64(_BASE) + h[j:total - n + 1 + j]
    doc = words.doc
    inside = np.flatnonzero(doc[:total - n + 1] == doc[n - 1:])
    return inside, mix(acc[inside])


def signed_hash(text: str) -> int:
    """What xxhash64(text) gives in Spark."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h
