"""Elias-Fano sequences and a two-level n-gram trie on them, in memory-mapped arrays."""

from __future__ import annotations

import tempfile

import numpy as np


def mapped(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays, written to one unnamed temporary file and mapped from it read-only."""
    arrays = [np.ascontiguousarray(a) for a in arrays]
    with tempfile.TemporaryFile() as f:
        places = []
        for a in arrays:
            f.write(b"\0" * (-f.tell() % 8))
            places.append(f.tell())
            f.write(a.tobytes())
        f.flush()
        return [np.memmap(f, a.dtype, "r", at, a.shape) if a.size else a for a, at in zip(arrays, places)]


class EliasFano:
    """A monotone sequence of unsigned integers in about 2 + log2(universe / n) bits each.

    The low bits are packed; the high bits are a bit vector with a one per
    element after as many zeros as its high part, and a count of ones per word.
    """

    def __init__(self, values: np.ndarray):
        values = np.asarray(values, np.uint64)
        self.n = n = len(values)
        top = int(values[-1]) if n else 0
        self.low_bits = max(0, (top // max(1, n)).bit_length() - 1)
        low = values & np.uint64((1 << self.low_bits) - 1)
        at = (values >> np.uint64(self.low_bits)).astype(np.int64) + np.arange(n)
        size = int(at[-1]) + 1 if n else 1
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[at] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high))]).astype(np.uint32 if n < 1 << 32 else np.uint64)
        words = np.zeros(n * self.low_bits // 64 + 2, np.uint64)
        if self.low_bits:
            place = np.arange(n, dtype=np.uint64) * np.uint64(self.low_bits)
            word, shift = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            np.bitwise_or.at(words, word, low << shift)
            over = np.flatnonzero(shift + np.uint64(self.low_bits) > 64)
            np.bitwise_or.at(words, word[over] + 1, low[over] >> (np.uint64(64) - shift[over]))
        self.high, self.ones, self.words = mapped([high, ones, words])

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The values at the positions i."""
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.ones, i, "right") - 1
        rest = (i - self.ones[word].astype(np.int64))
        bits, at = np.array(self.high[word]), np.zeros(len(i), np.int64)
        for width in (32, 16, 8, 4, 2, 1):           # select the rest-th one of the word by halving
            part = bits & np.uint64((1 << width) - 1)
            count = np.bitwise_count(part).astype(np.int64)
            beyond = rest >= count
            rest = np.where(beyond, rest - count, rest)
            bits = np.where(beyond, bits >> np.uint64(width), part)
            at += np.where(beyond, width, 0)
        high = (word * 64 + at - i).astype(np.uint64)
        if not self.low_bits:
            return high
        place = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
        low = self.words[word] >> shift
        more = np.where(shift > 0, self.words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (high << np.uint64(self.low_bits)) | ((low | more) & np.uint64((1 << self.low_bits) - 1))

    def successor(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Per query the first position in [lo, hi) whose value is at least x (hi if none)."""
        lo, hi = lo.astype(np.int64).copy(), hi.astype(np.int64).copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self[mid] < x[live]
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[lo[live] < hi[live]]
        return lo


class Trie:
    """Contexts (level 1) with their successors (level 2): ids in Elias-Fano sequences, weights as 16-bit codes.

    Successor lists are stored one after the other, each shifted by the last
    stored value of the list before, which makes level 2 monotone; a search is
    relative to its context's shift.
    """

    def __init__(self, contexts: np.ndarray, starts: np.ndarray, successors: np.ndarray,
                 context_codes: np.ndarray, successor_codes: np.ndarray):
        sizes = np.diff(starts)
        last = successors[starts[1:] - 1].astype(np.uint64) + np.uint64(1)
        shift = np.concatenate([[0], np.cumsum(last)[:-1]]).astype(np.uint64) if len(sizes) else np.zeros(0, np.uint64)
        self.contexts, self.pointers = EliasFano(contexts), EliasFano(starts)
        self.successors = EliasFano(successors.astype(np.uint64) + np.repeat(shift, sizes))
        self.context_codes, self.successor_codes = mapped([context_codes, successor_codes])

    def context(self, ids: np.ndarray) -> np.ndarray:
        """Level-1 positions, -1 for absent contexts."""
        n = self.contexts.n
        at = self.contexts.successor(ids.astype(np.uint64), np.zeros(len(ids), np.int64), np.full(len(ids), n))
        found = at < n
        found[found] = self.contexts[at[found]] == ids[found].astype(np.uint64)
        return np.where(found, at, -1)

    def successor(self, context: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Level-2 positions of the ids in their contexts' lists (context positions >= 0), -1 where absent."""
        lo, hi = self.pointers[context].astype(np.int64), self.pointers[context + 1].astype(np.int64)
        shift = np.zeros(len(lo), np.uint64)
        later = lo > 0
        shift[later] = self.successors[lo[later] - 1] + np.uint64(1)
        x = ids.astype(np.uint64) + shift
        at = self.successors.successor(x, lo, hi)
        found = at < hi
        found[found] = self.successors[at[found]] == x[found]
        return np.where(found, at, -1)
