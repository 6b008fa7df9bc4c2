"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints that differ in at most ``max_bits`` bits differ in at most that
many of their 8 bytes, so they share at least m = 8 - max_bits bytes in place.
The index holds, for each distinct fingerprint, one posting per choice of m
byte positions, keyed by the choice and the bytes there: two fingerprints that
share s bytes meet in C(s, m) lists, so meeting at all is the count filter
"shares at least m positional bytes", and no list is longer than the 256 ** (8
- m) values of the free bytes, whatever the input.  Within a list the free
bytes are verified bit by bit, and only a spanning forest of the verified
links is emitted, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import cut, map_rows, set_aside_names
from rollcall.llm.components import components
from rollcall.llm.words import LOWER_SPACED

SHINGLE, MAX_BITS, SEED = 3, 2, 42
_BLOCK = 1 << 16    # shingles hashed at a time


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits: set where over half the shingles' XXH64 have the bit; 0 without words."""
    words = text.encode().translate(LOWER_SPACED).split() if text else []
    if not words:
        return 0
    flat = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts, ends = (ends - lens).tolist(), ends[min(shingle, len(words)) - 1:].tolist()
    votes, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(ends), _BLOCK):
        h = np.fromiter((digest(flat[s:e], SEED) for s, e in zip(starts[at:at + _BLOCK], ends[at:at + _BLOCK])),
                        np.dtype("<u8"), len(ends[at:at + _BLOCK]))
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(ends), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) of every document; fp holds the 64 bits as a signed integer."""
    def make() -> Callable[..., tuple]:
        def run(doc_id: object, text: str | None) -> tuple:
            fp = fingerprint(text, shingle)
            return doc_id, fp - (1 << 64) if fp >> 63 else fp
        return run

    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make,
                    f"doc_id {dict(docs.dtypes)[id_col]}, fp long")


def _choices(max_bits: int) -> list[tuple[int, int]]:
    """(mask of the chosen bytes, mask of the free bytes) for every choice of 8 - max_bits positions."""
    every = (1 << 64) - 1
    out = []
    for free in combinations(range(8), max_bits):
        gap = sum(0xFF << (8 * p) for p in free)
        out.append((every ^ gap, gap))
    return out


def _forest(values: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (from, to) that connect the values within max_bits of each other: to is the least value reached."""
    label = np.arange(len(values))
    if len(values) <= 64:      # compare directly
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= max_bits
        a, b = np.nonzero(np.triu(near, 1))
    else:                      # look up every value that differs in at most max_bits bits
        order = np.argsort(values)
        ranked, found = values[order], []
        spread = np.bitwise_or.reduce(values) ^ np.bitwise_and.reduce(values)
        bits = [np.uint64(1 << i) for i in range(64) if int(spread) >> i & 1]
        for n in range(1, max_bits + 1):
            for flips in combinations(bits, n):
                other = values ^ np.bitwise_or.reduce(np.array(flips, np.uint64))
                at = np.minimum(np.searchsorted(ranked, other), len(ranked) - 1)
                hit = np.flatnonzero((ranked[at] == other) & (values < other))
                found.append((hit, order[at[hit]]))
        a, b = (np.concatenate(x) for x in zip(*found))
    while len(a):              # least label over links, with shortcuts, until nothing changes
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints (column fp) within max_bits of each other."""
    choices = _choices(max_bits)
    postings = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(_signed(keep)).alias("shared"))
                         for i, (keep, _) in enumerate(choices)])
    lists = prints.select("fp", F.inline(postings)).repartition("choice", "shared").sortWithinPartitions("choice", "shared", "fp")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((0, 3), np.int64)       # rows of the list that may go on in the next batch
        def close(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(rows):
                return
            new = np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])) + 1
            edges = np.concatenate([[0], new, [len(rows)]])
            out_a, out_b = [], []
            for k in np.flatnonzero(np.diff(edges) > 1):
                a, b = _forest(rows[edges[k]:edges[k + 1], 2].view(np.uint64), max_bits)
                out_a.append(a)
                out_b.append(b)
            if out_a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).view(np.int64)) for x in (out_a, out_b)], names=["a", "b"])
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            rows = np.ascontiguousarray(np.concatenate([rest, rows]))
            last = np.flatnonzero((rows[:, 0] != rows[-1, 0]) | (rows[:, 1] != rows[-1, 1])) if len(rows) else []
            done = int(last[-1]) + 1 if len(last) else 0
            yield from close(rows[:done])
            rest = rows[done:]
        yield from close(rest)

    return lists.select("choice", "shared", "fp").mapInArrow(scan, "a long, b long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document row.

    component_id is the smallest doc_id among the documents whose fingerprints
    are connected by steps of at most max_bits bits.  Documents without words
    (null or empty texts too) have fingerprint zero and are linked like any
    other; equal fingerprints are one node, however many rows share them;
    a null doc_id is ignored in the minimum (null if a group has no other).
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = components(links(nodes.select("fp"), max_bits), "a", "b")
    of = cut(nodes.join(joined, nodes.fp == joined.node, "left")
             .select("fp", "least", F.coalesce("component", "fp").alias("component")))
    smallest = of.groupBy("component").agg(F.min("least").alias("component_id"))
    named = of.join(smallest, "component").select(F.col("fp").alias("of_fp"), "component_id")
    return (prints.join(named, prints.fp == named.of_fp)
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay: of each near-duplicate group the row with the smallest id.

    Of rows that repeat an id one stays (the least by text, then the other columns).
    Rows without an id cannot be told apart and stay.
    """
    docs, name, named = set_aside_names(docs)
    id_col, text_col = name(id_col), name(text_col)
    with_id = docs.filter(F.col(id_col).isNotNull())
    groups = simhash_groups(with_id, id_col, text_col, shingle, max_bits)
    stay = groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__stay")).distinct()
    here = with_id.join(stay, F.col(id_col) == F.col("__stay"), "left_semi")
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    kinds = dict(docs.dtypes)
    # maps have no order: their JSON text has
    order = F.struct(text_col, *[F.to_json(F.struct(c)).alias(c) if "map<" in kinds[c] or kinds[c] == "variant" else F.col(c) for c in rest])
    one = here.groupBy(id_col).agg(F.min_by(F.struct(text_col, *rest), order).alias("__row"))
    return named(one.select(id_col, "__row.*").select(*docs.columns).unionByName(docs.filter(F.col(id_col).isNull())))
