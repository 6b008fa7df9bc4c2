"""Benchmark decontamination by winnowing.

For windows of L words, k-grams are hashed and the minimum hash of every run of
w = L - k + 1 consecutive k-grams is kept, for documents and benchmark items
alike: two texts that share L words in a row keep the same k-gram inside them.
Documents' fingerprints meet the items' in a join; every meeting is extended
word by word to both sides, and counts if at least L words agree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import cut, map_slices, set_aside_names
from rollcall.llm.words import ALNUM, Words, hashed, signed_hash, windows

WINDOW = 10              # words of a window; an item of fewer words is one window
FILTER_BITS = 1 << 23    # bits of the fingerprint filter sent to the tasks (fixed size)


def gram(length: int) -> tuple[int, int]:
    """(k, w): words of a gram and grams of a window, for windows of ``length`` words."""
    k = max(1, (length + 1) // 2)
    return k, length - k + 1


def winnow(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word, hash) of the grams that are the minimum of some window (all of them, if equal)."""
    k, w = gram(length)
    at, h = windows(words, k)
    n = len(h) - w + 1
    if n <= 0:
        return at[:0], h[:0]
    h = h ^ np.uint64(length * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    doc = words.doc[at]
    inside = doc[:n] == doc[w - 1:]
    least = h[:n].copy()
    for j in range(1, w):
        np.minimum(least, h[j:n + j], out=least)
    chosen = np.zeros(len(h), bool)
    for j in range(w):
        chosen[j:n + j] |= inside & (h[j:n + j] == least)
    return at[chosen], h[chosen]


def _context(words: Words, at: int, doc: int, length: int) -> tuple[bytes, int]:
    """The words that a window with the gram at ``at`` can cover, and how many of them stand before the gram."""
    k, w = gram(length)
    lo = max(int(words.first[doc]), at - w + 1)
    hi = min(int(words.first[doc + 1]), at + k + w - 1)
    return words.text(lo, hi), at - lo


def item_fingerprints(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(length, hash, context, before, item_ids): the items' fingerprints by distinct context."""
    def make() -> Callable[[list[tuple]], list[tuple]]:
        def run(rows: list[tuple]) -> list[tuple]:
            words = hashed([r[1] for r in rows], ALNUM)
            sizes = np.minimum(np.diff(words.first), window)
            out = []
            for length in set(sizes.tolist()) - {0}:
                at, h = winnow(words, length)
                doc = words.doc[at]
                for p, d, x in zip(at.tolist(), doc.tolist(), h.view(np.int64).tolist()):
                    if sizes[d] == length:
                        context, before = _context(words, p, d, length)
                        out.append((length, x, context.decode(), before, rows[d][0]))
            return out
        return run

    kind = dict(items.dtypes)[id_col]
    rows = map_slices(items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")), make,
                      f"length int, hash long, context string, before int, item_id {kind}")
    return rows.groupBy("length", "hash", "context", "before").agg(F.collect_set("item_id").alias("item_ids"))


def fingerprint_filter(prints: DataFrame) -> tuple[list[int], bytes]:
    """(window lengths in use, bit set of the hashes): at most FILTER_BITS bits, whatever the number of items."""
    slot = F.pmod(F.col("hash"), F.lit(FILTER_BITS))
    packed = (prints.select("length", F.shiftright(slot, 5).alias("word"), F.expr(f"1L << cast(pmod(hash, {FILTER_BITS}) % 32 as int)").alias("bit"))
              .groupBy("word").agg(F.bit_or("bit").alias("bits"), F.collect_set("length").alias("lengths")).collect())
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    for r in packed:
        bits[r.word] = r.bits
    return sorted({x for r in packed for x in r.lengths}), bits.tobytes()


def document_fingerprints(docs: DataFrame, lengths: list[int], bits: bytes, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, n_words and the winnowed fingerprints (with context) that the filter lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def make() -> Callable[[list[tuple]], list[tuple]]:
        table = np.frombuffer(shared.value, np.uint32)

        def run(rows: list[tuple]) -> list[tuple]:
            words = hashed([r[1] for r in rows], ALNUM)
            found: list[list[dict]] = [[] for _ in rows]
            for length in lengths:
                at, h = winnow(words, length)
                slot = h & np.uint64(FILTER_BITS - 1)
                hit = np.flatnonzero(table[(slot >> np.uint64(5)).astype(np.int64)] >> (slot & np.uint64(31)).astype(np.uint32) & 1)
                doc = words.doc[at[hit]]
                for p, d, x in zip(at[hit].tolist(), doc.tolist(), h[hit].view(np.int64).tolist()):
                    context, before = _context(words, p, d, length)
                    found[d].append({"length": length, "hash": x, "at": p - int(words.first[d]),
                                     "here": context.decode(), "lead": before})
            sizes = np.diff(words.first).tolist()
            return [(r[0], None if r[1] is None else signed_hash(r[1]), n, f)
                    for r, n, f in zip(rows, sizes, found)]
        return run

    kind = dict(docs.dtypes)[id_col]
    return map_slices(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make,
                      f"doc_id {kind}, text_hash long, n_words long, "
                      "prints array<struct<length:int,hash:long,at:long,here:string,lead:int>>")


def extended(met: DataFrame, key: str, ids: str) -> DataFrame:
    """(key, lo, hi, ids): the word range around each meeting that agrees on at least ``length`` words."""
    def make() -> Callable[[list[tuple]], list[tuple]]:
        def run(rows: list[tuple]) -> list[tuple]:
            out = []
            for row, length, at, here, lead, context, before, item_ids in rows:
                mine, theirs, k = here.split(" "), context.split(" "), gram(length)[0]
                if mine[lead:lead + k] != theirs[before:before + k]:
                    continue
                left = 0
                while left < min(lead, before) and mine[lead - left - 1] == theirs[before - left - 1]:
                    left += 1
                right = k
                while lead + right < len(mine) and before + right < len(theirs) and mine[lead + right] == theirs[before + right]:
                    right += 1
                if left + right >= length:
                    out.append((row, at - left, at + right, item_ids))
            return out
        return run

    kinds = dict(met.dtypes)
    return map_slices(met.select(key, "length", "at", "here", "lead", "context", "before", ids), make,
                      f"{key} {kinds[key]}, lo long, hi long, {ids} {kinds[ids]}")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash.

    n_hit counts the document's words inside any occurrence of an item's
    window, n_items the items with occurring windows, items_sha256 digests
    their ids.  Null and empty texts have no words, are clean and match
    nothing; repeated documents are judged each, repeated items count once;
    an item without an id contaminates but is not counted.
    """
    theirs = cut(item_fingerprints(items, item_id_col, item_text_col, window))
    lengths, bits = fingerprint_filter(theirs)
    mine = cut(document_fingerprints(docs, lengths, bits, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    met = mine.select("row", F.inline("prints")).join(theirs, ["length", "hash"])
    hits = (extended(met, "row", "item_ids").groupBy("row")
            .agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("ranges"),
                 F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("ids")))
    covered = F.aggregate("ranges", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
                          lambda acc, r: F.struct((acc["n"] + F.greatest(r["hi"] - F.greatest(r["lo"], acc["upto"]), F.lit(0))).alias("n"),
                                                  F.greatest(acc["upto"], r["hi"]).alias("upto")),
                          lambda acc: acc["n"])
    listed = hits.select(F.col("row").alias("hit_row"), covered.alias("n_hit"), F.size("ids").cast("long").alias("n_items"),
                         F.array_join(F.array_sort(F.transform("ids", lambda x: x.cast("string"))), ",").alias("listing"))
    return (mine.drop("prints").join(listed, F.col("row") == F.col("hit_row"), "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                    F.sha2(F.coalesce("listing", F.lit("")), 256).alias("items_sha256"),
                    (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "text_hash"))


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns, whatever their names and types) without a benchmark window."""
    docs, name, named = set_aside_names(docs)
    id_col, text_col = name(id_col), name(text_col)
    bad = (contamination(docs, items, id_col, text_col).filter("contaminated")
           .select(F.col("doc_id").alias("__bad_id"), F.col("text_hash").alias("__bad_text")).distinct())
    text_hash = F.when(F.col(text_col).isNotNull(), F.xxhash64(text_col))
    return named(docs.join(bad, F.col(id_col).eqNullSafe(F.col("__bad_id")) & (text_hash == F.col("__bad_text")), "left_anti"))
