"""Substring deduplication over the de Bruijn graph of word windows.

Edges are the windows of ``window`` consecutive words.  Documents are dealt to
chunks by ranges of their id.  Each chunk sends its distinct edges, as sorted
hashes, to the edges' shards; a shard joins them and answers, per edge, the
first chunk that has it.  In each document, neighbouring edges with one first
chunk compact into a path (a repeated span); paths travel, each distinct one
once, to the chunk they come from, where the source position of every edge is
looked up and the words are compared.  Words under verified edges that start
in a document with a smaller id are removed.

Every step is a Spark shuffle (group or cogroup) of one plan; the shuffle of
the documents is the same for all of them and done once.  An edge appears at
most once per chunk, so a passage that a third of all documents share is one
entry per chunk, not one per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from rollcall.llm.common import pieces, schema_of
from rollcall.llm.words import SPACED, hashed, windows

WINDOW = 13
CHUNK_BYTES = 4 << 20       # text of a chunk
CHUNKS_PER_SHARD = 16       # at least; more while shards are few
LEAST_SHARDS = 256      # so that hash div shards fits 7 bytes
USERS = 1 << 16         # chunks that are answered together about a span
_REPLY = "chunk long, shard int, bits binary, sources binary"
_SPAN = "chunk long, src long, words binary"


class Chunk:
    """The windows of one chunk's documents, which are ordered by id."""

    def __init__(self, docs: pa.Table, window: int, shards: int):
        order = np.argsort(docs.column("doc_id").to_numpy(), kind="stable")
        docs = docs.take(pa.array(order))
        self.ids = docs.column("doc_id").to_pylist()
        self.words = hashed(docs.column("text").to_pylist(), SPACED)
        self.at, self.hash = windows(self.words, window)
        self.doc = self.words.doc[self.at]
        self.edges, self.first, self.edge = np.unique(self.hash, return_index=True, return_inverse=True)
        n = np.uint64(shards)
        self.order = np.lexsort((self.edges // n, self.edges % n))        # the order in which edges are sent
        self.bounds = np.searchsorted((self.edges % n)[self.order], np.arange(shards + 1).astype(np.uint64))
        self.window, self.shards = window, shards

    def sent(self) -> Iterator[tuple[int, bytes]]:
        """(shard, quotients of its edges as 7-byte integers, ascending)."""
        q = (self.edges[self.order] // np.uint64(self.shards)).astype("<u8")
        packed = np.ascontiguousarray(q.view(np.uint8).reshape(-1, 8)[:, :7])
        for s in np.flatnonzero(np.diff(self.bounds)).tolist():
            yield s, packed[self.bounds[s]:self.bounds[s + 1]].tobytes()

    def source_of(self, replies: pa.Table, own: int, kind: str) -> np.ndarray:
        """Per window: the first chunk with its edge if the window repeats a document with a smaller id, else -1."""
        source = np.full(len(self.edges), -1, np.int64)
        wrong = []
        for s, bits, sources in zip(*(replies.column(c).to_pylist() for c in ("shard", "bits", "sources"))):
            if s < 0:
                wrong.append(np.frombuffer(bits, "<u8"))
                continue
            mine = self.order[self.bounds[s]:self.bounds[s + 1]]
            hit = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(mine)))
            source[mine[hit]] = np.frombuffer(sources, kind)
        if not len(self.at):
            return source
        ids = np.array(self.ids, np.int64)[self.doc]
        least = np.full(len(self.edges), np.iinfo(np.int64).max)
        np.minimum.at(least, self.edge, ids)
        out = source[self.edge]
        out[(out < 0) & (ids > least[self.edge])] = own
        if wrong:
            out[np.isin(self.hash, np.concatenate(wrong))] = -1
        return out

    def paths(self, source: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(source chunk, words) of the maximal runs of repeated neighbouring edges with one source chunk."""
        hit = np.flatnonzero(source >= 0)
        if not len(hit):
            return
        new = (np.diff(hit) > 1) | (np.diff(self.at[hit]) > 1) | (np.diff(source[hit]) != 0)
        starts = np.concatenate([[0], np.flatnonzero(new) + 1])
        ends = np.concatenate([starts[1:], [len(hit)]]) - 1
        for a, b in zip(hit[starts].tolist(), hit[ends].tolist()):
            yield int(source[a]), self.words.text(int(self.at[a]), int(self.at[b]) + self.window)

    def wrong_edges(self, spans: list[bytes]) -> dict[int, np.ndarray]:
        """Span number to hashes of its edges whose words do not stand at their source position here."""
        theirs = hashed(spans, SPACED)
        at, h = windows(theirs, self.window)
        if not len(self.edges):
            known, place = np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        else:
            where = np.minimum(np.searchsorted(self.edges, h), len(self.edges) - 1)
            known, place = self.edges[where] == h, self.at[self.first[where]]
        span, w = theirs.doc[at], self.window
        new = (np.diff(place) != 1) | (np.diff(at) != 1) | (np.diff(span) != 0) | ~known[1:] | ~known[:-1]
        starts = np.concatenate([[0], np.flatnonzero(new) + 1]).tolist()
        bad = ~known
        for a, b in zip(starts, [*starts[1:], len(h)]):
            if known[a]:
                p, q = int(place[a]), int(at[a])
                if self.words.text(p, p + b - a - 1 + w) != theirs.text(q, q + b - a - 1 + w):
                    for i in range(b - a):
                        bad[a + i] = self.words.text(p + i, p + i + w) != theirs.text(q + i, q + i + w)
        return {s: h[bad & (span == s)] for s in set(span[bad].tolist())}


def _answer(table: pa.Table, kind: str) -> Iterator[tuple[int, bytes, bytes]]:
    """Per chunk of a shard: which of its edges an earlier chunk has, and for those the first such chunk."""
    chunks = table.column("chunk").to_numpy()
    blobs = table.column("edges").to_pylist()
    sizes = np.array([len(b) // 7 for b in blobs])
    raw = np.zeros((int(sizes.sum()), 8), np.uint8)
    raw[:, :7] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 7)
    q, chunk = raw.view("<u8").reshape(-1), np.repeat(chunks, sizes)
    order = np.lexsort((chunk, q))
    q, ranked = q[order], chunk[order]
    new = np.concatenate([[True], q[1:] != q[:-1]])
    first = np.empty(len(q), np.int64)
    first[order] = ranked[np.flatnonzero(new)][np.cumsum(new) - 1]
    ends = np.cumsum(sizes)
    for c, a, b in zip(chunks.tolist(), ends - sizes, ends):
        hit = first[a:b] < c
        if hit.any():
            yield c, np.packbits(hit).tobytes(), first[a:b][hit].astype(kind).tobytes()


def chunk_bounds(docs: DataFrame, id_col: str, chunks: int) -> list[int]:
    """Upper ends of about equal ranges of the ids (at most ``chunks`` numbers)."""
    cuts = [i / chunks for i in range(1, chunks)]
    found = docs.agg(F.percentile_approx(id_col, cuts, 20 * chunks).alias("b")).first()["b"]
    return sorted(set(found or []))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text of the kept words, joined by one space) of every document row.

    A word goes if a window covering it also starts in a document with a
    smaller id; windows are judged on the input.  ``id_col`` is an integer.
    Null and empty texts have no words; documents without an id are neither
    removed from nor sources; rows that share an id are not sources of each
    other.  ``chunk_bytes`` (text per chunk, held by one task) changes no result.
    """
    chunks = pieces(docs, text_col, chunk_bytes)
    shards = max(LEAST_SHARDS, chunks // CHUNKS_PER_SHARD)
    kind = "<u2" if chunks < 1 << 16 else "<u4"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bounds = np.array(chunk_bounds(rows, "doc_id", chunks), np.int64)

    dealt_schema = to_arrow_schema(schema_of("doc_id long, text string, chunk long"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, text, spread in (b.columns for b in batches):
            known = np.searchsorted(bounds, ids.fill_null(0).to_numpy())
            chunk = np.where(ids.is_null().to_numpy(zero_copy_only=False), -1 - spread.to_numpy(), known)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip((ids, text, pa.array(chunk)), dealt_schema)],
                                             schema=dealt_schema)

    dealt = (rows.withColumn("spread", F.pmod(F.xxhash64("text"), F.lit(chunks)).cast("long"))   # chunk of rows without an id
             .mapInArrow(deal, "doc_id long, text string, chunk long"))
    by_chunk = dealt.groupBy("chunk")

    edges_ddl, result_ddl = "shard int, chunk long, edges binary", "doc_id long, n_words long, n_removed long, kept string"
    arrow = {ddl: to_arrow_schema(schema_of(ddl)) for ddl in (_REPLY, _SPAN, edges_ddl, result_ddl)}

    def batch(rows: list[tuple], ddl: str) -> pa.Table:
        schema = arrow[ddl]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else
                                    [pa.array([], f.type) for f in schema], schema=schema)

    def send(key: tuple, table: pa.Table) -> pa.Table:
        own = key[0].as_py()
        return batch([] if own < 0 else [(s, own, e) for s, e in Chunk(table, window, shards).sent()], edges_ddl)

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        return batch([(c, key[0].as_py(), b, s) for c, b, s in _answer(table, kind)], _REPLY)

    def compact(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        own = key[0].as_py()
        if own < 0 or not table.num_rows:
            return batch([], _SPAN)
        chunk = Chunk(table, window, shards)
        found = set(chunk.paths(chunk.source_of(replies, own, kind)))
        return batch([(own, src, words) for src, words in sorted(found)], _SPAN)

    def verify(key: tuple, table: pa.Table, spans: pa.Table) -> pa.Table:
        out = []
        if spans.num_rows and table.num_rows:
            chunk = Chunk(table, window, shards)
            users = spans.column("users")
            for i, wrong in chunk.wrong_edges(spans.column("words").to_pylist()).items():
                out += [(c, -1, wrong.astype("<u8").tobytes(), b"") for c in users[i].as_py()]
        return batch(out, _REPLY)

    def remove(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        own = key[0].as_py()
        if not table.num_rows:
            return batch([], result_ddl)
        if own < 0:
            words = hashed(table.column("text").to_pylist(), SPACED)
            ids, gone = table.column("doc_id").to_pylist(), np.zeros(len(words.hashes) + 1, bool)
        else:
            chunk = Chunk(table, window, shards)
            words, ids = chunk.words, chunk.ids
            hit = chunk.at[chunk.source_of(replies, own, kind) >= 0]
            depth = np.zeros(len(words.hashes) + 1, np.int64)
            np.add.at(depth, hit, 1)
            np.add.at(depth, hit + window, -1)
            gone = np.cumsum(depth) > 0
        out = []
        for i, doc_id in enumerate(ids):
            a, b = int(words.first[i]), int(words.first[i + 1])
            kept = (np.flatnonzero(~gone[a:b]) + a)
            text = b" ".join([words.data[s:e] for s, e in zip(words.starts[kept].tolist(), words.ends[kept].tolist())])
            out.append((doc_id, b - a, b - a - len(kept), text.decode()))
        return batch(out, result_ddl)

    replies = by_chunk.applyInArrow(send, edges_ddl).groupBy("shard").applyInArrow(answer, _REPLY)
    spans = by_chunk.cogroup(replies.groupBy("chunk")).applyInArrow(compact, _SPAN)
    # a span is verified once for each USERS chunks that have it, so that no row lists them all
    some = F.floor(F.col("chunk") / USERS).alias("some")
    distinct = spans.groupBy("src", "words", some).agg(F.collect_set("chunk").alias("users"))
    wrong = by_chunk.cogroup(distinct.select(F.col("src").alias("chunk"), "words", "users").groupBy("chunk")).applyInArrow(verify, _REPLY)
    return by_chunk.cogroup(replies.union(wrong).groupBy("chunk")).applyInArrow(remove, result_ddl)
