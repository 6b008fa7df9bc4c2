"""Language-model scoring with a sharded Elias-Fano n-gram trie.

The model is an interpolated bigram model with absolute discounting over all
training documents.  Documents are dealt to chunks.  Each chunk sends its
distinct words with training counts to the words' shards, which add them up and
answer the corpus counts and a number per word; then it sends its distinct
(context, successor) pairs to the contexts' shards.  A shard merges the counts,
builds its part of the trie (monotone pointers, quantised discounted
probabilities and interpolation weights, memory-mapped) and answers the pairs
by successor search within the context.  The chunk then scores its documents.
All steps are shuffles of one plan which share one shuffle of the documents;
what is sent grows with the corpus' distinct words and pairs per chunk, and a
frequent word is one entry per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from rollcall.llm.common import pieces, schema_of
from rollcall.llm.elias_fano import Trie
from rollcall.llm.words import LOWER_SPACED, hashed

DISCOUNT = 0.75
CHUNK_BYTES = 4 << 20       # text of a chunk
CHUNKS_PER_SHARD = 16       # at least; more while shards are few
LEAST_SHARDS = 256          # so that a word hash div shards fits 7 bytes
END = np.uint64(0x656E64)   # stands for the end token in word hashes
START, UNKNOWN = 0, (1 << 32) - 1   # context number of a text's start; number of words without training count
STEPS = 5000.0              # codes per decade
ZERO = 65535                # code of probability zero

_SENT = "shard int, chunk long, a binary, b binary, c binary, d binary"
_REPLY = "chunk long, kind int, shard int, a binary, b binary"


def quantise(p: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities: -log10 in steps of 1 / STEPS."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.rint(-np.log10(p) * STEPS), 0, ZERO - 1), ZERO).astype(np.uint16)


def dequantise(code: np.ndarray) -> np.ndarray:
    return np.where(code == ZERO, 0.0, 10.0 ** (-code.astype(np.float64) / STEPS))


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers by byte planes: the high planes of small numbers compress well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


class Chunk:
    """Tokens of one chunk's documents: the words of each text and one end token."""

    def __init__(self, docs: pa.Table, shards: int):
        words = hashed(docs.column("text").to_pylist(), LOWER_SPACED)
        sizes = np.diff(words.first) + 1
        self.ends = np.cumsum(sizes)
        self.sizes = sizes
        token = np.empty(int(sizes.sum()), np.uint64)
        is_end = np.zeros(len(token), bool)
        is_end[self.ends - 1] = True
        token[is_end], token[~is_end] = END, words.hashes
        self.is_start = np.zeros(len(token), bool)
        self.is_start[self.ends - sizes] = True
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        held = docs.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        self.train = ~held[self.doc]
        self.words, self.word = np.unique(token, return_inverse=True)
        n = np.uint64(shards)
        self.shards, self.order = shards, np.lexsort((self.words // n, self.words % n))
        self.bounds = np.searchsorted((self.words % n)[self.order], np.arange(shards + 1).astype(np.uint64))

    def word_rows(self) -> Iterator[tuple[int, bytes, bytes]]:
        q = (self.words[self.order] // np.uint64(self.shards)).astype("<u8")
        packed = np.ascontiguousarray(q.view(np.uint8).reshape(-1, 8)[:, :7])
        counts = np.bincount(self.word[self.train], minlength=len(self.words))[self.order]
        for s in np.flatnonzero(np.diff(self.bounds)).tolist():
            a, b = self.bounds[s], self.bounds[s + 1]
            yield s, packed[a:b].tobytes(), planes(counts[a:b])

    def take_words(self, replies: pa.Table) -> None:
        """Read the corpus count and number of each distinct word."""
        self.count, self.number = np.zeros(len(self.words), np.int64), np.full(len(self.words), UNKNOWN, np.int64)
        for kind, s, a, b in zip(*(replies.column(c).to_pylist() for c in ("kind", "shard", "a", "b"))):
            if kind == 1:
                mine = self.order[self.bounds[s]:self.bounds[s + 1]]
                self.number[mine], self.count[mine] = unplanes(a), np.frombuffer(b, "<i8")

    def pairs(self) -> None:
        """Distinct (context, successor) pairs of known contexts by context shard, and each token's pair."""
        number = self.number[self.word]
        context = np.empty_like(number)
        context[1:] = number[:-1]
        context[self.is_start] = START
        key = (context.astype(np.uint64) << np.uint64(32)) | number.astype(np.uint64)
        self.pair, self.of_token = np.unique(key, return_inverse=True)
        self.pair_count = np.bincount(self.of_token[self.train], minlength=len(self.pair))
        self.pair_context = (self.pair >> np.uint64(32)).astype(np.int64)
        self.pair_shard = np.where(self.pair_context == UNKNOWN, -1, self.pair_context % self.shards)
        self.pair_order = np.lexsort((self.pair, self.pair_shard))
        self.pair_bounds = np.searchsorted(self.pair_shard[self.pair_order], np.arange(self.shards + 1))

    def pair_rows(self) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
        """(shard, contexts, list lengths, successors, training counts)."""
        for s in np.flatnonzero(np.diff(self.pair_bounds)).tolist():
            mine = self.pair_order[self.pair_bounds[s]:self.pair_bounds[s + 1]]
            context = self.pair_context[mine]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(context)) + 1])
            yield (s, planes(context[starts]), planes(np.diff(np.concatenate([starts, [len(mine)]]))),
                   planes(self.pair[mine] & np.uint64(0xFFFFFFFF)), planes(self.pair_count[mine]))

    def scores(self, replies: pa.Table, n: int, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per document: known tokens, sum of log10(c + 0.5), model score."""
        weight, prob = np.ones(len(self.pair)), np.zeros(len(self.pair))
        for kind, s, a, b in zip(*(replies.column(c).to_pylist() for c in ("kind", "shard", "a", "b"))):
            if kind == 2:
                mine = self.pair_order[self.pair_bounds[s]:self.pair_bounds[s + 1]]
                weight[mine], prob[mine] = dequantise(np.frombuffer(a, "<u2")), dequantise(np.frombuffer(b, "<u2"))
        c = self.count[self.word].astype(np.float64)
        unigram = (np.maximum(c - DISCOUNT, 0.0) + DISCOUNT * v / (v + 1)) / n if n else np.ones(len(c))
        p = prob[self.of_token] + weight[self.of_token] * unigram
        docs = len(self.sizes)
        return (np.bincount(self.doc, c > 0, docs), np.bincount(self.doc, np.log10(c + 0.5), docs),
                np.bincount(self.doc, np.log10(p), docs))


def _count_words(table: pa.Table, shard: int, shards: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Per chunk: (chunk, numbers, corpus counts) of its words; and (-1, tokens, distinct words) of the shard."""
    chunks, blobs = table.column("chunk").to_pylist(), table.column("a").to_pylist()
    sizes = np.array([len(b) // 7 for b in blobs])
    raw = np.zeros((int(sizes.sum()), 8), np.uint8)
    raw[:, :7] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 7)
    counts = np.concatenate([unplanes(b) for b in table.column("b").to_pylist()]).astype(np.int64)
    words, word = np.unique(raw.view("<u8").reshape(-1), return_inverse=True)
    total = np.bincount(word, counts, len(words)).astype(np.int64)
    rank = np.cumsum(total > 0) - 1
    if len(words) and (int(rank[-1]) + 1) * shards + 1 >= UNKNOWN:
        raise ValueError("more distinct words than 32-bit numbers")
    number = np.where(total > 0, 1 + shard + shards * rank, UNKNOWN)
    ends = np.cumsum(sizes)
    for c, a, b in zip(chunks, ends - sizes, ends):
        yield c, planes(number[word[a:b]]), total[word[a:b]].astype("<i8").tobytes()
    yield -1, int(total.sum()).to_bytes(8, "little"), int((total > 0).sum()).to_bytes(8, "little")


def build_trie(pair: np.ndarray, count: np.ndarray) -> Trie:
    """The trie of ascending distinct pairs (context << 32 | successor); pairs without training count are left out."""
    pair, count = pair[count > 0], count[count > 0]
    context = (pair >> np.uint64(32)).astype(np.int64)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(context)) + 1]) if len(pair) else np.zeros(0, np.int64)
    bounds = np.concatenate([starts, [len(pair)]]).astype(np.int64)
    sizes = np.diff(bounds)
    total = np.add.reduceat(count, starts) if len(pair) else np.zeros(0)
    return Trie(context[starts], bounds, (pair & np.uint64(0xFFFFFFFF)), quantise(DISCOUNT * sizes / total if len(pair) else total),
                quantise((count - DISCOUNT) / np.repeat(total, sizes) if len(pair) else count))


def query_trie(trie: Trie, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the context's interpolation weight and of the discounted probability of ascending distinct pairs."""
    context = pair >> np.uint64(32)
    heads = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    at = np.repeat(trie.context(context[heads]), np.diff(np.concatenate([heads, [len(pair)]])))
    weight, prob = np.zeros(len(at), "<u2"), np.full(len(at), ZERO, "<u2")
    seen = np.flatnonzero(at >= 0)
    if len(seen):
        weight[seen] = trie.context_codes[at[seen]]
        found = trie.successor(at[seen], pair[seen] & np.uint64(0xFFFFFFFF))
        hit = found >= 0
        prob[seen[hit]] = trie.successor_codes[found[hit]]
    return weight, prob


def _answer_pairs(table: pa.Table) -> Iterator[tuple[int, bytes, bytes]]:
    """Per chunk: codes of the interpolation weight and of the discounted probability of each of its pairs."""
    chunks = table.column("chunk").to_pylist()
    lengths = [unplanes(x) for x in table.column("b").to_pylist()]
    context = np.concatenate([np.repeat(unplanes(x), n) for x, n in zip(table.column("a").to_pylist(), lengths)])
    successor = np.concatenate([unplanes(x) for x in table.column("c").to_pylist()])
    counts = np.concatenate([unplanes(x) for x in table.column("d").to_pylist()])
    pair, at = np.unique((context.astype(np.uint64) << np.uint64(32)) | successor.astype(np.uint64), return_inverse=True)
    weight, prob = query_trie(build_trie(pair, np.bincount(at, counts, len(pair))), pair)
    ends = np.cumsum([int(n.sum()) for n in lengths])
    for c, a, b in zip(chunks, np.concatenate([[0], ends[:-1]]), ends):
        yield c, weight[at[a:b]].tobytes(), prob[at[a:b]].tobytes()


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1,
                    chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document row.

    The model learns from the documents whose crc32(id as text) mod ``folds`` is
    not ``held_fold``; a null id counts as the empty text.  Tokens are the
    lower-cased words and one end per text, so null and empty texts have one
    token.  ``score`` is the model's log10 probability of the text, ``base_score``
    that of an add-half unigram model.  Repeated rows count and are scored each.
    Without training documents every word is unknown.  ``chunk_bytes`` (text
    per chunk, held by one task) changes no result.
    """
    chunks = pieces(docs, text_col, chunk_bytes)
    shards = max(LEAST_SHARDS, chunks // CHUNKS_PER_SHARD)
    kind = dict(docs.dtypes)[id_col]
    result = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_sum double, vocabulary long, score double"
    arrow = {ddl: to_arrow_schema(schema_of(ddl)) for ddl in (_SENT, _REPLY, result)}
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds
    dealt = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (fold == held_fold).alias("held_out"),
                        F.pmod(F.xxhash64(id_col, text_col), F.lit(chunks)).alias("chunk"))
    by_chunk = dealt.groupBy("chunk")

    def batch(rows: list[tuple], ddl: str) -> pa.Table:
        schema = arrow[ddl]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else
                                    [pa.array([], f.type) for f in schema], schema=schema)

    def send_words(key: tuple, table: pa.Table) -> pa.Table:
        return batch([(s, key[0].as_py(), a, b, b"", b"") for s, a, b in Chunk(table, shards).word_rows()], _SENT)

    def count_words(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        return batch([(c, 1 if c >= 0 else 0, shard, a, b) for c, a, b in _count_words(table, shard, shards)], _REPLY)

    def send_pairs(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return batch([], _SENT)
        chunk = Chunk(table, shards)
        chunk.take_words(replies)
        chunk.pairs()
        return batch([(s, key[0].as_py(), *row) for s, *row in chunk.pair_rows()], _SENT)

    def answer_pairs(key: tuple, table: pa.Table) -> pa.Table:
        return batch([(c, 2, key[0].as_py(), a, b) for c, a, b in _answer_pairs(table)], _REPLY)

    def score(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return batch([], result)
        total, vocabulary = (replies.column(c)[0].as_py() for c in ("tokens", "vocabulary"))
        chunk = Chunk(table, shards)
        chunk.take_words(replies)
        chunk.pairs()
        known, base, model = chunk.scores(replies, total, vocabulary)
        return batch(list(zip(table.column("doc_id").to_pylist(), table.column("held_out").to_pylist(), chunk.sizes.tolist(),
                              known.astype(np.int64).tolist(), [total] * len(known), base.tolist(),
                              [vocabulary] * len(known), model.tolist())), result)

    answers = by_chunk.applyInArrow(send_words, _SENT).groupBy("shard").applyInArrow(count_words, _REPLY)

    sizes = answers.filter("kind = 0").select(*[
        F.sum(F.expr(f"cast(conv(array_join(reverse(transform(sequence(1, 8), i -> substr(hex({c}), 2 * i - 1, 2))), ''), 16, 10) as long)"))
        .alias(name) for c, name in (("a", "tokens"), ("b", "vocabulary"))])
    words = answers.filter("kind = 1")
    pairs = (by_chunk.cogroup(words.groupBy("chunk")).applyInArrow(send_pairs, _SENT)
             .groupBy("shard").applyInArrow(answer_pairs, _REPLY))
    replies = words.union(pairs).withColumn("sizes", sizes.select(F.struct("tokens", "vocabulary")).scalar()).select(
        "chunk", "kind", "shard", "a", "b", "sizes.tokens", "sizes.vocabulary")
    scored = by_chunk.cogroup(replies.groupBy("chunk")).applyInArrow(score, result)
    base = F.col("base_sum") - F.col("n_tokens") * F.log10(F.col("train_tokens") + F.lit(0.5) * (F.col("vocabulary") + 1))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", base.alias("base_score"), "score")
