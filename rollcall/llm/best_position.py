"""Ranked lexical search with the Best Position Algorithm over impact lists.

The documents' postings are written once as index shards (about
``SHARD_BYTES`` of text each) in the shared folder.  Corpus statistics come
from the shards; they give each query term its weight.  Each shard then answers
every item: a term's postings, ordered by impact, are its impact list.  Lists
are read from the top; a document met for the first time is completed by direct
accesses to the other lists, which also mark its positions there as seen.  The
best position of a list is the last one up to which all positions are seen; the
sum of the impacts there bounds every document not met yet, and the search ends
once that bound is strictly below the k-th score.  The k best of all shards are
the answer.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from rollcall.llm.common import schema_of, stored
from rollcall.llm.words import ALNUM

K = 20
SHARD_BYTES = 4 << 20      # text of a shard
PIECE = 1 << 20            # bytes of a text split at a time
SLICE_TERMS = 1 << 18      # item terms that are looked up in a shard together
SHARDS_PER_SALT = 64       # shards that one copy of a slice of items is joined to
SIEVE_BITS = 1 << 20       # size of the bit set of item terms
FIRST_DEPTH = 32           # positions read from each list in the first step; doubled in every further one

_INDEX = "shard long, n_docs long, n_terms long, doc_ids binary, lengths binary, terms binary, starts binary, docs binary, tfs binary"


def term_counts(text: str | None) -> Counter:
    """Occurrences of each term (UTF-8 bytes) in the whole text."""
    out: Counter = Counter()
    if not text:
        return out
    data = text.encode().translate(ALNUM)
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= PIECE else data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        out.update(data[at:end].split())
        at = end
    return out


def sieve_of(terms: DataFrame) -> bytes:
    """A bit set of fixed size that holds the hash of every ``term``; it thins postings and never decides a match."""
    bits = np.zeros(SIEVE_BITS, np.uint8)
    bits[[r[0] for r in terms.select(F.pmod(F.xxhash64("term"), F.lit(SIEVE_BITS))).distinct().collect()]] = 1
    return np.packbits(bits).tobytes()


class Sieve(dict):
    """Which terms the bit set lets through, looked up once per term."""

    def __init__(self, packed: bytes):
        super().__init__()
        self.bits = np.unpackbits(np.frombuffer(packed, np.uint8))

    def __missing__(self, term: bytes) -> bool:
        if len(self) >= SIEVE_BITS:
            self.clear()
        out = self[term] = bool(self.bits[xxhash.xxh64_intdigest(term, 42) % SIEVE_BITS])
        return out


class Shard:
    """Postings of some documents, sorted by term, then document; only of terms that pass the sieve."""

    def __init__(self, sieve: Sieve):
        self.sieve = sieve
        self.ids, self.lengths, self.bytes = [], [], 0
        self.vocabulary: dict[bytes, int] = {}
        self.term, self.doc, self.tf = [], [], []

    def add(self, doc_id: int, text: str | None) -> None:
        found = term_counts(text)
        if not found:
            return
        number, sieve = self.vocabulary, self.sieve
        kept = [(number.setdefault(t, len(number)), n) for t, n in found.items() if sieve[t]]
        term, tf = np.array(kept, np.int32).reshape(-1, 2).T
        self.term.append(term)
        self.doc.append(np.full(len(term), len(self.ids), np.int32))
        self.tf.append(tf)
        self.ids.append(doc_id)
        self.lengths.append(sum(found.values()))
        self.bytes += len(text)

    def row(self, number: int) -> tuple:
        words = sorted(self.vocabulary)
        rank = np.empty(len(words), np.int32)
        rank[np.array([self.vocabulary[w] for w in words], np.int64)] = np.arange(len(words), dtype=np.int32)
        term, doc, tf = rank[np.concatenate(self.term)], np.concatenate(self.doc), np.concatenate(self.tf)
        order = np.argsort(term, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(words)))])
        return (number, len(self.ids), sum(self.lengths), np.array(self.ids, "<i8").tobytes(),
                np.array(self.lengths, "<i8").tobytes(), b" ".join(words), starts.astype("<i8").tobytes(),
                doc[order].astype("<i4").tobytes(), tf[order].astype("<i4").tobytes())


def build_index(docs: DataFrame, sieve: bytes, id_col: str = "doc_id", text_col: str = "text",
                shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index shards of the terms that pass the sieve, written to the shared folder.

    Documents without a term are in none; those without an id are in shards
    with a negative number, which count in the statistics and are not searched.
    """
    schema = schema_of(_INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        arrow, first, made = to_arrow_schema(schema), TaskContext.get().partitionId() << 32, 0
        passing = Sieve(sieve)
        named, nameless = Shard(passing), Shard(passing)

        def closed(shard: Shard) -> pa.RecordBatch:
            row = shard.row(first + made if shard is named else -1 - first - made)
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, arrow)], schema=arrow)

        for batch in batches:
            for doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
                if doc_id is None:
                    nameless.add(0, text)
                else:
                    named.add(doc_id, text)
                if max(named.bytes, nameless.bytes) >= shard_bytes:
                    full = named if named.bytes >= shard_bytes else nameless
                    yield closed(full)
                    named, nameless, made = (
                        (Shard(passing), nameless, made + 1) if full is named else (named, Shard(passing), made + 1))
        for shard in (named, nameless):
            if shard.ids:
                yield closed(shard)

    return stored(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema))


def document_frequencies(index: DataFrame) -> DataFrame:
    """(term, df): documents of the index that hold each term."""
    schema = schema_of("term binary, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for terms, starts in zip(*(batch.column(i).to_pylist() for i in range(2))):
                if terms:
                    yield pa.RecordBatch.from_arrays([pa.array(terms.split(b" "), pa.binary()),
                                                      pa.array(np.diff(np.frombuffer(starts, "<i8")), pa.int64())], schema=arrow)

    return index.select("terms", "starts").mapInArrow(run, schema).groupBy("term").agg(F.sum("n").alias("df"))


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term, q): occurrences of each term in each item."""
    schema = schema_of("item long, term binary, q long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for item, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
                found = term_counts(text)
                if item is not None and found:
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array(list(found), pa.binary()),
                                                      pa.array(list(found.values()), pa.int64())], schema=arrow)

    return items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


class ImpactList:
    """One term's postings in a shard: by document, and by falling impact."""

    def __init__(self, docs: np.ndarray, impact: np.ndarray):
        self.docs, self.impact = docs, impact
        order = np.argsort(-impact, kind="stable")
        self.order = docs[order]
        self.falling = impact[order]
        self.position = np.empty(len(docs), np.int32)
        self.position[order] = np.arange(len(docs), dtype=np.int32)

    def direct(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``docs``, where in the list by document) for those the list holds."""
        at = np.searchsorted(self.docs, docs)
        at[at == len(self.docs)] = 0
        which = np.flatnonzero(self.docs[at] == docs)
        return which, at[which]


def best_positions(lists: list[ImpactList], factors: list[int], k: int, floor: int, n_docs: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, positions read per list) of at least the k best documents, ties of the k-th included.

    ``floor``: a score that k documents are known to reach elsewhere; what lies strictly below it may be left out.
    """
    score = np.zeros(n_docs, np.int64)
    met = np.zeros(n_docs, bool)
    seen = [np.zeros(len(x.docs) + 1, bool) for x in lists]     # the last entry stays False
    best = [0] * len(lists)                                     # positions known to be seen without a gap
    found: list[np.ndarray] = []
    depth, step, kth = 0, FIRST_DEPTH, floor
    longest = max(len(x.docs) for x in lists)
    while depth < longest:
        fresh = np.unique(np.concatenate([x.order[depth:depth + step] for x in lists]))
        fresh = fresh[~met[fresh]]
        met[fresh] = True
        for i, x in enumerate(lists):
            which, at = x.direct(fresh)
            score[fresh[which]] += factors[i] * x.impact[at]
            seen[i][x.position[at]] = True
        found.append(fresh)
        depth, step = depth + step, 2 * step
        bound = 0
        for i, x in enumerate(lists):
            best[i] += int(np.argmin(seen[i][best[i]:]))
            if best[i] < len(x.docs):
                bound += factors[i] * int(x.falling[best[i] - 1])
        known = np.concatenate(found)
        if len(known) >= k:
            kth = max(floor, int(np.partition(score[known], len(known) - k)[len(known) - k]))
            found = [known[score[known] >= kth]]
        if bound < kth:
            break
    known = np.concatenate(found)
    return known, score[known], depth


def _answers(k: int, n: int, total: int):
    """Group function: the k best documents of a shard for each of some items."""
    floors: dict[int, int] = {}     # per item: the k-th score in a shard that the task has done before

    def run(table: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        for row in table.to_pylist():
            lengths = np.frombuffer(row["lengths"], "<i8")
            m = 75 + np.array([25 * x * n // total for x in lengths.tolist()], np.int64)
            starts, docs = np.frombuffer(row["starts"], "<i8"), np.frombuffer(row["docs"], "<i4")
            tfs, ids = np.frombuffer(row["tfs"], "<i4").astype(np.int64), np.frombuffer(row["doc_ids"], "<i8")
            number = {t: i for i, t in enumerate(row["terms"].split(b" "))}
            made: dict[bytes, ImpactList | None] = {}

            def impact_list(term: bytes) -> ImpactList | None:
                if term not in made:
                    at = number.get(term)
                    if at is None:
                        made[term] = None
                    else:
                        d, tf = docs[starts[at]:starts[at + 1]], tfs[starts[at]:starts[at + 1]]
                        made[term] = ImpactList(d, 1_000_000_000 * tf // (1000 * tf + 12 * m[d]))
                return made[term]

            for asked in row["items"]:
                used = [(x, t["f"]) for t in asked["terms"] if (x := impact_list(bytes(t["term"]))) is not None]
                if not used:
                    continue
                floor = floors.get(asked["item"], 1)
                d, s, _ = best_positions([x for x, _ in used], [f for _, f in used], k, floor, len(ids))
                d, s = d[s >= floor], s[s >= floor]
                if len(d) > k:     # ties of the k-th are decided by the document's id
                    order = np.lexsort((ids[d], -s))[:k]
                    d, s = d[order], s[order]
                if len(d) == k:
                    floors[asked["item"]] = int(s.min())
                for part, values in zip(out, (np.full(len(d), asked["item"], np.int64), ids[d], s)):
                    part.append(values)
        return pa.table({name: np.concatenate(p) if p else np.empty(0, np.int64) for name, p in zip(("item", "doc", "score"), out)})
    return run


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 for each item.

    Terms are words of letters, digits and non-ASCII characters, only A-Z lower-cased.  Null and empty texts have
    no terms, and neither documents nor items without one are in the result, nor items without an id.
    Equal scores are ranked by id; repeated documents are documents of their own, rows of one item id are one item.
    Documents without an id count in the statistics and are not ranked.  An empty table gives no rows.
    Items are looked up in slices of about ``SLICE_TERMS`` terms, each sent to every shard, so neither
    table is ever whole in one task or on the driver.  Only the named columns are read.
    """
    wanted = stored(item_terms(items, item_col, item_text_col))
    index = build_index(docs, sieve_of(wanted), id_col, text_col, shard_bytes)
    n, total, shards = index.agg(F.sum("n_docs"), F.sum("n_terms"), F.count(F.lit(1))).first()
    slices = max(1, -(-wanted.count() // SLICE_TERMS))
    if not shards:
        n = total = 1
    weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1)))
    weighted = (wanted.join(document_frequencies(index), "term").withColumn("f", (F.col("q") * weight).cast("long"))
                .filter("f > 0"))
    packed = (weighted.groupBy("item").agg(F.collect_list(F.struct("term", "f")).alias("terms"))
              .withColumn("slice", F.pmod(F.xxhash64("item"), F.lit(slices)))
              .groupBy("slice").agg(F.collect_list(F.struct("item", "terms")).alias("items")))
    # every slice of items meets every shard: equal joins, the slices' rows dealt to ``salts`` keys
    salts = 1 + shards // SHARDS_PER_SALT
    pairs = (index.filter("shard >= 0").select("shard", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"),
                                               F.pmod(F.xxhash64("shard"), F.lit(salts)).alias("salt")))
    salted = packed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = index.drop("n_docs", "n_terms").join(pairs.join(salted, ["slice", "salt"]).drop("salt"), "shard")
    found = met.groupBy("shard", "slice").applyInArrow(_answers(k, int(n), int(total)), schema_of("item long, doc long, score long"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc")))
    return (ranked.filter(F.col("rank") <= k)
            .select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(id_col), "score"))
