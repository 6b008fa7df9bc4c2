"""Language identification by multilingual mixture inference.

A document is a mixture of languages: every n-gram of its letters is drawn from
one of them.  Spark counts the n-grams of the training documents per language;
the counts give smoothed n-gram probabilities.  For each document,
expectation-maximisation estimates the proportions of a set of languages, and
the set itself is chosen by penalised likelihood: from the likeliest single
language, languages are added while the gain in log-likelihood exceeds the cost
of one more proportion.

An n-gram is three neighbouring bytes of the lower-cased text in UTF-8, every
run of ASCII characters that are no letters being one blank.  N-grams are
hashed to ``BUCKETS`` buckets, so the model has a fixed size per language, and
neighbouring n-grams overlap, so each counts ``1 / GRAM`` of a draw.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from rollcall.llm.common import map_rows, schema_of

GRAM = 3
BUCKETS = 1 << 15
SMOOTHING = 0.5
PENALTY = 2.0        # cost of a further language, in units of 0.5 * ln(draws)
STEPS = 60           # expectation-maximisation steps, at most
SETTLED = 1e-4       # largest change of a proportion at which the steps end
PIECE = 1 << 22      # bytes of a text looked at together
FOLDS = 5
UNKNOWN = "und"

# bytes of the lower-cased text: letters a-z and all non-ASCII stay, the rest is a blank
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def gram_counts(text: str | None) -> np.ndarray | None:
    """Occurrences per bucket in the whole text; None if it has no letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    out, tail = np.zeros(BUCKETS, np.int64), b" "
    for at in range(0, len(text), PIECE):
        raw = text[at:at + PIECE].lower().encode().translate(_LETTERS)
        words = b" ".join(raw.split())
        gap = b" " if words and raw[:1] == b" " and tail[-1:] != b" " else b""
        end = b" " if raw[-1:] == b" " or at + PIECE >= len(text) else b""
        raw = tail + gap + words + (end if words or tail[-1:] != b" " else b"")
        tail = raw[1 - GRAM:]   # the next piece's n-grams begin here, so that cuts change nothing
        b = np.frombuffer(raw, np.uint8).astype(np.uint32)
        if len(b) >= GRAM:
            code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
            out += np.bincount((code * np.uint32(2654435769)) >> np.uint32(17), minlength=BUCKETS)
    return out if out.any() else None


def count_grams(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, bucket, n) over all given documents; each task adds up its own documents first."""
    schema = schema_of("lang string, bucket int, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, sums = to_arrow_schema(schema), {}
        for batch in batches:
            for text, lang in zip(*(batch.column(i).to_pylist() for i in range(2))):
                found = gram_counts(text)
                if found is not None:
                    if lang in sums:
                        sums[lang] += found
                    else:
                        sums[lang] = found
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()),
                                              pa.array(n[at], pa.int64())], schema=arrow)

    parts = docs.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")).mapInArrow(run, schema)
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def model_of(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages in order, and a row of BUCKETS probabilities for each (at most BUCKETS counts a language)."""
    rows = (counts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("c"))
            .select("lang", F.col("c.bucket").alias("bucket"), F.col("c.n").alias("n")).orderBy("lang").collect())
    table = np.zeros((len(rows), BUCKETS))
    for k, r in enumerate(rows):
        table[k, r.bucket] = r.n
    table += SMOOTHING
    return [r.lang for r in rows], table / table.sum(axis=1, keepdims=True)


def proportions(p: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Expectation-maximisation: the likeliest proportions of the rows of ``p``, and the log-likelihood.

    ``p[l, g]`` is the probability of n-gram g in language l, ``weight`` how often g counts.
    """
    total = weight.sum()
    share = np.full(len(p), 1.0 / len(p))
    mixed = share @ p
    if len(p) > 1:
        for _ in range(STEPS):
            new = share * (p @ (weight / mixed)) / total
            done = np.abs(new - share).max() < SETTLED
            share = new
            mixed = share @ p
            if done:
                break
    return share, float(weight @ np.log(mixed))


def infer(p: np.ndarray, weight: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(languages, proportions) of a document: the set that no single further language improves.

    The log-likelihood is concave in the proportions, so its slope towards a
    language bounds what that language can add: where the slope is not above
    the cost, the steps are spared.
    """
    single = np.log(p) @ weight
    chosen = [int(np.argmax(single))]
    share, best = np.ones(1), float(single[chosen[0]])
    cost = PENALTY * 0.5 * np.log(max(weight.sum(), 1.0)) + 1e-9
    while len(chosen) < len(p):
        slope = p @ (weight / (share @ p[chosen])) - weight.sum()
        found = None
        for extra in np.flatnonzero(slope > cost):
            if extra in chosen:
                continue
            s, value = proportions(p[chosen + [int(extra)]], weight)
            if value > best + cost and (found is None or value > found[0]):
                found = value, s, int(extra)
        if found is None:
            break
        best, share, chosen = found[0], found[1], chosen + [found[2]]
    return chosen, share


def identify(docs: DataFrame, langs: list[str], table: np.ndarray, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, mixture (map of language to proportion) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, table))

    def make() -> Callable[..., tuple]:
        names, p = shared.value

        def predict(doc_id: object, text: str | None) -> tuple:
            n = gram_counts(text) if names else None
            if n is None:
                return doc_id, UNKNOWN, 0.0, []
            at = np.flatnonzero(n)
            chosen, share = infer(p[:, at], n[at] / GRAM)
            order = sorted(zip(share.tolist(), chosen), key=lambda x: (-x[0], names[x[1]]))
            return doc_id, names[order[0][1]], min(1.0, order[0][0]), [(names[k], s) for s, k in order]

        return predict

    kind = dict(docs.dtypes)[id_col]
    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), make,
                    f"doc_id {kind}, lang_pred string, score double, mixture map<string,double>")


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       folds: int = FOLDS, held_out_fold: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score, mixture: languages learned from the labelled documents of the other folds.

    A document is held out if crc32(id as text) mod ``folds`` is ``held_out_fold`` (a null id counts as empty text).
    Null and empty texts and texts without a letter are ``und`` with score 0, and so is every text if nothing was
    learned (no labelled document with a letter, an empty table).  Languages of equal proportion: the first in
    order of their names.  Whole texts are counted, however long, 4 MB at a time.  Repeated rows are training
    documents and answers of their own.  Only the named columns are read.
    """
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds
    held_out = fold == held_out_fold
    langs, table = model_of(count_grams(docs.filter(~held_out & F.col(lang_col).isNotNull()), text_col, lang_col))
    found = identify(docs, langs, table, id_col, text_col)
    again = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == held_out_fold
    return found.select("doc_id", again.alias("held_out"), "lang_pred", "score", "mixture")
