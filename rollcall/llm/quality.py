"""Quality rules with thresholds learned per language and source.

Each document gets counts and integer signals.  The signals of every
(language, source) group are summarised in log-linear histogram sketches
(relative error 1/16, at most a few thousand buckets per signal): sketches merge
by adding bucket counts, so the same counts, merged further, give the language
and the corpus sketch that small groups fall back on, and results do not depend
on how rows are split over tasks.  Quartiles read from a sketch give the
group's thresholds (Tukey's outer fences), and a join with the thresholds
gives the verdicts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.common import cut, map_rows, null_safe, set_aside_names
from rollcall.llm.words import signed_hash

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
SIGNALS = ["word_len", "symbols", "dup_lines", "repeats"]   # per mille
TWO_SIDED = {"word_len"}
FENCE = 3.0          # quartile ranges beyond the quartile
SLACK = {"word_len": 400, "symbols": 50, "dup_lines": 150, "repeats": 100}   # least quartile range (fence unit)
MIN_GROUP = 200      # documents a group needs for thresholds of its own
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def count_text(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of one text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeat = 0
    if n >= 3:
        tri = list(zip(words, words[1:], words[2:]))
        if len(set(tri)) < len(tri):
            seen, upto = Counter(tri), 0
            for i, t in enumerate(tri):
                if seen[t] > 1:
                    repeat += i + 3 - max(i, upto)
                    upto = i + 3
    chars = len(text) - sum(map(text.count, SPACES))
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeat


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: id, lang, source, text_hash, base counts, base_failed and the signals (per mille)."""
    def make() -> Callable[..., tuple]:
        return lambda doc_id, lang, source, text: (doc_id, lang, source, None if text is None else signed_hash(text), *count_text(text))

    kind = dict(docs.dtypes)
    counted = map_rows(
        docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"),
                    F.col(source_col).alias("source"), F.col(text_col).alias("text")),
        make, f"doc_id {kind[id_col]}, lang {kind[lang_col]}, source {kind[source_col]}, text_hash long, n_words long, word_chars long, "
              "n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")

    def share(part: str, whole: str) -> Column:
        return F.expr(f"coalesce(1000L * {part} div nullif({whole}, 0), 0L)")

    return counted.select(
        "*",
        F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words").alias("base_failed"),
        share("word_chars", "n_words").alias("word_len"), share("n_symbols", "n_words").alias("symbols"),
        share("n_dup_lines", "n_lines").alias("dup_lines"), share("n_repeat_words", "n_words").alias("repeats"))


def bucket(value: Column) -> Column:
    """Sketch bucket of a non-negative integer: 5 leading bits and the shift; ordered like the values."""
    shift = F.greatest(F.length(F.bin(value)) - 5, F.lit(0))
    return (shift * 32 + F.floor(value / F.pow(F.lit(2), shift))).cast("int")


def bucket_low(b: Column) -> Column:
    """The smallest value of a bucket."""
    return (F.pow(F.lit(2), F.floor(b / 32)) * (b % 32)).cast("long")


def sketch(counts: DataFrame) -> DataFrame:
    """Mergeable sketches: (lang, source, signal, bucket, n) over the documents that pass the base rules."""
    signals = F.array(*[F.struct(F.lit(s).alias("signal"), bucket(F.col(s)).alias("bucket")) for s in SIGNALS])
    return (counts.filter(~F.col("base_failed")).select("lang", "source", F.inline(signals))
            .groupBy("lang", "source", "signal", "bucket").agg(F.count(F.lit(1)).alias("n")))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Merge sketches over ``keys`` and read the fences: one row per group with n_docs, and lo_/hi_ per signal."""
    merged = sketches.groupBy(*keys, "signal", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "signal")
    ranked = merged.select(*keys, "signal", bucket_low(F.col("bucket")).alias("v"),
                           F.sum("n").over(w.orderBy("bucket")).alias("below"), F.sum("n").over(w).alias("total"))

    def at(q: int) -> Column:
        return F.min(F.when(4 * F.col("below") >= q * F.col("total"), F.col("v")))

    per_signal = (ranked.groupBy(*keys, "signal")
                  .agg(F.first("total").alias("n_docs"), at(1).alias("q1"), at(3).alias("q3")))
    aggs = [F.max("n_docs").alias("n_docs")]
    for s in SIGNALS:
        mine = F.col("signal") == s
        reach = F.lit(FENCE) * F.greatest(F.col("q3") - F.col("q1"), F.lit(SLACK[s]))
        aggs.append(F.max(F.when(mine, F.col("q3") + reach)).alias(f"hi_{s}"))
        if s in TWO_SIDED:
            aggs.append(F.max(F.when(mine, F.col("q1") - reach)).alias(f"lo_{s}"))
    return per_signal.groupBy(*keys).agg(*aggs)


def thresholds(sketches: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Fences of every (lang, source); groups under min_group documents use the language's, then the corpus's."""
    names = [f"hi_{s}" for s in SIGNALS] + [f"lo_{s}" for s in SIGNALS if s in TWO_SIDED]
    fences = F.struct(*names)
    sketches = cut(sketches)
    own = quartiles(sketches, ["lang", "source"]).select("lang", "source", F.col("n_docs").alias("n_own"), fences.alias("own"))
    by_lang = quartiles(sketches, ["lang"]).select(F.col("lang").alias("of_lang"), F.col("n_docs").alias("n_lang"),
                                                   fences.alias("by_lang"))
    corpus = quartiles(sketches, []).select(fences.alias("corpus")).scalar()
    joined = own.join(by_lang, own.lang.eqNullSafe(by_lang.of_lang), "left")
    chosen = (F.when(F.col("n_own") >= min_group, F.col("own")).when(F.col("n_lang") >= min_group, F.col("by_lang"))
              .otherwise(corpus))
    return joined.select("lang", "source", chosen.alias("f")).select("lang", "source", "f.*")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  source_col: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """Verdict per document: doc_id, lang, source, counts, base_failed, signals, kept.

    kept is false when the base rules fail or a signal lies beyond its group's
    fence.  Null or empty text counts nothing and fails the base rules; null
    languages and sources form groups of their own; repeated rows are judged
    each (and counted each); an empty table gives no rows.
    """
    counts = cut(document_counts(docs, id_col, text_col, lang_col, source_col))
    limits = thresholds(sketch(counts), min_group)
    joined = counts.join(limits, null_safe(counts, limits, ["lang", "source"]), "left")
    fits = F.lit(True)
    for s in SIGNALS:
        fits = fits & (F.col(s) <= F.col(f"hi_{s}"))
        if s in TWO_SIDED:
            fits = fits & (F.col(s) >= F.col(f"lo_{s}"))
    return joined.select(*[counts[c] for c in counts.columns],
                         (~F.col("base_failed") & F.coalesce(fits, F.lit(False))).alias("kept"))


def good_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                   source_col: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of ``docs`` (all columns, whatever their names and types) that the rules keep."""
    docs, name, named = set_aside_names(docs)
    id_col, text_col, lang_col, source_col = map(name, (id_col, text_col, lang_col, source_col))
    bad = (quality_rules(docs, id_col, text_col, lang_col, source_col, min_group).filter(~F.col("kept"))
           .select(*[F.col(c).alias(f"__{c}") for c in ("doc_id", "lang", "source", "text_hash")]).distinct())
    text_hash = F.when(F.col(text_col).isNotNull(), F.xxhash64(text_col))
    same = (F.col(id_col).eqNullSafe(F.col("__doc_id")) & text_hash.eqNullSafe(F.col("__text_hash"))
            & F.col(lang_col).eqNullSafe(F.col("__lang")) & F.col(source_col).eqNullSafe(F.col("__source")))
    return named(docs.join(bad, same, "left_anti"))
