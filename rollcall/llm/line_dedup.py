"""Line deduplication over content-defined chunks of lines, in DataFrame functions only.

A rolling hash over the hashes of two neighbouring lines decides where a chunk
ends, so chunk boundaries move with the content and shared passages are cut
alike wherever they stand.  Chunks of several lines that occur more than once
in the corpus are found by grouping on their bytes; every occurrence but the
first is removed.

Chunks leave the ends of a shared passage, which are cut differently in other
surroundings.  ``dedup_passages`` therefore extends them line by line: outside the removed chunks it looks up
every pair of neighbouring non-blank lines (with the blank lines between), too.
Every repeated run of two or more non-blank lines is a run of such pairs, and a line goes
only if no pair that is kept here for the other places holds it, so every repeated passage survives in one place.

A line is blank if it has no character but blanks (U+0020, U+0009 to U+000D).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import cut, set_aside_names, stored

SPACING = 3      # a chunk ends after a line with this probability's inverse


_BLANKS = " \t\n\x0b\x0c\r"


def _has_text(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS)) != ""


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def with_chunks(docs: DataFrame, text: Column, spacing: int = SPACING, with_bytes: bool = False) -> DataFrame:
    """Adds __lines and __chunks: array of (first, n, digest, multi[, bytes]), first counted from 1.

    No lambda refers to an array that is itself computed per row here: Spark
    would inline it and compute it again for every element.
    """
    hashed = (docs.withColumn("__lines", F.split(F.coalesce(text, F.lit("")), "\n"))
              .withColumn("__hash", F.transform("__lines", _line_hash)))
    at_end = F.zip_with(                                             # line number where the rolling hash ends a chunk
        F.zip_with("__hash", F.expr("concat(array(cast(null as long)), slice(__hash, 1, size(__hash) - 1))"),
                   lambda line, before: (before * 31 + line) % spacing == 0),
        F.expr("sequence(1, size(__hash))"), lambda ends, i: F.when(ends, i))
    cuts = hashed.withColumn("__cuts", F.filter(at_end, lambda i: i.isNotNull())).withColumn(
        "__last", F.expr("array_distinct(concat(__cuts, array(size(__lines))))"))
    spans = cuts.withColumn("__first", F.expr("concat(array(1), transform(slice(__last, 1, size(__last) - 1), x -> x + 1))"))

    def chunk(first: Column, last: Column) -> Column:
        lines = F.slice("__lines", first, last - first + 1)
        content = F.array_join(lines, "\n")
        fields = [first.alias("first"), (last - first + 1).alias("n"), F.md5(content).alias("digest"),
                  (F.size(F.filter(lines, _has_text)) > 1).alias("multi")]
        return F.struct(*fields, *([content.alias("bytes")] if with_bytes else []))

    return spans.withColumn("__chunks", F.zip_with("__first", "__last", chunk)).drop("__hash", "__cuts", "__last", "__first")


def repeated_chunks(docs: DataFrame, id_col: str, text_col: str, spacing: int = SPACING) -> DataFrame:
    """(digest, first_id): chunks of several lines that occur more than once, compared byte by byte."""
    rows = (with_chunks(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("place"), F.col(text_col).alias("text")),
                        F.col("text"), spacing, True)
            .select("id", "place", F.inline(F.filter("__chunks", lambda c: c["multi"]))))
    place = F.xxhash64("id", "place", "first")      # equal rows of one id are one place
    same = rows.groupBy("digest", "bytes").agg((F.min(place) != F.max(place)).alias("several"), F.min("id").alias("first_id"))
    return (same.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("several").alias("several"), F.min("first_id").alias("first_id"))
            .filter("texts = 1 and several").select("digest", "first_id"))   # a digest of two texts decides nothing


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spacing: int = SPACING) -> DataFrame:
    """``docs`` (all columns) with repeated chunks removed from the text, plus __n_lines and __n_removed.

    A repeated chunk stays in the document with the smallest id (there at its
    first place; rows that share this id all keep it; rows without an id keep
    it only if no row with an id has it).  Null texts stay null, empty texts
    empty; chunks with fewer than two non-blank lines are never removed.
    """
    names = docs.columns
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])   # no name of the caller's can clash with ours
    id_col, text_col = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    repeated = cut(repeated_chunks(docs, id_col, text_col, spacing))
    key = [F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__text")]
    places = (with_chunks(docs.select(*key, F.col(text_col).alias("text")), F.col("text"), spacing)
              .select("__id", "__text", F.posexplode("__chunks").alias("at", "c")).filter("c.multi")
              .select("__id", "__text", "at", "c.digest"))
    here = (places.join(repeated, "digest").groupBy("__id", "__text", "digest", "first_id")
            .agg(F.sort_array(F.collect_set("at")).alias("at")))
    is_first = F.coalesce(F.col("__id").eqNullSafe(F.col("first_id")), F.lit(False))
    gone = (here.select("__id", "__text", F.when(is_first, F.expr("slice(at, 2, size(at))")).otherwise(F.col("at")).alias("at"))
            .groupBy("__id", "__text").agg(F.flatten(F.collect_list("at")).alias("__gone")).filter("size(__gone) > 0"))
    joined = docs.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__text")), "left")
    seen = with_chunks(joined, F.col(text_col), spacing)
    kept = seen.withColumn("__kept", F.filter("__chunks", lambda c, i: F.col("__gone").isNull() | ~F.array_contains("__gone", i)))
    n_kept = F.aggregate("__kept", F.lit(0), lambda acc, c: acc + c["n"])
    new = F.array_join(F.flatten(F.transform("__kept", lambda c: F.slice("__lines", c["first"], c["n"]))), "\n")
    columns = [(F.when(F.col(c).isNotNull(), new) if c == text_col else F.col(c)).alias(name)
               for c, name in zip(docs.columns, names)]
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size("__lines"))
    return kept.select(*columns, n_lines.cast("long").alias("__n_lines"),
                       F.when(F.col(text_col).isNull(), 0).otherwise(F.size("__lines") - n_kept).cast("long").alias("__n_removed"))


def line_pairs(chunked: DataFrame) -> DataFrame:
    """Adds __pairs to rows of :func:`with_chunks`: array of (first, last, chunk, digest) per pair of neighbouring non-blank lines.

    chunk is the first line of the chunk that holds the whole pair, null at a
    chunk's end; the digest is the SHA-256 of the bytes from first to last.
    """
    numbered = (chunked.withColumn("__chunk_of", F.expr("flatten(transform(__chunks, c -> array_repeat(c.first, c.n)))"))
                .withColumn("__at", F.filter(F.transform("__lines", lambda x, i: F.when(_has_text(x), i + 1)), lambda i: i.isNotNull())))

    def pair(first: Column, last: Column) -> Column:
        a, b = F.element_at("__chunk_of", first), F.element_at("__chunk_of", last)
        content = F.array_join(F.slice("__lines", first, last - first + 1), "\n")
        return F.struct(first.alias("first"), last.alias("last"), F.when(a == b, a).alias("chunk"),
                        F.unhex(F.sha2(content, 256)).alias("digest"))

    fewer = "greatest(size(__at) - 1, 0)"
    return numbered.withColumn("__pairs", F.zip_with(F.expr(f"slice(__at, 1, {fewer})"), F.expr(f"slice(__at, 2, {fewer})"), pair)
                               ).drop("__chunk_of", "__at")


def _places(places: DataFrame, repeated: DataFrame) -> DataFrame:
    """(__id, __text, kept, later): of each repeated digest in a text, the place that stays (if it is this text's) and the others."""
    here = (places.join(repeated, "digest").groupBy("__id", "__text", "digest", "first_id")
            .agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("at")))
    is_first = F.coalesce(F.col("__id").eqNullSafe(F.col("first_id")), F.lit(False))
    return here.select("__id", "__text", F.when(is_first, F.col("at")[0]).alias("kept"),
                       F.when(is_first, F.expr("slice(at, 2, size(at))")).otherwise(F.col("at")).alias("later"))


def _lines_of(places: str) -> Column:
    return F.expr(f"flatten(transform({places}, p -> sequence(p.first, p.last)))")


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spacing: int = SPACING) -> DataFrame:
    """``docs`` (all columns) without any repeated run of two or more non-blank lines, plus __n_lines and __n_removed.

    A repeated pair of lines stays where :func:`dedup_lines` keeps a repeated chunk: in
    the document with the smallest id, there at its first place (rows that share
    the id all keep it; rows without an id only if no row with an id has it).  All other places of it
    go, but no line of a pair that stays.  Chunks are compared byte by byte, pairs by the SHA-256 of their bytes.
    Null texts stay null.
    """
    names = docs.columns
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])   # no name of the caller's can clash with ours
    id_col, text_col = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    chunked = with_chunks(docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__text"), F.col(text_col).alias("text")),
                          F.col("text"), spacing)
    chunks = (chunked.select("__id", "__text", F.inline(F.filter("__chunks", lambda c: c["multi"])))
              .select("__id", "__text", "digest", "first", (F.col("first") + F.col("n") - 1).alias("last")))
    whole = cut(_places(chunks, cut(repeated_chunks(docs, id_col, text_col, spacing))))
    # the outer form: no filter on the array's size is inferred, which would be pushed down and compute it per element
    pairs = line_pairs(chunked).select("__id", "__text", F.inline_outer("__pairs")).filter("digest is not null")
    of = [F.col("__id").alias("of_id"), F.col("__text").alias("of_text")]
    marked = (whole.select(*of, F.explode("later.first").alias("of_chunk"), F.lit(True).alias("gone"))
              .union(whole.filter("kept is not null").select(*of, "kept.first", F.lit(False))).distinct())
    inside = F.col("__id").eqNullSafe(F.col("of_id")) & (F.col("__text") == F.col("of_text")) & (F.col("chunk") == F.col("of_chunk"))
    # a pair in a removed chunk stands in the chunk's kept copy, too, so it is looked up there
    rest = stored(pairs.join(marked, inside, "left").filter("gone is null or not gone")
                  .select("__id", "__text", "first", "last", "digest", F.col("gone").isNotNull().alias("in_kept")))
    place = F.xxhash64("__id", "__text", "first")
    repeated = (rest.groupBy("digest").agg((F.min(place) != F.max(place)).alias("several"), F.max("in_kept").alias("in_kept"),
                                           F.min("__id").alias("first_id"))
                .filter("several or in_kept").select("digest", "first_id"))
    nothing = F.array().cast("array<int>")
    lines = whole.select("__id", "__text", _lines_of("later").alias("lines"), nothing.alias("stays")).union(
        _places(rest, cut(repeated)).select("__id", "__text", _lines_of("later"), F.coalesce(
            F.expr("sequence(kept.first, kept.last)"), nothing)))
    gone = (lines.groupBy("__id", "__text").agg(F.array_except(F.flatten(F.collect_list("lines")), F.flatten(F.collect_list("stays"))).alias("__gone"))
            .filter("size(__gone) > 0"))
    joined = docs.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__text")), "left")
    kept = (joined.withColumn("__lines", F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))
            .withColumn("__kept", F.expr("array_except(sequence(1, size(__lines)), coalesce(__gone, cast(array() as array<int>)))")))
    new = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(
        F.array_join(F.transform("__kept", lambda i: F.element_at("__lines", i)), "\n"))
    columns = [(F.when(F.col(c).isNotNull(), new) if c == text_col else F.col(c)).alias(name)
               for c, name in zip(docs.columns, names)]
    return kept.select(*columns, F.when(F.col(text_col).isNull(), 0).otherwise(F.size("__lines")).cast("long").alias("__n_lines"),
                       (F.size("__lines") - F.size("__kept")).cast("long").alias("__n_removed"))


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None,
                     spacing: int = SPACING) -> DataFrame:
    """:func:`dedup_passages` with the columns of ``docs`` alone, whatever their names; ``length_col`` follows the text's length."""
    docs, name, named = set_aside_names(docs)
    out = dedup_passages(docs, name(id_col), name(text_col), spacing)
    if length_col is not None:
        length = name(length_col)
        out = out.withColumn(length, F.char_length(name(text_col)).cast(dict(docs.dtypes)[length]))
    return named(out)
