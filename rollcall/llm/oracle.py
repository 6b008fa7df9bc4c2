"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from rollcall.llm import quality
from rollcall.llm.best_position import K
from rollcall.llm.decontaminate import WINDOW
from rollcall.llm.debruijn import WINDOW as SPAN
from rollcall.llm.hard_negatives import K as POSITIVES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (
  SELECT item_id, w, least({WINDOW}, len(w)) AS n, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i
  FROM b WHERE len(w) > 0)),
ls AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ls WHERE len(w) >= n)),
hit AS (SELECT r, n, i, item_id FROM dw JOIN bw USING (n, k)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (
  SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, n, i FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (
  SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

SUBSTRINGS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(w[i:i + {SPAN - 1}], ' ') AS k FROM (
  SELECT r, doc_id, w, unnest(range(1, len(w) - {SPAN} + 2)) AS i FROM d WHERE len(w) >= {SPAN})),
f AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {SPAN})) AS p FROM g JOIN f USING (k) WHERE doc_id > least),
each AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s FROM each ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""


SEARCH = f"""
WITH d AS (SELECT * FROM (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents) WHERE len(w) > 0),
c AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM d),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY ALL),
v AS (SELECT t, count(*) AS df FROM p GROUP BY t),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_ALNUM}) AS t FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL),
f AS (SELECT item_id, t, times * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS f FROM q JOIN v USING (t), c),
m AS (SELECT r, doc_id, 75 + (25 * len(w) * docs) // words AS m FROM d, c),
s AS (SELECT item_id, r, doc_id, CAST(sum(f * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM f JOIN p USING (t) JOIN m USING (r) WHERE doc_id IS NOT NULL GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {K}"""


HARD_NEGATIVES = f"""
WITH e AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor, e.id AS other, a.label = e.label AS same, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score
  FROM e AS a, e WHERE a.id % 100 = 0 AND a.id <> e.id),
p AS (SELECT anchor, other AS positive, score AS reached FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= {POSITIVES}),
n AS (SELECT anchor, positive, reached, other, score, row_number() OVER (PARTITION BY anchor, positive ORDER BY score DESC, other) AS r
  FROM p JOIN s USING (anchor) WHERE NOT same AND 80 * reached <= 100 * score AND 100 * score <= 100 * reached)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(r AS INT) AS rank, other AS negative_id, reached AS positive_score,
  score AS negative_score FROM n WHERE r <= {POSITIVES}"""


def _quality() -> str:
    share = "coalesce(1000 * {} // nullif({}, 0), 0)"
    signals = {"word_len": share.format("word_chars", "n_words"), "symbols": share.format("n_symbols", "n_words"),
               "dup_lines": share.format("n_dup_lines", "n_lines"), "repeats": share.format("n_repeat_words", "n_words")}
    cells = " UNION ALL ".join(f"SELECT lang, source, '{s}' AS signal, {s} AS v FROM c WHERE NOT base_failed" for s in signals)

    def level(name: str, keys: str) -> str:
        group, k = (f"GROUP BY {keys}, signal, b", f"{keys}, ") if keys else ("GROUP BY signal, b", "")
        return f"""
{name}_m AS (SELECT {k}signal, b, sum(n) AS n FROM sk {group}),
{name}_w AS (SELECT {k}signal, (1 << CAST(b // 32 AS INT)) * (b % 32) AS v, sum(n) OVER (PARTITION BY {k}signal ORDER BY b) AS below,
  sum(n) OVER (PARTITION BY {k}signal) AS total FROM {name}_m),
{name}_q AS (SELECT {k}signal, any_value(total) AS n_docs, min(v) FILTER (4 * below >= total) AS q1,
  min(v) FILTER (4 * below >= 3 * total) AS q3 FROM {name}_w GROUP BY {k}signal),
{name} AS (SELECT {k}max(n_docs) AS n_docs, {", ".join(
    f"max(q3 + {quality.FENCE} * greatest(q3 - q1, {quality.SLACK[s]})) FILTER (signal = '{s}') AS hi_{s}, "
    f"max(q1 - {quality.FENCE} * greatest(q3 - q1, {quality.SLACK[s]})) FILTER (signal = '{s}') AS lo_{s}"
    for s in signals)} FROM {name}_q {"GROUP BY " + keys if keys else ""})"""

    def limit(side: str, s: str) -> str:
        return (f"CASE WHEN own.n_docs >= {quality.MIN_GROUP} THEN own.{side}_{s} WHEN bl.n_docs >= {quality.MIN_GROUP} "
                f"THEN bl.{side}_{s} ELSE corpus.{side}_{s} END")

    fits = " AND ".join([f"{s} <= {limit('hi', s)}" for s in signals] + [f"{s} >= {limit('lo', s)}" for s in quality.TWO_SIDED])
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
tri AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM (
  SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM tri) WHERE c > 1) GROUP BY r),
c0 AS (SELECT r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
  CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN rep USING (r)),
c AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  {", ".join(f"{e} AS {s}" for s, e in signals.items())} FROM c0),
sk AS (SELECT lang, source, signal, CASE WHEN v < 32 THEN v ELSE (length(bin(v)) - 5) * 32 + (v >> CAST(length(bin(v)) - 5 AS INT)) END AS b,
  count(*) AS n FROM ({cells}) GROUP BY ALL),{level("own", "lang, source")},{level("bl", "lang")},{level("corpus", "")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce({fits}, false) AS kept
FROM c LEFT JOIN own ON c.lang IS NOT DISTINCT FROM own.lang AND c.source IS NOT DISTINCT FROM own.source
  LEFT JOIN bl ON c.lang IS NOT DISTINCT FROM bl.lang, corpus"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _quality(), "op2_decontamination": DECONTAMINATION, "op10_substring_dedup": SUBSTRINGS,
            "op11_ranked_search": SEARCH, "op12_hard_negatives": HARD_NEGATIVES}
