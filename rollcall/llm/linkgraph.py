"""URL filters: host and path rules, and trust propagated over the link graph for the rest.

Hosts link to the hosts their pages point to, crawled or not, and to and from
their parent domain, up to the one that a registrar gave to somebody.  Personalised PageRank carries trust from allowed hosts
along the links; distrust runs from blocked hosts against them (who links to a
blocked host).  Every host splits its score over its links, so scores shrink with
the number of neighbours; they are compared as shares of the PageRank that all
seeds, allowed, blocked or neither, send to the host the same way.  A host whose distrust
exceeds its trust by the threshold is blocked.  DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import cut, lower_ascii, stored

# fixed: (host, path prefix, verdict); a rule holds for its host and all subdomains
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DAMPING = 0.85
THRESHOLD = 0.5      # of the score of a host all of whose pages are seeds
TOLERANCE = 1e-3     # share of all score that paths longer than the rounds could still carry
ROUNDS_PER_TABLE = 4
ROWS_PER_FILE = 1 << 20
# fixed: labels below a country's domain that stand for everybody there (co.uk), and domains that lend names to the public
PUBLIC_LABELS = ["ac", "co", "com", "edu", "gov", "go", "mil", "ne", "net", "or", "org"]
SHARED_DOMAINS = ["blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "vercel.app", "web.app", "wordpress.com"]


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits; null without one."""
    chosen = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, value) if chosen is None else chosen.when(fits, value)
    return chosen if chosen is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def linked_urls(pages: DataFrame, html: Column) -> DataFrame:
    """(src, dst, path): every link of a page to another host; an empty path is /."""
    targets = F.regexp_extract_all(html, F.lit(r"(?i)\bhref\s*=\s*[\"']?\s*(?:https?:)?(//[^/?#\"'\s>][^\"'\s>]*)"), F.lit(1))
    url = F.concat(F.lit(":"), F.col("url"))
    return (pages.filter(F.col("host") != "").select(F.col("host").alias("src"), F.explode(targets).alias("url"))
            .select("src", host_of(url).alias("dst"), F.when(path_of(url) == "", "/").otherwise(path_of(url)).alias("path"))
            .filter("src != dst and dst != ''"))


def is_public(host: Column) -> Column:
    """A domain under which unrelated owners have names: a listed one, or a public label below a two-letter country."""
    return host.isin(SHARED_DOMAINS) | host.rlike(rf"^({'|'.join(PUBLIC_LABELS)})\.[a-z]{{2}}$")


def parent_links(hosts: DataFrame) -> DataFrame:
    """(src, dst, weight 1): each host and its parent domains in a chain, both ways, whether they have pages or not.

    A parent of one label (a top-level domain) belongs to nobody and is left out
    unless it is among ``hosts``, and a public one (:func:`is_public`) always; numeric addresses have no parents.
    """
    named = hosts.filter(~F.col("host").rlike(r"^[0-9.]+(:[0-9]+)?$"))
    steps = named.select(F.explode(F.expr(
        "transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))"
        )).alias("src")).distinct().select("src", F.expr("substring(src, instr(src, '.') + 1)").alias("dst"))
    steps = steps.filter("src != dst and src != '' and dst != '' and src not like '.%'").filter(~is_public(F.col("dst")))
    top = hosts.filter("host not like '%.%'").select(F.col("host").alias("dst")).distinct()
    up = steps.filter("dst like '%.%'").union(steps.join(top, "dst", "left_semi").select("src", "dst").filter("dst not like '%.%'"))
    return up.union(up.select("dst", "src")).withColumn("weight", F.lit(1).cast("long"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE,
              columns: dict[str, bool] | None = None) -> DataFrame:
    """(host, *columns): personalised PageRank of seeds (host, *columns in 0..1) over links (src, dst, weight).

    ``columns`` (trust and distrust) says what runs along the links and what against them.  A host's score is split
    over its links by weight; a host without links passes nothing on.  Every round serves all columns with one join and one
    aggregation.  What paths of more than k links carry is at most damping ** k of all score, so the number of rounds follows
    from ``tolerance``.  Every few rounds are written to the checkpoint folder, in files by the number of rows.
    """
    columns = {"trust": True, "distrust": False} if columns is None else columns
    directed = links.select("src", "dst", "weight", F.lit(True).alias("forward")).union(
        links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", F.lit(False).alias("forward")))
    totals = directed.groupBy("src", "forward").agg(F.sum("weight").alias("total"))
    files = 1 + links.count() // ROWS_PER_FILE
    steps = stored(directed.join(totals, ["src", "forward"]).select(
        "src", F.col("dst").alias("host"), "forward", (F.col("weight") / F.col("total")).alias("share")), files)
    base = stored(seeds.groupBy("host").agg(*[(F.max(c) * (1 - damping)).alias(c) for c in columns]), files)
    state = base
    rounds = max(1, math.ceil(math.log(tolerance) / math.log(damping)))
    for k in range(rounds):
        sent = steps.join(state.withColumnRenamed("host", "src"), "src").select(
            "host", *[F.when(F.col("forward") == along, damping * F.col("share") * F.col(c)).otherwise(0.0).alias(c)
                      for c, along in columns.items()])
        state = base.union(sent).groupBy("host").agg(*[F.sum(c).alias(c) for c in columns])
        if k % ROUNDS_PER_TABLE == ROUNDS_PER_TABLE - 1 or k == rounds - 1:
            state = stored(state, files)
    return state


def shares(seeds: DataFrame, links: DataFrame, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) in 0..1 from seeds (host, trust, distrust, mass) over links (src, dst, weight).

    Each score is the larger of the host's own share and the damped share of
    the PageRank its neighbours pass to it that comes from trusted (blocked) hosts.
    Both are relative to what all seeds send the same way, so they do not shrink with the number of neighbours.
    """
    given = seeds.select("host", "trust", "distrust", F.col("mass").alias("mass_t"), F.col("mass").alias("mass_d"))
    scores = propagate(given, links, damping, columns={"trust": True, "mass_t": True, "distrust": False, "mass_d": False})
    own = seeds.select(F.col("host").alias("of"), F.col("trust").alias("own_t"), F.col("distrust").alias("own_d"), "mass")

    def share(score: str, mass: str, own_score: str) -> Column:
        mine = F.coalesce(F.col(own_score), F.lit(0.0))
        got, of = F.col(score) - (1 - damping) * mine, F.col(mass) - (1 - damping) * F.coalesce("mass", F.lit(0.0))
        return F.greatest(mine, F.when(of > 1e-15, damping * got / of).otherwise(0.0))

    return scores.join(own, F.col("host") == F.col("of"), "left").select(
        "host", share("trust", "mass_t", "own_t").alias("trust"), share("distrust", "mass_d", "own_d").alias("distrust"))


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, id_col: str = "page_id",
                 url_col: str = "url", html_col: str = "html", damping: float = DAMPING,
                 threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page row.

    The longest fitting rule decides; pages without one are blocked if their
    host's distrust exceeds its trust by ``threshold`` (see :func:`shares`).  Seeds
    are the shares of a host's pages that rules allow or block; for hosts without
    pages, of the links to them.  Null urls and
    urls without :// have empty host and path, no rule and are allowed;
    null or empty html links nowhere; repeated rows count each.
    """
    rules = RULES if rules is None else rules
    parsed = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"),
                          path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    judged = parsed.withColumn("judged", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.col("judged.verdict")
    crawled = cut(judged.filter("host != ''").groupBy("host").agg(
        F.avg(F.when(verdict == "allow", 1.0).otherwise(0.0)).alias("trust"),
        F.avg(F.when(verdict == "block", 1.0).otherwise(0.0)).alias("distrust"), F.lit(1.0).alias("mass")))
    targets = linked_urls(parsed, F.col("html"))
    judged_targets = stored(targets.withColumn("judged", rule_of(F.col("dst"), F.col("path"), rules))
                            .groupBy("src", F.col("dst").alias("host"), F.col("judged.verdict").alias("verdict"))
                            .agg(F.count(F.lit(1)).alias("weight")))
    n = F.sum("weight")
    linked = (judged_targets.groupBy("host").agg(
        (F.coalesce(F.sum(F.when(F.col("verdict") == "allow", F.col("weight"))), F.lit(0)) / n).alias("trust"),
        (F.coalesce(F.sum(F.when(F.col("verdict") == "block", F.col("weight"))), F.lit(0)) / n).alias("distrust"), F.lit(1.0).alias("mass"))
        .join(crawled.select("host"), "host", "left_anti"))
    seeds = stored(crawled.union(linked))
    links = (judged_targets.select("src", F.col("host").alias("dst"), "weight").union(parent_links(seeds.select("host")))
             .groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    scores = shares(seeds, links, damping).select(F.col("host").alias("of_host"), "trust", "distrust")
    slim = judged.select("page_id", "host", "path", "judged")
    bad = F.coalesce(F.col("distrust") - F.col("trust") >= threshold, F.lit(False))
    return (slim.join(scores, slim.host == scores.of_host, "left")
            .select("page_id", "host", "path", F.col("judged.rule").alias("rule"),
                    F.coalesce("judged.verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"),
                    F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))
