"""URL verdicts by rules, and by trust and distrust propagated over the host graph.

Rules decide the urls they fit. For the rest, hosts with allowed urls are trusted seeds and hosts
with blocked urls are distrusted ones. Trust goes along links between hosts (personalised PageRank
from the trusted), distrust against them (who links to the blocked is suspect). A host is blocked
where its share of distrust is above a threshold. Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: (verdict, rule): a host and a path, for the host and its subdomains and paths that start so.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
DAMPING, ROUNDS, THRESHOLD = 0.85, 12, 0.5
#: Rounds after which the ranks are written, which cuts the lineage.
WRITE_EVERY = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)<(?:a|area|link|iframe)\b[^>]*?\bhref\s*=\s*["']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to /, ? or #, A-Z lower-cased; empty for null or no ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ? or #."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule string, verdict string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, ruled) by the rules alone."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): links of the pages' html between different hosts, counted."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).filter("src <> '' and dst <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(kind, host, rank) by personalised PageRank: trust along edges, distrust against them.

    `seeds` are (kind, host, mass), masses of a kind adding up to 1. What a host without edges would
    pass on is lost, in either kind. An edge is a distinct pair of hosts, so a hub has at most as many as
    there are hosts; sums are made before the shuffle, and joins are left to Spark's skew handling.
    """
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "w").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    out = both.groupBy("kind", "src").agg(F.sum("w").alias("total"))
    steps = written(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("w") / F.col("total")).alias("p")), "host-steps")
    ranks = seeds.select("kind", "host", F.col("mass").alias("rank"))
    if steps.isEmpty():  # nothing is passed on: the seeds' own share is all there is
        return ranks.withColumn("rank", F.col("rank") * (1 - damping))
    base = seeds.select("kind", "host", (F.col("mass") * (1 - damping)).alias("rank"))
    for i in range(1, rounds + 1):
        passed = steps.join(ranks.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("p") * F.col("rank") * damping).alias("rank"))
        ranks = passed.unionByName(base).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if i % WRITE_EVERY == 0 or i == rounds:
            ranks = written(ranks, "host-ranks")
    return ranks


def seeds_of(rows: DataFrame) -> DataFrame:
    """(kind, host, mass): hosts of ruled urls, by their share of all allowed or all blocked ones."""
    n = rows.filter("ruled is not null and host <> ''").groupBy(F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count("*").alias("n"))
    n = written(n, "host-seeds")
    totals = n.groupBy("kind").agg(F.sum("n").alias("total"))  # two rows
    return n.join(totals, "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("mass"))


def url_verdicts(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = THRESHOLD, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, trust, distrust.

    A null url, or one without ://, has an empty host and path, fits no rule and is allowed. A host that
    neither trust nor distrust reaches is allowed. Repeated rows are judged each; an empty table gives an
    empty one; other columns are not read.
    """
    rows = judged(pages, rules)
    ranks = propagate(host_edges(pages), seeds_of(rows), damping, rounds)
    host = ranks.groupBy("host").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")))
    share = F.coalesce(F.col("distrust") / F.nullif(F.col("trust") + F.col("distrust"), F.lit(0.0)), F.lit(0.0))
    method = F.when(share > threshold, "block").otherwise("allow")
    out = rows.join(host, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
