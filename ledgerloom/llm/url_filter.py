"""URL filter: longest matching rule, and trust propagated over the link graph of hosts, with Spark's own functions.

A rule names a host and a path prefix and fits the host and its subdomains. Urls that no rule fits are judged
by their host: a host's trust seed is the share of its pages that rules allow, its distrust seed the share that they
block. Trust spreads along links as personalised PageRank, distrust against them; hosts without a link to follow
keep what they have.

PageRank deals a host's score out over its neighbours, so a score tells about degrees as much as about rules. Verdicts
compare it with what the same graph deals out where every seed is 1: a host's level is its seed, or the seeded share of
the score that reaches it, if that is more. A host is blocked if its distrust seed reaches `MIN_DISTRUST` and exceeds
its trust seed, or if its trust seed is below `MIN_DISTRUST` and its exposure, the mean distrust level over its links to
other hosts, reaches `MIN_DISTRUST` and exceeds its trust level.

Null urls and urls without `://` have an empty host and path, no rule, and are allowed. Repeated rows count again as
pages. Pages with null html link nowhere. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

DAMPING, SETTLED, MIN_DISTRUST = 0.85, 1e-3, 0.5
#: Rules that are sent to all tasks; beyond it places and rules are joined by a shuffle.
BROADCAST_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """verdict is `allow` or `block`; text is the host and the path prefix, as in `example.com/en/`."""

    verdict: str
    text: str


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 2), F.lit(""))


def match_rules(places: DataFrame, rules: list[Rule]) -> DataFrame:
    """The longest rule that fits each (host, path): (host, path, rule, verdict); places that none fits are left out."""
    spark = places.sparkSession
    rows = [(r.text.partition("/")[0].lower(), "/" + r.text.partition("/")[2] if "/" in r.text else "", r.text, r.verdict) for r in rules]
    listed = spark.createDataFrame(rows, "rule_host string, prefix string, rule string, verdict string")
    if len(rows) <= BROADCAST_RULES:
        listed = F.broadcast(listed)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = places.select("host", "path", F.explode(suffixes).alias("rule_host")).join(listed, "rule_host").where(F.startswith("path", "prefix"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("m"))
    return best.select("host", "path", "m.rule", "m.verdict")


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, w): pages of the host src that link to another host dst."""
    links = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""), 1)
    named = pages.select(host_of(F.col(url)).alias("src"), F.array_distinct(F.transform(links, lambda h: F.translate(h, _UPPER, _LOWER))).alias("to"))
    return named.select("src", F.explode("to").alias("dst")).where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, settled: float = SETTLED, rounds: int | None = None) -> DataFrame:
    """Personalised PageRank: (host, score) from seeds (host, seed), over edges (src, dst, w).

    Ends when no score has changed by more than `settled`, which it does: a round's changes add up to `damping` times the last
    one's at most. `rounds` ends it earlier.
    """
    with common.Scratch() as run:
        out = edges.groupBy("src").agg(F.sum("w").alias("total"))
        shares = common.saved(edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")))
        hosts = seeds.select("host").union(edges.select("src")).union(edges.select("dst")).distinct()
        ends = out.select(F.col("src").alias("host"), F.lit(True).alias("leads"))
        seed = F.coalesce("seed", F.lit(0.0))
        with common.Scratch() as steps:
            now = common.saved(hosts.join(seeds, "host", "left").join(ends, "host", "left").select("host", seed.alias("seed"), F.coalesce("leads", F.lit(False)).alias("leads"), seed.alias("score")))
            done, moved = 0, 0.0 if shares.isEmpty() else float("inf")
            while moved > settled and done != rounds:
                got = now.select(F.col("host").alias("src"), "score").join(shares, "src").groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("sent")).withColumnRenamed("dst", "host")
                kept = F.when(F.col("leads"), 0.0).otherwise(F.col("score"))
                score = (1 - damping) * F.col("seed") + damping * (F.coalesce("sent", F.lit(0.0)) + kept)
                step = common.saved(now.join(got, "host", "left").select("host", "seed", "leads", score.alias("score"), F.abs(score - F.col("score")).alias("moved")))
                moved, done = step.agg(F.max("moved")).first()[0] or 0.0, done + 1
                steps.forget(keep=1)
                now = step.drop("moved")
            return run.result(now.select("host", "score"))


def levels(edges: DataFrame, seeds: DataFrame, scores: DataFrame) -> DataFrame:
    """(host, level) of hosts that the edges (src, dst, w) reach or that have a seed, 0 to 1, from their scores by `propagate`."""
    every = seeds.select("host").union(edges.select("src")).union(edges.select("dst")).distinct().withColumn("seed", F.lit(1.0))
    most = propagate(edges, every).withColumnRenamed("score", "most")
    out = edges.groupBy("src").agg(F.sum("w").alias("total"))
    sent = edges.join(out, "src").join(scores.join(most, "host").withColumnRenamed("host", "src"), "src")
    share = F.col("w") / F.col("total")
    got = sent.groupBy(F.col("dst").alias("host")).agg((F.sum(F.col("score") * share) / F.sum(F.col("most") * share)).alias("got"))
    level = F.least(F.lit(1.0), F.greatest(F.coalesce("seed", F.lit(0.0)), F.coalesce("got", F.lit(0.0))))
    return seeds.join(got, "host", "full").select("host", level.alias("level"))


def judge(pages: DataFrame, rules: list[Rule], id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust)."""
    with common.Scratch() as run:
        placed = pages.select(F.col(id_column), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
        counted = common.saved(placed.groupBy("host", "path").agg(F.count("*").alias("pages")))
        ruled = common.saved(counted.join(match_rules(counted.select("host", "path"), rules), ["host", "path"], "left"))
        share = lambda v: (F.sum(F.when(F.col("verdict") == v, F.col("pages")).otherwise(0)) / F.sum("pages")).alias(v)
        seeds = common.saved(ruled.where("host <> ''").groupBy("host").agg(share("allow"), share("block")))
        edges = common.saved(host_edges(pages, url, html))
        against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
        allowed, blocked = (seeds.select("host", F.col(v).alias("seed")) for v in ("allow", "block"))
        trust, distrust = propagate(edges, allowed), propagate(against, blocked)
        scored = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host").join(seeds, "host", "left")
        if edges.isEmpty():
            linked = scored.withColumns({"trust_level": F.lit(0.0), "exposure": F.lit(0.0)})
        else:
            distrusted = edges.join(levels(against, blocked, distrust).withColumnRenamed("host", "dst"), "dst", "left")
            exposure = distrusted.groupBy(F.col("src").alias("host")).agg((F.sum(F.col("w") * F.coalesce("level", F.lit(0.0))) / F.sum("w")).alias("exposure"))
            linked = scored.join(levels(edges, allowed, trust).withColumnRenamed("level", "trust_level"), "host", "left").join(exposure, "host", "left")
        named = ("trust", "distrust", "allow", "block", "trust_level", "exposure")
        of_place = common.saved(ruled.join(linked, "host", "left").fillna(0.0, list(named)))
        by_seed = (F.col("block") >= MIN_DISTRUST) & (F.col("block") > F.col("allow"))
        bad = by_seed | ((F.col("allow") < MIN_DISTRUST) & (F.col("exposure") >= MIN_DISTRUST) & (F.col("exposure") > F.col("trust_level")))
        judged = of_place.withColumn("verdict", F.coalesce("verdict", F.when(bad, "block").otherwise("allow")))
        places = run.result(judged.select("host", "path", "pages", "rule", "verdict", "trust", "distrust"))
    return common.join_once(placed, places, ["host", "path"], "pages").select(id_column, "host", "path", "rule", "verdict", "trust", "distrust")
