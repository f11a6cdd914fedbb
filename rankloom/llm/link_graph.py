"""URL filters by link-graph propagation: trust from allowed hosts, reversed distrust from blocked ones.

Hosts are nodes. A link in a page is an edge to another host, weighted by the number of such links. Relative links
name no host, so a host also vouches, with weight ``KIN``, for the hosts one label below it: only if it has pages or is
linked itself, is no address of numbers, and has at most ``MOST_KIN`` such hosts, since a name that many hosts
share is a provider's suffix and no site. These edges lead down only, so nothing passes between two hosts below one. Trust is a personalised PageRank along the edges,
restarted at hosts with pages that a rule allows; distrust one against the edges, restarted at hosts with
pages that a rule blocks (who links to the blocked is suspect). A host is blocked where distrust exceeds
``ratio`` times trust. Rules go before: the longest that fits a url decides it.

Edges are summed per pair of hosts before any iteration, each iteration is one join and one sum with partial
aggregation, steps end when scores hardly move, and scores are written to the shared folder so that a lost executor costs one iteration.

Defined cases: a null url, or one without ``://``, has empty host and path, no scores and the verdict
``allow``; null html has no links; repeated pages are judged alike (their links count again); hosts without
edges keep their own seeds' share; an empty table gives an empty result. Input columns are kept in a struct,
and the added columns replace those of equal name.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.session import cut_lineage

#: Weight of the edge from a host to one a label below it, and the most of these that it may have.
KIN, MOST_KIN = 1.0, 8
#: Steps end when every score moves by less than this share of itself, or after so many.
RESIDUAL, MOST_ROUNDS = 0.01, 50
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
ADDED = ("host", "path", "rule", "verdict", "trust", "distrust")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path: then up to ``?``, ``#`` or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def first_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest of ``(host, path, verdict)`` that fits, as a struct of ``rule`` and ``verdict``; null without."""
    found = []
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found.append(F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_edges(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(src, dst, w) between different hosts, one row per pair."""
    links = (
        pages.where(F.col(host) != "")
        .select(F.col(host).alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(_LINK), 1)).alias("dst"))
        .withColumn("dst", lower_ascii(F.col("dst")))
        .groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))
    )
    links = cut_lineage(links)  # one row per pair of hosts, read several times; pages are read for it once
    hosts = cut_lineage(pages.select(F.col(host).alias("h")).distinct().union(links.select("dst")).where(F.col("h") != "").distinct())
    parent = F.regexp_extract("h", r"^[^.]+\.([^.]+\..+)$", 1)
    below = hosts.select("h", parent.alias("up")).where((F.col("up") != "") & ~F.col("h").rlike(r"\.[0-9]+(:[0-9]*)?$"))
    sites = below.groupBy("up").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= MOST_KIN)
    sites = sites.join(hosts.select(F.col("h").alias("up")), "up", "left_semi")
    kin = below.join(sites, "up").select(F.col("up").alias("src"), F.col("h").alias("dst"), F.lit(KIN).alias("w"))
    return links.unionByName(kin).where(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def round_bits(x: Column) -> Column:
    """``x`` rounded to its 40 leading bits (about 12 digits), however small it is."""
    wide = x * F.lit(float(2**13 + 1))
    return wide - (wide - x)


def propagate(
    edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = MOST_ROUNDS, residual: float = RESIDUAL
) -> DataFrame:
    """(host, trust, distrust) when a step moves every score by less than ``residual`` of itself, or after ``rounds`` steps.
    ``seeds``: (host, allowed, blocked) page counts.

    Scores are kept in pages until the end, and rounded relatively, so they do not vanish in a large table."""
    totals = seeds.agg(F.sum("allowed"), F.sum("blocked")).first()
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    nodes = edges.select(F.col("src").alias("host")).union(edges.select("dst")).union(seeds.select("host")).distinct()
    nodes = nodes.join(seeds, "host", "left").select(
        "host", F.explode(F.create_map(F.lit("trust"), count("allowed"), F.lit("distrust"), count("blocked"))).alias("kind", "seed")
    )
    scores = cut_lineage(nodes.withColumn("score", F.col("seed")))
    out = edges.join(edges.groupBy("src").agg(F.sum("w").alias("all")), "src")
    back = edges.join(edges.groupBy("dst").agg(F.sum("w").alias("all")), "dst")
    steps = cut_lineage(
        out.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("w") / F.col("all")).alias("p"))
        .unionByName(back.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), (F.col("w") / F.col("all")).alias("p")))
    )
    for _ in range(rounds):
        inflow = (
            steps.join(scores.where(F.col("score") > 0), ["kind", "host"])
            .groupBy("kind", F.col("to").alias("host")).agg(F.sum(F.col("score") * F.col("p")).alias("inflow"))
        )
        # Rounded, so that the order of summation cannot change a verdict.
        score = round_bits((1 - damping) * F.col("seed") + damping * F.coalesce("inflow", F.lit(0.0)))
        after = scores.withColumnRenamed("score", "before").join(inflow, ["kind", "host"], "left")
        scores = cut_lineage(after.select("host", "kind", "seed", score.alias("score"), "before"))
        moved = scores.agg(F.max(F.abs(F.try_divide(F.col("score") - F.col("before"), F.col("score"))))).first()[0] or 0.0
        scores = scores.drop("before")
        if moved <= residual:
            break
    pick = lambda kind, n: round_bits(F.max(F.when(F.col("kind") == kind, F.col("score"))) / F.lit(float(n or 1))).alias(kind)
    return scores.groupBy("host").agg(pick("trust", totals[0]), pick("distrust", totals[1]))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    url_col: str = "url",
    html_col: str = "html",
    ratio: float = 1.0,
    damping: float = 0.85,
    rounds: int = MOST_ROUNDS,
    residual: float = RESIDUAL,
) -> DataFrame:
    """All pages with ``host``, ``path``, ``rule``, ``verdict``, ``trust`` and ``distrust``."""
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.struct("*").alias("_page"), host.alias("_host"), path.alias("_path"))
    ruled = parsed.withColumn("_rule", first_rule(F.col("_host"), F.col("_path"), rules))
    counted = lambda verdict: F.sum((F.col("_rule.verdict") == verdict).cast("int"))
    seeds = cut_lineage(
        ruled.where((F.col("_host") != "") & F.col("_rule").isNotNull()).groupBy(F.col("_host").alias("host"))
        .agg(counted("allow").alias("allowed"), counted("block").alias("blocked"))
    )
    edges = cut_lineage(host_edges(ruled.withColumn("_html", F.col("_page").getField(html_col)), "_host", "_html"))
    scores = propagate(edges, seeds, damping, rounds, residual).withColumnRenamed("host", "_scored")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    judged = F.when(distrust > ratio * trust, "block").otherwise("allow")
    found = ruled.join(scores, F.col("_host") == F.col("_scored"), "left")
    return found.select(
        *[F.col("_page").getField(c).alias(c) for c in pages.columns if c not in ADDED],
        F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), judged).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"),
    )
