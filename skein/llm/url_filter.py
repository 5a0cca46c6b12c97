"""Operator 9 [native], URL filters: rules first, then trust and distrust spread over host links.

A rule names a host and a path start; it fits the host and its subdomains, and the longest
fitting rule decides. Where none fits, the url's host decides. Hosts most of whose pages are
blocked by rules are seeds of distrust, other hosts with allowed pages seeds of trust. Trust is a
PageRank personalised to the trusted seeds along links, distrust one personalised to the blocked
seeds against them; a host is blocked if its distrust is over `threshold` of both together.
Ranks that reach a host without a way on go back to the seeds. Rounds go on until a kind's ranks
change by at most `tolerance` of their sum (1) together.

Edges are links of the pages' html between different hosts, absolute or without a scheme (`//host/`),
counted once a pair (pre-aggregated before the shuffle). Only DataFrame expressions are used.

Defined results: a null url, or one without `://`, has an empty host and path and is allowed
unless a rule fits; null html has no links; rows that repeat a page_id are judged each; an empty
table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialize

#: Fixed: the rules of the contract (verdict, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?i)href\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^\"'\s<>]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text and verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst: pairs of different hosts with an absolute link from one to the other."""
    # a scheme in front of a link that has one changes nothing: the host follows the first ://
    whole = lambda link: F.when(link.startswith("//"), F.concat(F.lit("x:"), link)).otherwise(link)
    target = F.explode(F.array_distinct(F.transform(F.regexp_extract_all(html_col, F.lit(_LINK), 1), lambda link: host_of(whole(link)))))
    found = pages.where(F.col(html_col).contains("//")).select(host_of(F.col(url_col)).alias("src"), target.alias("dst"))
    return found.where("src != '' and dst != '' and src != dst").distinct()


def spread(links: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = 0.85, tolerance: float = 1e-3) -> DataFrame:
    """kind, host, rank: personalised PageRank of kind `trust` along links and `distrust` against them.

    seeds: kind, host, weight (weights of a kind sum to 1). Both kinds advance in one join a round. rounds: so
    many, instead of until the ranks settle (their change shrinks by damping a round, so that ends).
    """
    directed = links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to")).unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to")))
    degree = directed.groupBy("kind", "host").agg(F.count("*").alias("degree"))
    spark, n = links.sparkSession, directed.count()
    edges = materialize(join_groups(directed, degree, ["kind", "host"], "degree", n, "inner"), "host-edges")
    ranks = seeds.select("kind", "host", F.col("weight").alias("rank"))
    if not n:
        return ranks
    k = 0
    while rounds is None or k < rounds:
        sizes = ranks.join(degree, ["kind", "host"], "left").select("kind", "host", "rank", F.coalesce("degree", F.lit(0)).alias("degree"))
        passed = join_groups(edges.drop("degree"), sizes, ["kind", "host"], "degree", n, "inner").select("kind", F.col("to").alias("host"), (F.col("rank") / F.col("degree") * damping).alias("rank"))
        passed = materialize(passed.groupBy("kind", "host").agg(F.sum("rank").alias("rank")), "passed")
        on = spark.createDataFrame(passed.groupBy("kind").agg(F.sum("rank").alias("on")).collect(), "kind string, on double")  # two rows
        back = seeds.join(F.broadcast(on), "kind", "left").select("kind", "host", (F.col("weight") * (1 - F.coalesce("on", F.lit(0.0)))).alias("rank"))
        new = materialize(passed.unionByName(back).groupBy("kind", "host").agg(F.sum("rank").alias("rank")), "ranks")
        k += 1
        if rounds is None:
            old = ranks.withColumn("rank", -F.col("rank"))
            change = new.unionByName(old).groupBy("kind", "host").agg(F.abs(F.sum("rank")).alias("by")).groupBy("kind").agg(F.sum("by").alias("by")).agg(F.max("by")).first()[0]
            if change <= tolerance:
                return new
        ranks = new
    return ranks


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.5, tolerance: float = 1e-3, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict."""
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = materialize(urls.withColumn("rule", rule).withColumn("ruled", verdict), "ruled")
    hosts = ruled.where("host != ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "block").alias("blocked"), F.count_if(F.col("ruled") == "allow").alias("allowed"))
    kind = F.when(F.col("blocked") * 2 > F.col("n"), "distrust").when(F.col("allowed") > 0, "trust")
    marked = hosts.select(kind.alias("kind"), "host").where("kind is not null")
    totals = marked.groupBy("kind").agg(F.count("*").alias("of"))
    seeds = materialize(marked.join(F.broadcast(totals), "kind").select("kind", "host", (1 / F.col("of")).alias("weight")), "seeds")  # totals: two rows
    ranks = spread(materialize(host_links(pages, url_col, html_col), "host-links"), seeds, tolerance=tolerance)
    bad = F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(0.0))
    judged = ranks.groupBy("host").agg((bad > threshold * F.sum("rank")).alias("bad")).where("bad")
    found = join_groups(ruled, judged.join(hosts.select("host", "n"), "host"), ["host"], "n", ruled.count())
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))
