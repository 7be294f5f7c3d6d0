"""URL verdicts from rules and from trust that flows over links between hosts."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.plans.staging import stage

#: ``(verdict, host, path prefix)``.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: An address in a link attribute that names a host.
LINK = r"""(?i)\b(?:href|src|action)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return _lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host/path`` text, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, weight``: links between different hosts, and a mutual edge of weight 1 between a host and the domain it is under.

    ``pages`` has ``host`` and ``html``. Links are counted in the map tasks before the shuffle.
    """
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst")).withColumn("dst", _lower("dst"))
    links = links.filter((F.col("src") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    hosts = pages.select("host").filter("host != ''").distinct()
    under = hosts.select("host", F.regexp_extract("host", r"^[^.]+\.(.+\..+\..+)$", 1).alias("parent")).filter("parent != ''")
    up = under.select(F.col("host").alias("src"), F.col("parent").alias("dst"), F.lit(1).alias("n"))
    down = under.select(F.col("parent").alias("src"), F.col("host").alias("dst"), F.lit(1).alias("n"))
    return links.unionByName(up).unionByName(down).groupBy("src", "dst").agg(F.sum("n").cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.8, iterations: int = 16, cut: int = 8) -> DataFrame:
    """Personalised PageRank of trust along edges and of distrust against them.

    ``seeds(host, trusted, blocked)`` are shares of a host's pages. Returns ``host, trust, distrust``. Mass
    at hosts without edges leaves the walk; what is missing after ``iterations`` is below
    ``damping ** iterations``. Every ``cut`` rounds the ranks are written to the checkpoint folder.
    """
    both = edges.select(F.lit(True).alias("good"), "src", "dst", "weight").unionByName(edges.select(F.lit(False).alias("good"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    out = both.groupBy("good", "src").agg(F.sum("weight").alias("total"))
    both = stage(both.join(out, ["good", "src"]).select("good", "src", "dst", (F.col("weight") / F.col("total") * damping).alias("share")), "edges")
    start = stage(
        seeds.select(F.lit(True).alias("good"), "host", (F.col("trusted") * (1 - damping)).alias("rank")).unionByName(seeds.select(F.lit(False).alias("good"), "host", (F.col("blocked") * (1 - damping)).alias("rank"))).filter("rank > 0"),
        "seeds",
    )
    ranks = start
    for i in range(iterations):
        moved = both.join(ranks.withColumnRenamed("host", "src"), ["good", "src"]).select("good", F.col("dst").alias("host"), (F.col("rank") * F.col("share")).alias("rank"))
        ranks = moved.unionByName(start).groupBy("good", "host").agg(F.sum("rank").alias("rank"))
        if (i + 1) % cut == 0:
            ranks = stage(ranks, "ranks")
    return ranks.groupBy("host").agg(F.sum(F.when(F.col("good"), F.col("rank"))).alias("trust"), F.sum(F.when(~F.col("good"), F.col("rank"))).alias("distrust")).na.fill(0.0, ["trust", "distrust"])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, block_ratio: float = 2.0, url_col: str = "url", html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for every page.

    A page under a rule gets the rule's verdict. Any other page gets that of its host: block if distrust is
    over ``block_ratio`` times trust, else allow. Hosts that no seed reaches, and empty hosts, are allowed.
    Null urls and html count as empty; repeated pages weigh as often as they occur.
    """
    host, path = split_url(F.col(f"`{url_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"), F.col(f"`{html_col}`").alias("html"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"))
    share = lambda v: (F.count(F.when(F.col("ruled") == v, 1)) / F.count(F.lit(1))).alias
    seeds = ruled.filter("host != ''").groupBy("host").agg(share("allow")("trusted"), share("block")("blocked"))
    scores = stage(propagate(host_edges(rows), seeds), "scores")
    joined = ruled.join(scores, "host", "left").na.fill(0.0, ["trust", "distrust"])
    by_host = F.when(F.col("distrust") > block_ratio * F.col("trust"), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"), "trust", "distrust")
