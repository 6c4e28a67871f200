"""URL filters: rules, and link-graph propagation of trust and distrust for what no rule fits.

Hosts whose pages the rules allow are trusted seeds, hosts whose pages they block are blocked
seeds, each with the share of its judged pages as its mass. Personalised PageRank carries trust
along links between hosts and distrust against them; a host is blocked when distrust is more than
``threshold`` of the sum of both. A host that neither reaches is allowed.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and
is allowed unless links say otherwise (nothing links to the empty host). A null html has no links.
Repeated rows count as repeated pages. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import guarded_join
from nearfield.session import staged

#: (verdict, rule); a rule is a host and the start of a path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
DAMPING = 0.85
ROUNDS = 10
THRESHOLD = 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?((?:https?:)?//[^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null."""
    chain = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return F.lit(None).cast("struct<rule: string, verdict: string>") if chain is None else chain


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, summed over pages."""
    links = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(LINK), 1)
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(links).alias("link"))
    dst = F.translate(F.regexp_extract("link", "//(.*)$", 1), UPPER, LOWER)
    edges = found.select("src", dst.alias("dst")).where("src != '' and dst != '' and src != dst")
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def seeds(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(host, trust, distrust): shares of a host's judged pages, for hosts with a judged page."""
    judged = pages.select(
        host_of(F.col("url")).alias("host"), fitting_rule(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"].alias("v")
    ).where("v is not null")
    share = lambda v: F.sum((F.col("v") == v).cast("long")).cast("double") / F.count(F.lit(1))
    return judged.groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))


def propagate(edges: DataFrame, masses: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) after ``rounds`` of personalised PageRank from ``masses``.

    Both ranks travel in one frame: trust from source to target, distrust from target to source,
    each edge carrying its share of what its start sends out. Lineage is cut every third round.
    """
    ways = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "n").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "n")
    )
    out = ways.groupBy("kind", "a").agg(F.sum("n").alias("out"))
    ways = staged(ways.join(out, ["kind", "a"]).select("kind", "a", "b", (F.col("n") / F.col("out")).alias("share")), "host-edges")
    start = masses.select("host", F.expr("stack(2, 'trust', trust, 'distrust', distrust) as (kind, mass)")).where("mass > 0")
    start = staged(start.select("kind", "host", F.col("mass") * (1 - damping)), "host-seeds").toDF("kind", "host", "mass")
    ranks = start
    for turn in range(rounds if not ways.isEmpty() else 0):
        moved = ranks.withColumnRenamed("host", "a").join(ways, ["kind", "a"]).select(
            "kind", F.col("b").alias("host"), (F.col("mass") * F.col("share") * damping).alias("mass")
        )
        ranks = moved.unionByName(start).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        if turn % 3 == 2:
            ranks = staged(ranks, "host-ranks")
    part = lambda k: F.sum(F.when(F.col("kind") == k, F.col("mass")).otherwise(0.0))
    return ranks.groupBy("host").agg(part("trust").alias("trust"), part("distrust").alias("distrust"))


def judge(
    pages: DataFrame,
    rules: tuple[tuple[str, str], ...] = RULES,
    rounds: int = ROUNDS,
    damping: float = DAMPING,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = judged.withColumn("found", fitting_rule(F.col("host"), F.col("path"), rules))
    scores = propagate(host_edges(pages), seeds(pages, rules), rounds, damping)
    bad = F.round(F.col("distrust"), 9) > F.round(threshold * (F.col("trust") + F.col("distrust")), 9)
    hosts = scores.select("host", F.when(bad, "block").otherwise("allow").alias("by_links"), "trust", "distrust")
    joined = guarded_join(judged, hosts, ["host"], "left", salt=F.col("page_id"))
    return joined.select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), F.col("by_links"), F.lit("allow")).alias("verdict"),
    )
