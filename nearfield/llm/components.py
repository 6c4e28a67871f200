"""Connected components of a link table, in a number of rounds that grows with its logarithm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.session import staged


def _least(links: DataFrame) -> DataFrame:
    """(u, v, m): every directed link with the least of u and its neighbours."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return links.join(least, F.col("u") == F.col("k")).select("u", "v", "m")


def _only_stars(links: DataFrame) -> bool:
    """Whether every node of ``links`` (a > b) is either the root of others or has one root."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(
        links.select(F.col("b").alias("node"), F.lit(0).alias("up"))
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return nodes.where((F.col("ups") > 1) | ((F.col("ups") == 1) & (F.col("least") == 0))).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, for the nodes of ``links`` (a, b).

    Alternates two steps on the links until only stars are left: every node hands its larger
    neighbours to its least one, then every node hands its smaller neighbours to the least of them.
    Both keep components as they are, so a star is a whole one. Each round is written, which cuts
    the lineage.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        e.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    current = staged(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _only_stars(current):
        large = _least(both(current)).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = _least(large.select(F.col("a").alias("u"), F.col("b").alias("v")))
        small = down.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(down.select(F.col("u").alias("a"), F.col("m").alias("b")))
        current = staged(small.where("a != b").distinct(), "links")
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
