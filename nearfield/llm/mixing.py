"""Mixing sources to target weights: repetition rates per source, copies per document.

Sizes are summed per source (partial sums first, so a hot source is one row per task), targets
follow from the weights, and every document is taken floor(rate) times plus one copy drawn with
the fraction as its probability. The draw is a hash of seed, id and text: reruns and repeated rows
agree.

Defined results: null text has size 0; a null source is a source of its own, the last; a source
without words has target 0 and rate 0. Extra columns are carried by ``mix`` under their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import SPACE, SPACES, guarded_join

CAP = 3
SEED = "mix-1"


def size_of(text: Column) -> Column:
    """Number of words of a text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACES))).cast("long")


def targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Weights are 1, 2, 3 repeating over the sources by code point, null last. Levels rise together
    until a source meets ``cap`` times its size: ordered by cap per weight, the sources before the
    first one that stays under its cap are the capped ones, and the rest share what is left. The
    windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = per.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("long")).withColumn(
        "limit", F.col("source_size") * cap
    )
    rising = Window.orderBy(F.col("limit").cast("double") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    level = left.cast("double") / F.sum("weight").over(onward).cast("double")
    leveled = weighted.withColumn("level", level).withColumn("place", F.row_number().over(rising))
    under = F.col("level") * F.col("weight") <= F.col("limit")
    final = F.min(F.when(under, F.struct("place", "level"))).over(whole)
    shared = final["level"] * F.col("weight")
    return leveled.select("source", "source_size", F.least(shared, F.col("limit").cast("double")).alias("target"))


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on seed, id and text alone."""
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def rates(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` as the struct ``row`` with size, source_size, target and copies."""
    sized = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("source").alias("source"), size_of(F.col("text")).alias("size")
    )
    joined = guarded_join(sized, targets(sized.select("source", "size")), ["source"], "left", salt=F.col("row.doc_id"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = draw(F.col("row.doc_id"), F.col("row.text")) < rate - F.floor(rate)
    return joined.select("row", "size", "source_size", "target", (F.floor(rate) + extra.cast("long")).alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each document as often as its copies say, columns unchanged."""
    taken = rates(docs).where("copies > 0")
    repeated = taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
    return repeated.select("row.*")
