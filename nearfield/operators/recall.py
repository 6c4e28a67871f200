"""Agreement of two searches and summaries of measured latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIT_KEY = ["query_id", "doc_id"]


def matched_hits(truth: DataFrame, candidate: DataFrame) -> DataFrame:
    """Distinct ``(query_id, doc_id)`` pairs of the candidate that the truth holds too."""
    return candidate.select(*HIT_KEY).distinct().join(truth.select(*HIT_KEY), HIT_KEY, "left_semi")


def recall_per_query(truth: DataFrame, candidate: DataFrame, k: int) -> DataFrame:
    """``(query_id, matched, recall)`` for every query of the truth, also those with no match.

    Both hit lists are read once and met by grouping, so neither search runs twice.
    """
    tagged = truth.select(*HIT_KEY, F.lit(1).alias("t"), F.lit(0).alias("c")).unionAll(
        candidate.select(*HIT_KEY, F.lit(0).alias("t"), F.lit(1).alias("c"))
    )
    pairs = tagged.groupBy(*HIT_KEY).agg(F.max("t").alias("t"), F.max("c").alias("c"))
    counts = pairs.groupBy("query_id").agg(
        F.sum(F.col("t") * F.col("c")).cast("long").alias("matched"), F.max("t").alias("known")
    )
    return counts.filter("known = 1").select("query_id", "matched", (F.col("matched") / F.lit(float(k))).alias("recall"))


def recall_at_k(truth: DataFrame, candidate: DataFrame, k: int, n_queries: int | None = None) -> DataFrame:
    """One row ``(n_queries, matched, recall)``: matches over ``k`` per query.

    The number of queries is counted from the truth; pass ``n_queries`` for a fixed denominator.
    """
    counts = recall_per_query(truth, candidate, k)
    total = F.count("*") if n_queries is None else F.lit(n_queries).cast("long")
    summed = counts.agg(total.alias("n_queries"), F.coalesce(F.sum("matched"), F.lit(0)).cast("long").alias("matched"))
    return summed.withColumn("recall", F.col("matched") / (F.lit(float(k)) * F.col("n_queries")))


def ids_per_query(hits: DataFrame) -> DataFrame:
    """``(query_id, doc_ids)``: the sorted id set of every query's hits (at most k each)."""
    return hits.groupBy("query_id").agg(F.sort_array(F.collect_set("doc_id")).alias("doc_ids"))


def margin_of_error(stddev: Column, n: Column) -> Column:
    """Half width of the 95 % interval of a mean."""
    return F.lit(1.96) * stddev / F.sqrt(n)


def margin_of_error_proportion(mean: Column, n: Column) -> Column:
    """Half width of the 95 % interval of a proportion; NaN for a mean outside [0, 1]."""
    spread = mean * (F.lit(1.0) - mean) / n
    return F.when(spread < 0, F.lit(float("nan"))).otherwise(F.lit(1.96) * F.sqrt(spread))


def latency_summary(df: DataFrame, latency_ms: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, total seconds and both margins of error of a latency column."""
    ms = F.col(latency_ms)
    stats = df.groupBy(*(by or [])).agg(
        F.count(ms).alias("n"),
        F.avg(ms).alias("mean_ms"),
        (F.sum(ms) / 1000.0).alias("total_s"),
        F.stddev_samp(ms).alias("_stddev"),
    )
    return stats.select(
        *(by or []),
        "n",
        "mean_ms",
        "total_s",
        margin_of_error(F.col("_stddev"), F.col("n")).alias("moe"),
        margin_of_error_proportion(F.col("mean_ms"), F.col("n")).alias("moe_proportion"),
    )


def peak_gauge(df: DataFrame, gauge: str, by: list[str] | None = None) -> DataFrame:
    """Largest sample of a gauge, such as bytes in use."""
    return df.groupBy(*(by or [])).agg(F.max(gauge).alias("peak"))
