"""Registered metric queries: ``events.value`` stands in for latency and gauge samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.operators import recall


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.round(c, 4).alias(c) if c in names else c for c in df.columns))


def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Both margins of error per event type; the share of a day keeps the mean a proportion."""
    samples = _events(spark, sf).withColumn("share", F.col("value") / (F.lit(1.0) + F.abs("value")))
    ms = recall.latency_summary(samples, "value", by=["event_type"])
    share = recall.latency_summary(samples, "share", by=["event_type"]).select(
        "event_type", F.col("moe_proportion").alias("share_moe")
    )
    both = ms.drop("moe_proportion").join(share, "event_type")
    return _rounded(both, "mean_ms", "total_s", "moe", "share_moe")


def latency_total(spark: SparkSession, sf: str) -> DataFrame:
    """Over all events; the mean is no proportion, so that margin is not a number."""
    total = recall.latency_summary(_events(spark, sf), "value")
    flagged = total.withColumn("has_moe_proportion", ~F.isnan("moe_proportion")).drop("moe_proportion")
    return _rounded(flagged, "mean_ms", "total_s", "moe")


def peak_gauge(spark: SparkSession, sf: str) -> DataFrame:
    """Peak sample per user, read as KiB and reported in whole MiB too."""
    sampled = _events(spark, sf).withColumn("n_bytes", F.floor(F.col("value") * 1024 * 1024).cast("long"))
    peaks = recall.peak_gauge(sampled, "n_bytes", by=["user_id"])
    return peaks.withColumn("peak_mb", V.megabytes(F.col("peak")))


QUERIES = {fn.__name__: fn for fn in (latency_summary, latency_total, peak_gauge)}

ORACLES = {
    "latency_summary": """SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean_ms,
  round(sum(value) / 1000, 4) AS total_s, round(1.96 * stddev_samp(value) / sqrt(count(value)), 4) AS moe,
  round(1.96 * sqrt(avg(value / (1 + abs(value))) * (1 - avg(value / (1 + abs(value)))) / count(value)), 4) AS share_moe
FROM events GROUP BY event_type""",
    "latency_total": """SELECT count(value) AS n, round(avg(value), 4) AS mean_ms, round(sum(value) / 1000, 4) AS total_s,
  round(1.96 * stddev_samp(value) / sqrt(count(value)), 4) AS moe,
  avg(value) BETWEEN 0 AND 1 AS has_moe_proportion FROM events""",
    "peak_gauge": """SELECT user_id, max(floor(value * 1024 * 1024)::BIGINT) AS peak,
  max(floor(value * 1024 * 1024)::BIGINT) // 1048576 AS peak_mb FROM events GROUP BY user_id""",
}
