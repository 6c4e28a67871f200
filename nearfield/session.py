"""Session helpers: local sessions for tests and benches, and the shared scratch folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, shuffle_partitions: int | None = None, memory: str = "12g") -> SparkSession:
    """A single-JVM session for tests and benches; clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("nearfield")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="nearfield-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder for intermediate tables, under the shared folder the session names.

    ``spark.checkpoint.dir`` is what the cluster sets. Only a local session without it falls
    back to a folder of this machine; on a cluster that would not be visible to the executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = _local_folder()
    return f"{base.rstrip('/')}/nearfield/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df`` written once to the scratch folder and read back.

    For a costly result that the next step evaluates more than once (range partitioning samples
    its input before it shuffles it) or that must survive the loss of executors.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def file_count(spark: SparkSession, n_bytes: int, file_bytes: int = 128 << 20) -> int:
    """Files for a table of this size: about ``file_bytes`` each, and at least as many as the cluster
    has slots, so that a small table is still written by all of them."""
    return max(spark.sparkContext.defaultParallelism, -(-n_bytes // file_bytes))


def stored_bytes(stored: DataFrame) -> int:
    """Size of the files behind a table that is read from them."""
    files = stored.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b")).distinct()
    return files.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()["b"]


def widen(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a scan with fewer splits than the cluster has slots (one row group, few files).

    A table with enough splits comes back untouched, so large inputs pay no shuffle here.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots, *keys)
