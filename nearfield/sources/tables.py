"""Vector tables in parquet: append, row selection, compaction."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.session import staged, stored_bytes

DEFAULT_TITLE = "title"


def with_title(df: DataFrame) -> DataFrame:
    """Add the constant title that untitled vector files get."""
    return df if "title" in df.columns else df.withColumn("title", F.lit(DEFAULT_TITLE))


def append_vectors(df: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Append documents to a vector table, sorted by id within files so that id filters prune."""
    df.sortWithinPartitions(id_col).write.mode("append").parquet(path)


def explode_vectors(df: DataFrame, vectors_col: str = "vectors", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Documents with several vectors as child rows ``(…, vec_no, vector)``.

    Search them with ``knn(..., per_owner=True)``, which ranks a document by its nearest vector.
    """
    return df.select(*keep, F.posexplode(vectors_col).alias("vec_no", "vector"))


def row_range(df: DataFrame, start: int = 0, stop: int | None = None, ordinal_col: str = "ordinal") -> DataFrame:
    """Rows with ``start <= ordinal < stop``; a plain filter, so it reaches the scan.

    ``stop`` None or negative means no cap.
    """
    if start:
        df = df.filter(F.col(ordinal_col) >= start)
    return df if stop is None or stop < 0 else df.filter(F.col(ordinal_col) < stop)


def first_rows(df: DataFrame, n: int | None, order_col: str, ranges: int | None = None) -> DataFrame:
    """The n smallest rows by a key, nulls first; None or negative keeps all.

    The keys alone are dealt into ranges and counted; sums of the counts tell which range holds the
    n-th key, and only that range's keys are sorted. What comes back is a filter on the key, which
    reaches the scan. Among rows with the n-th key itself any may be taken.
    """
    if n is None or n < 0:
        return df
    key = F.col(order_col)
    nulls = df.filter(key.isNull())
    n_null = nulls.count()
    if n <= n_null:
        return nulls.limit(n)
    spark = df.sparkSession
    keys = staged(df.select(key.alias("k")).filter("k IS NOT NULL"), "keys")
    parts = ranges or 4 * spark.sparkContext.defaultParallelism
    # Equal keys fall into one range.
    dealt = keys.repartitionByRange(parts, "k").withColumn("range", F.spark_partition_id())
    counts = dealt.groupBy("range").agg(F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high"))
    left = n - n_null
    for r in counts.orderBy("low").collect():  # one row per range
        if left > r["n"]:
            left -= r["n"]
            continue
        within = keys.filter(F.col("k").between(r["low"], r["high"]))
        last = within.orderBy("k").limit(left).agg(F.max("k")).first()[0]
        same = left - within.filter(F.col("k") < F.lit(last)).count()
        below = df.filter(key.isNull() | (key < F.lit(last))) if n_null else df.filter(key < F.lit(last))
        at = df.filter(key == F.lit(last))
        return below.unionByName(at if same == at.count() else at.limit(same))
    return df


def compact_table(spark: SparkSession, source: str, target: str, key: str, file_bytes: int = 256 << 20) -> int:
    """Rewrite a table into few files of about ``file_bytes``, ranged and sorted by ``key``.

    Returns the number of files asked for. The row content does not change.
    """
    df = spark.read.parquet(source)
    n = max(1, math.ceil(stored_bytes(df) / file_bytes))
    df.repartitionByRange(n, key).sortWithinPartitions(key).write.mode("overwrite").parquet(target)
    return n
