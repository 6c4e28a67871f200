"""A cell index that grows: generations of rows, a list of what is complete, compaction.

``rows`` holds the vectors by (cell, generation), ``generations`` one entry per complete generation.
A generation's rows are written first and its entry last, and readers take only generations with an
entry, so a half-written one is never seen. Writing a generation again replaces its own files and
nothing else: a batch that is replayed leaves its rows once. Compaction folds complete generations
into a new one, whose entry names those it replaces; their files stay, unread, until ``vacuum``.

Rows of a generation are laid into one file per cell, or as many as a cell fills: the rows of a cell
that holds a third of them go through many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators.bounds import vector_bounds
from nearfield.session import staged
from nearfield.sources import generations

FILE_BYTES = 256 << 20


def write_generation(
    rows: DataFrame,
    path: str,
    generation: int,
    n_rejected: int | Callable[[], int] = 0,
    folds: tuple[int, ...] = (),
    file_bytes: int = FILE_BYTES,
) -> int:
    """Write ``rows (cell, doc_id, vector, …)`` as a generation and enter it; returns their number.

    ``rows`` is evaluated once; a count of rejected rows that is only known then may be a function.
    Counting the cells of what was written first tells how many files each of them gets.
    """
    spark = rows.sparkSession
    rows = staged(rows.drop("generation"), "generation")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(1)).alias("dim")).first()
    per_file = max(1, file_bytes // (4 * max(1, size["dim"])))
    # One row per cell, few beside the rows.
    cells = rows.groupBy("cell").agg(F.ceil(F.count("*") / per_file).cast("int").alias("_files"))
    dealt = rows.join(cells, "cell").withColumn("_file", F.pmod(F.xxhash64("doc_id"), F.col("_files")).cast("int"))
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(size["n"] / per_file))
    laid = dealt.repartition(tasks, "cell", "_file").drop("_file", "_files").withColumn("generation", F.lit(generation).cast("long"))
    writer = laid.sortWithinPartitions("cell", "doc_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("cell", "generation").parquet(f"{path}/rows")
    seen = vector_bounds(rows).first()
    out = n_rejected() if callable(n_rejected) else n_rejected
    generations.enter(spark, path, generation, size["n"], out, folds, seen["vmin"], seen["vmax"])
    return size["n"]


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all generations that count; a search adds its cells to the same partition filter."""
    return spark.read.parquet(f"{path}/rows").filter(F.col("generation").isin(generations.live(spark, path))).drop("generation")


def compact(spark: SparkSession, path: str, file_bytes: int = FILE_BYTES) -> int | None:
    """Fold the generations that count into one, with few files a cell; its number, or None if there
    is nothing to fold. Generations entered meanwhile are not touched."""
    old = generations.counting(spark, path).agg(F.collect_list("generation").alias("all"), F.sum("n_out").alias("n_out")).first()
    folds = sorted(old["all"])
    if len(folds) < 2:
        return None
    # Numbers below zero are compactions, so they never meet those of a stream's batches.
    number = min(0, generations.entries(spark, path).agg(F.min("generation")).first()[0]) - 1
    rows = spark.read.parquet(f"{path}/rows").filter(F.col("generation").isin(folds))
    write_generation(rows, path, number, old["n_out"], tuple(folds), file_bytes)
    return number


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the files of folded generations; see ``generations.vacuum``."""
    return generations.vacuum(spark, path, "rows/cell=*")
