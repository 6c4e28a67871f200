"""Incremental ingest: new vector files are quantized with frozen bounds and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearfield.functions import vectors as V
from nearfield.operators.ann import assign_cells
from nearfield.operators.knn import vectors_size
from nearfield.sources import cell_index


def stream_ingest(
    source: DataFrame,
    table: str,
    bounds_table: str,
    checkpoint: str,
    vmin: float,
    vmax: float,
    pivots: DataFrame | None = None,
    overflow: str = "clamp",
    dim: int | None = None,
) -> StreamingQuery:
    """Quantize a stream of ``(doc_id, vector, …)`` rows and append it, batch by batch.

    Each micro-batch overwrites its own ``batch_id`` partition, so a batch that is replayed after
    a failure leaves the same rows once. Rows without a searchable vector, or of another dimension
    than ``dim``, stay out and are counted; the counts and the batch's own bounds are recorded next
    to it, see ``observed_bounds``. All of that comes from one pass over the batch. With ``pivots``
    every row gets its index cell, ``dim`` is theirs, and ``table`` is a ``cell_index`` whose
    generations are the batches. Runs until the available files are taken; a later call with the
    same checkpoint goes on from there.
    """
    if pivots is not None and dim is None:
        dim = vectors_size(pivots)["dim"]

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        ok = V.is_valid(F.col("vector"), dim)
        good = F.when(ok, F.col("vector"))
        tested = batch.observe(
            seen,
            F.count_if(ok).alias("n_rows"),
            F.count_if(~ok).alias("n_rejected"),
            F.min(F.array_min(good)).alias("vmin"),
            F.max(F.array_max(good)).alias("vmax"),
        )
        quantized = tested.filter(ok).withColumn(
            "qvector", V.quantize_int8_batches(F.col("vector"), F.lit(vmin), F.lit(vmax), overflow)
        )
        if pivots is not None:
            cell_index.write_generation(assign_cells(quantized, pivots), table, batch_id, lambda: seen.get["n_rejected"])
        else:
            _put(quantized, table, batch_id)
        entry = [tuple(seen.get[name] for name in ("vmin", "vmax", "n_rows", "n_rejected"))]
        _put(batch.sparkSession.createDataFrame(entry, "vmin float, vmax float, n_rows long, n_rejected long"), bounds_table, batch_id)

    return (
        source.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _put(df: DataFrame, path: str, batch_id: int) -> None:
    """Replace one batch's partition of a table."""
    tagged = df.withColumn("batch_id", F.lit(batch_id).cast("long"))
    writer = tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("batch_id").parquet(path)


def observed_bounds(spark: SparkSession, bounds_table: str, vmin: float, vmax: float) -> DataFrame:
    """One row: rows and bounds seen so far, and whether they left the frozen ``[vmin, vmax]``."""
    seen = spark.read.parquet(bounds_table).agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_rejected").alias("n_rejected"),
        F.min("vmin").alias("vmin"),
        F.max("vmax").alias("vmax"),
    )
    lo, hi = F.lit(vmin).cast("float"), F.lit(vmax).cast("float")
    return seen.withColumn("drifted", (F.col("vmin") < lo) | (F.col("vmax") > hi))
