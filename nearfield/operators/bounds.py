"""Corpus-wide statistics of vector tables and int8 quantization with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions import vectors as V


def vector_bounds(df: DataFrame, vector_col: str = "vector", *extra: Column) -> DataFrame:
    """One row ``(vmin, vmax)``: smallest and largest element of all vectors, NaN left out.

    Built-in array aggregates run on every row; the element filter only on rows with a NaN.
    ``extra`` aggregates are computed in the same pass.
    """
    v = F.col(vector_col)
    clean = F.when(F.isnan(F.array_max(v)), F.filter(v, lambda x: ~F.isnan(x))).otherwise(v)
    return df.agg(
        F.min(F.array_min(clean)).cast("float").alias("vmin"),
        F.max(F.array_max(clean)).cast("float").alias("vmax"),
        *extra,
    )


def frozen_bounds(df: DataFrame, vector_col: str = "vector") -> DataFrame:
    """The bounds computed now, as a one-row table of constants.

    Use it when several plans share the bounds; the lazy form would scan the corpus in each.
    """
    row = vector_bounds(df, vector_col).first()
    return df.sparkSession.createDataFrame([tuple(row)], "vmin float, vmax float")


def quantize_table(
    df: DataFrame,
    bounds: DataFrame,
    vector_col: str = "vector",
    out_col: str = "qvector",
    overflow: str = "clamp",
) -> DataFrame:
    """Add the int8 form of a vector column, using a one-row ``(vmin, vmax)`` table.

    The bounds enter as a scalar subquery, so there is no join and no driver round trip. Pass the
    corpus bounds for queries too: both sides must share one scale.
    """
    pair = bounds.select(F.struct("vmin", "vmax").alias("pair")).scalar()
    widened = df.withColumn("_bounds", pair)
    quantized = V.quantize_int8_batches(F.col(vector_col), F.col("_bounds.vmin"), F.col("_bounds.vmax"), overflow)
    return widened.withColumn(out_col, quantized).drop("_bounds")


def vector_profile(df: DataFrame, vector_col: str = "vector") -> DataFrame:
    """Row count, smallest and largest dimension, and mean L2 norm of a vector table."""
    v = F.col(vector_col)
    squares = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return df.agg(
        F.count("*").alias("n_vectors"),
        F.min(F.size(v)).cast("long").alias("min_dim"),
        F.max(F.size(v)).cast("long").alias("max_dim"),
        F.avg(F.sqrt(squares)).alias("mean_norm"),
    )


def storage_footprint(df: DataFrame, vector_col: str = "vector", quantized_col: str = "qvector") -> DataFrame:
    """Raw vector bytes as float32 and as int8, and how many times smaller int8 is."""
    floats = F.sum(F.size(vector_col).cast("long") * 4)
    ints = F.sum(F.size(quantized_col).cast("long"))
    return df.agg(
        floats.alias("float_bytes"), ints.alias("int8_bytes"), (floats.cast("double") / ints).alias("ratio")
    )
