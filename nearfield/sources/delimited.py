"""Tab-separated vector files: 2-column and 3-column readers, numbered lines, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions import vectors as V

_BROADCAST_SPLITS = 20_000  # scan tasks up to which the split table is broadcast


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(ordinal, value)``: text lines numbered from 0 in file order.

    Rows are counted per file split where they are read; only the split sizes are added up, and
    that table of one row per split is broadcast unless the scan has very many splits.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"),
    )
    splits = lines.groupBy("_file", "_start").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy(natural_key(F.col("_file")), "_start").rowsBetween(Window.unboundedPreceding, -1)
    base = splits.select("_file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    if lines.rdd.getNumPartitions() <= _BROADCAST_SPLITS:
        base = F.broadcast(base)
    numbered = lines.join(base, ["_file", "_start"])
    return numbered.select((F.col("_base") + F.col("_row") - F.col("_first")).alias("ordinal"), "value")


def natural_key(name: Column) -> Column:
    """A name as a sort key in which its numbers count as numbers, as far as 20 digits."""
    parts = F.split(name, r"(?<=\D)(?=\d)|(?<=\d)(?=\D)")
    return F.transform(parts, lambda x: F.when(x.rlike(r"^\d{1,20}$"), F.lpad(x, 20, "0")).otherwise(x))


def _columns(value: Column) -> Column:
    """Tab-separated parts without trailing empty ones."""
    return F.split(F.regexp_replace(value, r"\t+$", ""), "\t", -1)


def read_pairs(lines: DataFrame, title_col: int = 1, vector_col: int = 2, value: str = "value") -> DataFrame:
    """``title <tab> v1,v2,…`` lines as ``(…, title, vector)``; no row is dropped.

    Column positions count from 1. A line without the vector column gets a null vector, which
    ``split_valid`` reports.
    """
    parts = _columns(F.col(value))
    others = [c for c in lines.columns if c != value]
    return lines.select(
        *others,
        F.get(parts, F.lit(title_col - 1)).alias("title"),
        V.parse_floats(F.get(parts, F.lit(vector_col - 1))).alias("vector"),
    )


def read_triples(lines: DataFrame, strict: bool = False, value: str = "value") -> DataFrame:
    """``id <tab> ignored <tab> v1,v2,…`` lines as ``(…, unique_id, vector)``.

    ``strict`` keeps only lines with exactly three columns, trailing empty ones not counted, and
    parses straight to float; otherwise every line stays and numbers narrow from double.
    """
    parts = _columns(F.col(value))
    others = [c for c in lines.columns if c != value]
    if strict:
        lines = lines.filter(F.size(parts) == 3)
    return lines.select(
        *others,
        F.get(parts, F.lit(0)).alias("unique_id"),
        V.parse_floats(F.get(parts, F.lit(2)), via_double=not strict).alias("vector"),
    )


def export_tsv(df: DataFrame, path: str, title_col: str = "title", vector_col: str = "vector") -> None:
    """Write ``title <tab> v1,v2,…`` lines, one file per partition.

    Tabs and line breaks inside a title become spaces and a null title is empty, so every line
    keeps two columns.
    """
    title = F.coalesce(F.regexp_replace(F.col(title_col).cast("string"), r"[\t\r\n]", " "), F.lit(""))
    line = F.concat_ws("\t", title, V.format_floats(F.col(vector_col)))
    df.select(line.alias("value")).write.mode("overwrite").text(path)
