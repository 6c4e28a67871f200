"""JSON vector files, parquet datasets and literal rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import vectors as V

COLUMNAR_SCHEMA = "_id array<string>, url array<string>, title array<string>, text array<string>, emb array<array<double>>"


def read_columnar_json(spark: SparkSession, path: str) -> DataFrame:
    """A file of parallel lists as rows ``(file, ordinal, title, vector)``.

    Titles and embeddings pair by position up to the shorter list. Only those two lists are
    parsed. One file is one task, since the lists of a file form one JSON value.
    """
    raw = spark.read.schema(COLUMNAR_SCHEMA).option("multiLine", True).json(path)
    return zip_columns(raw.select(F.col("_metadata.file_path").alias("file"), "title", "emb"), ["file"])


def zip_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Pair ``title`` and ``emb`` lists by position, up to the shorter one."""
    n = F.least(F.size("title"), F.size("emb"))
    pairs = F.arrays_zip(F.slice("title", F.lit(1), n).alias("title"), F.slice("emb", F.lit(1), n).alias("emb"))
    rows = df.select(*keep, F.posexplode(pairs).alias("ordinal", "pair"))
    return rows.select(
        *keep,
        F.col("ordinal").cast("long").alias("ordinal"),
        F.col("pair.title").alias("title"),
        V.to_float(F.col("pair.emb")).alias("vector"),
    )


def read_query_json(spark: SparkSession, path: str, query_id: int = 0) -> DataFrame:
    """A ``{"emb": […]}`` file as a one-row query table ``(query_id, vector)``."""
    raw = spark.read.schema("emb array<double>").option("multiLine", True).json(path)
    return raw.select(F.lit(query_id).cast("long").alias("query_id"), V.to_float(F.col("emb")).alias("vector"))


def read_dataset(spark: SparkSession, path: str, split: str | None = None, subset: str | None = None) -> DataFrame:
    """Title and embedding of a parquet dataset; split and subset prune partition folders."""
    df = spark.read.parquet(path)
    if subset is not None:
        df = df.filter(F.col("subset") == subset)
    if split is not None:
        df = df.filter(F.col("split") == split)
    return df.select("title", V.to_float(F.col("emb")).alias("vector"))


def vector_rows(spark: SparkSession, rows: Sequence[tuple[str, Sequence[float]]]) -> DataFrame:
    """Literal ``(title, vector)`` documents, numbered in order."""
    data = [(i, title, [float(x) for x in vector]) for i, (title, vector) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, title string, vector array<float>")


def text_rows(spark: SparkSession, rows: Sequence[tuple[str, str]]) -> DataFrame:
    """Literal ``(title, isbn)`` documents, numbered in order."""
    data = [(i, title, isbn) for i, (title, isbn) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, title string, isbn string")
