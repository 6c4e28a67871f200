"""What the operators of this subpackage share: word patterns, guarded joins, block counts."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.session import staged

#: The white space that separates words, as a character set for trimming and as a pattern.
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A side is broadcast only up to this many rows (of at most a few dozen bytes each).
BROADCAST_ROWS = 500_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; a null or blank text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts, from which the operators derive how many blocks they use."""
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs started inside hand at most ``rows`` rows at a time to Python: whole texts are wide."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def guarded_join(
    df: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "left", salt: Column | None = None, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Join ``side`` (one row per key) to ``df``; nulls in keys match.

    ``side`` is written once and counted. Up to ``max_rows`` rows it is broadcast. Beyond that both
    sides are shuffled, with each row of ``side`` repeated for 32 salts and the rows of ``df`` dealt
    over them by ``salt``, so a key with a third of all rows spreads over 32 tasks.
    """
    side = staged(side, "side")
    names = [f"_key{i}" for i in range(len(keys))]
    side = side.withColumnsRenamed(dict(zip(keys, names)))
    condition = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    if side.count() <= max_rows:
        return df.join(F.broadcast(side), condition, how).drop(*names)
    parts = 32
    df = df.withColumn("_salt", F.pmod(F.xxhash64(salt if salt is not None else F.rand(7)), F.lit(parts)))
    side = side.withColumn("_dealt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
    return df.join(side, [*condition, F.col("_salt") == F.col("_dealt")], how).drop(*names, "_salt", "_dealt")
