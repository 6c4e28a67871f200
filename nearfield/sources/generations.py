"""Tables that grow by generations: which of them are complete, and which count.

An index keeps its rows in folders by generation. A generation is entered here after all of its rows
are written, and readers take only generations with an entry. An entry may name older ones that it
folds; those count no longer. Entering a number again replaces its entry, so a step that is repeated
after a failure leaves no trace.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: ``n_rows`` went in, ``n_out`` were rejected or marked as deleted; ``has`` names optional parts.
ENTRY = "generation long, n_rows long, n_out long, vmin float, vmax float, folds array<long>, has array<string>"


def enter(
    spark: SparkSession,
    path: str,
    generation: int,
    n_rows: int,
    n_out: int = 0,
    folds: tuple[int, ...] = (),
    vmin: float | None = None,
    vmax: float | None = None,
    has: tuple[str, ...] = (),
) -> None:
    made = spark.createDataFrame([(generation, n_rows, n_out, vmin, vmax, list(folds), list(has))], ENTRY).coalesce(1)
    made.write.mode("overwrite").parquet(f"{path}/generations/entry={generation}")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """All entries; none where nothing was entered yet."""
    try:
        return spark.read.schema(ENTRY).parquet(f"{path}/generations")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ENTRY)


def counting(spark: SparkSession, path: str) -> DataFrame:
    """Entries that no other one folds."""
    known = entries(spark, path)
    return known.join(known.select(F.explode("folds").alias("generation")), "generation", "left_anti")


def complete(spark: SparkSession, path: str) -> list[Row]:
    """The entries that count, brought here: there is one per generation."""
    known = entries(spark, path).collect()
    folded = {g for r in known for g in r["folds"]}
    return sorted((r for r in known if r["generation"] not in folded), key=lambda r: r["generation"])


def live(spark: SparkSession, path: str) -> list[int]:
    return [r["generation"] for r in complete(spark, path)]


def highest(spark: SparkSession, path: str) -> int:
    """The largest number entered so far, -1 for none."""
    return entries(spark, path).agg(F.coalesce(F.max("generation"), F.lit(-1))).first()[0]


def vacuum(spark: SparkSession, path: str, *folders: str) -> int:
    """Delete the files of folded generations in ``folders`` (patterns below ``path`` that hold
    ``generation=…`` folders), once no reader needs them; returns how many folders went."""
    jvm = spark.sparkContext._jvm
    gone = [r[0] for r in entries(spark, path).select(F.explode("folds")).distinct().collect()]
    removed = 0
    for folder in folders:
        for number in gone:
            pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}/generation={number}")
            store = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            for status in store.globStatus(pattern) or []:
                removed += store.delete(status.getPath(), True)
    return removed
