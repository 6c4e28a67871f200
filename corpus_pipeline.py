"""The corpus pipeline: filter, deduplicate, mix and pack the documents of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import jaccard_forest, mixing, ngram_quality, packing, suffix_dedup
from nearfield.session import scratch_path

#: Rows and bytes per Arrow batch in all stages. Texts are wide: with Spark's default of 10,000 rows the
#: batches of a long-lived executor hold some hundred MB on both sides.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20

#: Bytes of a repeat that goes, and of the run that anchors it: a passage of 51 words of three letters
#: with their spaces is 203 bytes long.
REPEAT, REPEAT_GRAM = 200, 48


def narrow_batches(spark: SparkSession) -> None:
    """A setting of the session, since a stage's frame runs after its function has returned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the n-gram model keeps; the labels of ``sf_dir`` say which text is trusted."""
    narrow_batches(spark)
    return ngram_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    narrow_batches(spark)
    return jaccard_forest.one_of_each(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of ``REPEAT`` bytes or more that occur more than once."""
    narrow_batches(spark)
    return suffix_dedup.clean(docs, REPEAT, REPEAT_GRAM)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids by piece of a document."""
    narrow_batches(spark)
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", repeat_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Tokenization and the n-gram model have no counterpart in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
