"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import (
    edit_fingerprints,
    jaccard_forest,
    lexical_search,
    mixing,
    ngram_quality,
    packing,
    quality_rules,
    secret_scan,
    substring_dedup,
    suffix_dedup,
    toxicity,
    url_trust,
    whitening,
)
from nearfield.llm.common import read
from nearfield.llm.oracles import ORACLES


def op1_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = ngram_quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("row.doc_id", "row.lang", "perplexity", "threshold", "kept")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = suffix_dedup.removals(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return removed.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = substring_dedup.removals(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return removed.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def op4_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints.fingerprint_with_edits(read(spark, sf_dir, "documents"))


def op5_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_forest.classes(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op6_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge(read(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.train(docs, read(spark, sf_dir, "labels")).score(docs)
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", predicted)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(read(spark, sf_dir, "documents")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules.quality_rules(read(spark, sf_dir, "documents")).select(*columns)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.rates(read(spark, sf_dir, "documents"))
    return mixed.select(
        "row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.report(read(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_ngram_quality": op1_ngram_quality,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_edit_fingerprints": op4_edit_fingerprints,
    "op5_jaccard_forest": op5_jaccard_forest,
    "op6_url_trust": op6_url_trust,
    "op7_toxicity": op7_toxicity,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_source_mix": op10_source_mix,
    "op11_lexical_search": op11_lexical_search,
    "op12_secret_scan": op12_secret_scan,
    "op13_whitening": op13_whitening,
}


