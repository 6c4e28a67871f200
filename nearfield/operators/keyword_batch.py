"""BM25 search of a whole table of query texts.

Every pair of a query and a document that share a frequent word gets a score, so the pairs are
never made into rows: each task scores its documents against the query block in memory and
sends on only the best n per query.

Documents are tokenized once. A first pass keeps of each document its length and the counts of the
words that any query asks for; these small rows are written, document frequencies are counted from
them, and the scoring tasks join them with the block, which is inverted by term.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions import text as X
from nearfield.operators.kernel import RunningTopK, ids_of
from nearfield.operators.keyword import FIELD_TOTALS, K1, B, build_index
from nearfield.operators.knn import BROADCAST_BYTES, CHUNK_BYTES, arrow_schema, fragments, hits_batch, small, top_k
from nearfield.session import staged

_TERM_BYTES = 48  # memory of one weighted query term
_SCORE_BUDGET = 8_000_000  # scores held at once
_PAIR_BUDGET = 4_000_000  # (posting, query) pairs added at once
_SPARSE = 8  # pairs are sorted where they fill less than this part of documents x queries


def search_batch(
    docs: DataFrame,
    queries: DataFrame,
    field: str,
    n: int = 10,
    *,
    id_col: str = "doc_id",
    query_id_col: str = "query_id",
    text_col: str = "text",
    lexicon: DataFrame | None = None,
    k1: float = K1,
    b: float = B,
    broadcast_bytes: int = BROADCAST_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Best n documents for any of a query text's tokens: ``(query_id, doc_id, rank, score)``.

    Ranks as ``search`` does with one ``match`` clause per query; a token that a query repeats
    counts as often. Pass the ``lexicon`` of a stored index to save a pass over the documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), X.tokenize(F.col(field)).alias("tokens"))
    schema = T.StructType(
        [T.StructField("query_id", queries.schema[query_id_col].dataType), rows.schema["doc_id"], T.StructField("value", T.DoubleType())]
    )
    arrow = arrow_schema(schema)
    typed = F.coalesce(F.sum(F.size(X.tokenize(F.col(text_col)))), F.lit(0))
    measured = queries.agg(typed.alias("terms"), F.count("*").alias("rows")).first()
    size = measured["terms"] * _TERM_BYTES
    if size <= broadcast_bytes:
        # The query block's size is checked; its terms and their lexicon rows are no more than it.
        typed = queries.select(F.col(query_id_col).alias("query_id"), F.explode(X.tokenize(F.col(text_col))).alias("term"))
        typed = typed.groupBy("query_id", "term").agg(F.count("*").alias("times")).toArrow()
        terms = pc.unique(typed["term"])
        folded = _folded(rows, spark.sparkContext.broadcast(terms))
        if lexicon is None:
            folded = staged(folded, "folded")
            words = _lexicon(folded, terms, field)
        else:
            asked = spark.createDataFrame(pa.table({"term": pa.concat_arrays([terms.cast(pa.string()), pa.array([FIELD_TOTALS])])}))
            words = lexicon.filter(F.col("field") == field).join(F.broadcast(asked), "term", "left_semi")
        packed = _inverted(typed, words.select("term", "n_docs", "n_tokens").toArrow(), terms)
        block = spark.sparkContext.broadcast(packed)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries_block = block.value
            top = RunningTopK(len(queries_block["ids"]), n)
            for batch in batches:
                codes = batch["codes"]
                doc = np.repeat(np.arange(batch.num_rows), np.diff(codes.offsets.to_numpy()))
                term = queries_block["of_code"][codes.flatten().to_numpy()] if len(doc) else np.zeros(0, np.int64)
                tf, known = batch["tfs"].flatten().to_numpy(), term >= 0
                _score(top, queries_block, ids_of(batch["doc_id"]), batch["doc_len"].to_numpy(), doc[known], term[known], tf[known], k1, b)
            yield hits_batch(top, queries_block["ids"], arrow)

        hits = folded.mapInArrow(scan, schema)
    else:
        words = (build_index(docs, [field], id_col).lexicon if lexicon is None else lexicon).filter(F.col("field") == field)
        weighted = _weighted(queries, words, query_id_col, text_col)
        chars = docs.agg(F.coalesce(F.sum(F.length(field)), F.lit(0)).alias("n")).first()["n"]

        def search(x: pa.Table, q: pa.Table) -> pa.Table:
            queries_block = _pack(q)
            top = RunningTopK(len(queries_block["ids"]), n)
            for batch in x.to_batches(max_chunksize=2_000):
                lengths, doc, term, tf = _counts(batch["tokens"], queries_block["vocabulary"])
                _score(top, queries_block, ids_of(batch["doc_id"]), lengths, doc, term, tf, k1, b)
            return pa.Table.from_batches([hits_batch(top, queries_block["ids"], arrow)])

        hits = fragments(
            rows,
            weighted,
            search,
            schema,
            chunks=F.lit(max(1, math.ceil(4 * chars / chunk_bytes))),
            blocks=F.lit(math.ceil(size / broadcast_bytes)),
        )
    ranked = top_k(hits, n, ["query_id"], [F.col("value").asc(), F.col("doc_id").asc()])
    return small(ranked.select("query_id", "doc_id", "rank", (-F.col("value")).alias("score")), measured["rows"] * n)


def _counts(tokens: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of token lists, and (list, word, count) of the words of a vocabulary in them."""
    lengths = np.diff(tokens.offsets.to_numpy())
    code = pc.fill_null(pc.index_in(tokens.flatten(), value_set=vocabulary), -1)
    code = code.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    n = max(1, len(vocabulary))
    key, tf = np.unique(doc[code >= 0] * n + code[code >= 0], return_counts=True)
    return lengths, *np.divmod(key, n), tf


def _folded(rows: DataFrame, terms: Broadcast) -> DataFrame:
    """``(doc_id, doc_len, codes, tfs)``: of every document with tokens, the counts of the terms."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                batch = whole.slice(at, 1_000)
                lengths, doc, term, tf = _counts(batch["tokens"], terms.value)
                ends = pa.array(np.searchsorted(doc, np.arange(len(lengths) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (term, tf)]
                made = pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(lengths, pa.int64()), *lists], ["doc_id", "doc_len", "codes", "tfs"])
                yield made.filter(pa.array(lengths > 0))

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(fold, f"doc_id {id_type}, doc_len long, codes array<int>, tfs array<int>")


def _lexicon(folded: DataFrame, terms: pa.Array, field: str) -> DataFrame:
    """The lexicon rows of the terms, and the totals of the field, as an index has them."""
    spark = folded.sparkSession
    totals = folded.agg(F.count("*").alias("n_docs"), F.sum("doc_len").alias("n_tokens")).select(F.lit(FIELD_TOTALS).alias("term"), "n_docs", "n_tokens")
    names = spark.createDataFrame(pa.table({"code": pa.array(np.arange(len(terms)), pa.int32()), "term": terms.cast(pa.string())}))
    counts = folded.select("doc_len", F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n_docs"), F.sum("doc_len").alias("n_tokens"))
    known = counts.join(F.broadcast(names), "code").select("term", "n_docs", "n_tokens")
    return known.unionByName(totals.filter("n_docs > 0")).withColumn("field", F.lit(field))


def _weighted(queries: DataFrame, words: DataFrame, query_id_col: str, text_col: str) -> DataFrame:
    """``(query_id, avg_len, terms)``: every query's known tokens, weighted by count and idf."""
    typed = queries.select(F.col(query_id_col).alias("query_id"), F.explode(X.tokenize(F.col(text_col))).alias("term"))
    counted = typed.groupBy("query_id", "term").agg(F.count("*").alias("times"))
    # First the lexicon rows that any query asks for, one per term, and the totals, in one pass.
    wanted = typed.select("term").unionAll(typed.sparkSession.createDataFrame([(FIELD_TOTALS,)], "term string"))
    asked = staged(words.join(wanted.distinct(), "term", "left_semi"), "asked-terms")
    totals = asked.filter(F.col("term") == FIELD_TOTALS).select(F.struct("n_docs", "n_tokens").alias("all")).scalar()
    asked = asked.withColumn("all", totals)
    idf = asked.select(
        "term",
        X.bm25_idf(F.col("all.n_docs"), F.col("n_docs")).alias("idf"),
        (F.col("all.n_tokens") / F.col("all.n_docs")).alias("avg_len"),
    )
    known = counted.join(idf, "term").withColumn("weight", F.col("times") * F.col("idf"))
    terms = F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("terms")
    return known.groupBy("query_id").agg(F.max("avg_len").alias("avg_len"), terms)


def _inverted(typed: pa.Table, words: pa.Table, terms: pa.Array) -> dict:
    """A query block by term, as ``_pack`` makes it, from ``(query_id, term, times)`` and lexicon rows."""
    totals = words.filter(pc.equal(words["term"], FIELD_TOTALS)).to_pylist()
    words = words.filter(pc.not_equal(words["term"], FIELD_TOTALS))
    vocabulary = words["term"].combine_chunks()
    n_docs, n_tokens = (totals[0]["n_docs"], totals[0]["n_tokens"]) if totals else (0, 0)
    doc_freq = words["n_docs"].to_numpy()
    idf = np.log(1 + (n_docs - doc_freq + 0.5) / (doc_freq + 0.5))
    place = pc.index_in(typed["term"], value_set=vocabulary)
    typed, code = typed.filter(pc.is_valid(place)), pc.drop_null(place).to_numpy()
    ids, owner = np.unique(ids_of(typed["query_id"]), return_inverse=True)
    order = np.argsort(code, kind="stable")
    return {
        "ids": ids,
        "vocabulary": vocabulary,
        "starts": np.searchsorted(code[order], np.arange(len(vocabulary) + 1)),
        "owner": owner[order],
        "weight": (typed["times"].to_numpy() * idf[code])[order],
        "avg_len": n_tokens / n_docs if n_docs else 1.0,
        # Places of the folded terms in the vocabulary.
        "of_code": pc.fill_null(pc.index_in(terms, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64),
    }


def _pack(table: pa.Table) -> dict:
    """A query block by term: the vocabulary, and per term the queries that hold it."""
    terms = table["terms"].combine_chunks()
    lengths = np.diff(terms.offsets.to_numpy()) if len(terms) else np.zeros(0, np.int64)
    flat = terms.flatten()
    owner = np.repeat(np.arange(len(terms)), lengths)
    vocabulary = pc.unique(flat.field("term"))
    code = pc.index_in(flat.field("term"), value_set=vocabulary).to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    starts = np.searchsorted(code[order], np.arange(len(vocabulary) + 1))
    return {
        "ids": ids_of(table["query_id"]),
        "vocabulary": vocabulary,
        "starts": starts,
        "owner": owner[order],
        "weight": flat.field("weight").to_numpy(zero_copy_only=False)[order],
        "avg_len": table["avg_len"][0].as_py() if table.num_rows else 1.0,
    }


def _score(
    top: RunningTopK, block: dict, doc_ids: np.ndarray, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, k1: float, b: float
) -> None:
    """Score documents, given as (doc, term, tf) in order of doc, against a block; offer the best.

    Each posting meets the queries that hold its term. Where the pairs that arise fill a good part
    of documents x queries, they are summed in a dense table, else by sorting the pairs.
    """
    m = top.m
    if not m or not len(doc_ids):
        return
    part = tf / (tf + k1 * ((1.0 - b) + b * lengths[doc] / block["avg_len"]))
    fan = block["starts"][term + 1] - block["starts"][term]
    # A few documents first: their scores keep most of the others from being offered.
    low, step = 0, 16 * top.k if np.isinf(top.tau).any() else len(doc_ids)
    while low < len(doc_ids):
        step = max(1, min(step, _SCORE_BUDGET // m))
        high = min(len(doc_ids), low + step)
        at, end = np.searchsorted(doc, [low, high])
        sums = _dense if fan[at:end].sum() * _SPARSE > (high - low) * m else _sparse
        cell, score = sums(block, doc[at:end] - low, term[at:end], part[at:end], fan[at:end], (high - low) * m, m)
        # Single floats, as in a single search.
        value = -score.astype(np.float32).astype(np.float64)
        row, query = np.divmod(cell, m)
        near = value <= np.minimum(top.tau, 0)[query]
        top.offer(query[near], doc_ids[low + row[near]], value[near])
        top.flush()
        low, step = high, 4 * step


def _pairs(block: dict, doc: np.ndarray, term: np.ndarray, part: np.ndarray, fan: np.ndarray, m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(cell, score) of the pairs of postings and queries, a bounded number at a time.

    A document's pairs come together, unless it has more of them than that.
    """
    at, sums = 0, np.cumsum(fan)
    while at < len(doc):
        upto = max(at + 1, int(np.searchsorted(sums, sums[at] - fan[at] + _PAIR_BUDGET, side="right")))
        n = fan[at:upto]
        first = np.repeat(block["starts"][term[at:upto]] - np.r_[0, np.cumsum(n)[:-1]], n)
        entry = first + np.arange(n.sum())
        yield np.repeat(doc[at:upto], n) * m + block["owner"][entry], np.repeat(part[at:upto], n) * block["weight"][entry]
        at = upto


def _dense(block: dict, doc: np.ndarray, term: np.ndarray, part: np.ndarray, fan: np.ndarray, cells: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    score, met = np.zeros(cells), np.zeros(cells, bool)
    for cell, value in _pairs(block, doc, term, part, fan, m):
        met[cell] = True
        score += np.bincount(cell, value, cells)
    # Whether a document matches is not read off its score.
    cell = np.flatnonzero(met)
    return cell, score[cell]


def _sparse(block: dict, doc: np.ndarray, term: np.ndarray, part: np.ndarray, fan: np.ndarray, cells: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    cell, value = np.zeros(0, np.int64), np.zeros(0)
    for more, added in _pairs(block, doc, term, part, fan, m):
        cell, inverse = np.unique(np.concatenate([cell, more]), return_inverse=True)
        value = np.bincount(inverse, np.concatenate([value, added]), len(cell))
    return cell, value
