"""Exact k-nearest-neighbour search of a batch of queries over a corpus of vectors.

The corpus stays where it is. A query batch of checked size is broadcast and every task keeps a
local top k, so the shuffle carries k rows per query and task. A larger batch is cut into blocks of
that size, for each of which the corpus is scanned in place, many small blocks in one job; no vector
of the corpus is shuffled.
Only a corpus that is itself no larger than a chunk is sent to the blocks of such a batch. So no
task, group or driver ever holds a large side, and all ways return the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions import vectors as V
from nearfield.operators.kernel import LocalTopK, RunningTopK, ids_of, matrix_of
from nearfield.session import staged

BROADCAST_BYTES = 64 << 20  # queries up to this size are broadcast
CHUNK_BYTES = 128 << 20  # corpus bytes in one fragment, and of a corpus that is sent to query blocks
_MERGED = 32  # parts in which the hits of many tasks are first merged
_ROUND = 32  # most query blocks searched in one job, fewer if they take more than BROADCAST_BYTES
_ROUNDS = 8  # jobs at least, so that few blocks are sent one by one
_PIECE = 32 << 20  # query bytes of a fragment that are searched at once


def top_k(df: DataFrame, k: int, by: list[str], order: list[Column], rank_col: str = "rank") -> DataFrame:
    """First k rows of every group in the given order, with a 1-based rank.

    Spark cuts every map task to k rows per group before the shuffle (WindowGroupLimit), so a
    group that holds most of the rows still sends only k rows per task.
    """
    ranked = df.withColumn(rank_col, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col(rank_col) <= k).withColumn(rank_col, F.col(rank_col).cast("long"))


def small(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """Mark a table of at most ``rows`` rows for broadcast when that bound is small enough.

    Joining a handful of hits with a large table then leaves the large table unshuffled.
    """
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def rank_hits(hits: DataFrame, k: int, n_queries: int, distinct: bool = False) -> DataFrame:
    """Local top-k rows of all tasks to the final hit list, nearest first, ties by id.

    ``distinct`` first folds rows of the same query and document to the nearest one.
    """
    if distinct:
        hits = hits.groupBy("query_id", "doc_id").agg(F.min("dist_sq").alias("dist_sq"))
    ranked = top_k(hits, k, ["query_id"], [F.col("dist_sq").asc(), F.col("doc_id").asc()])
    ranked = ranked.select("query_id", "doc_id", "rank", "dist_sq", V.score(F.col("dist_sq")).alias("score"))
    return small(ranked, n_queries * k)


def knn(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    id_col: str = "doc_id",
    vector_col: str = "vector",
    query_id_col: str = "query_id",
    query_vector_col: str = "vector",
    per_owner: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """The k nearest corpus rows of every query: ``(query_id, doc_id, rank, dist_sq, score)``.

    Float and int8 vectors; int8 distances are exact integers. Ids must be unique in both inputs,
    unless ``per_owner`` is set: then rows that share an id are one document with several vectors,
    ranked by its nearest one. The size of the query batch is measured when this is called.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    corpus = corpus.select(F.col(id_col).alias("doc_id"), F.col(vector_col).alias("vector"))
    queries = queries.select(F.col(query_id_col).alias("query_id"), F.col(query_vector_col).alias("vector"))
    integral = _is_int8(corpus, queries)
    schema = _hit_schema(corpus, queries, integral)
    size = vectors_size(queries)
    if size["bytes"] <= broadcast_bytes:
        return rank_hits(_broadcast_search(corpus, queries.toArrow(), k, schema, per_owner)[0], k, size["rows"], distinct=per_owner)
    n_blocks = math.ceil(size["bytes"] / broadcast_bytes)
    if corpus.count() * size["dim"] * 4 > chunk_bytes:
        in_round = max(1, min(_ROUND, n_blocks // _ROUNDS, BROADCAST_BYTES // broadcast_bytes))
        return _blocked_search(corpus, queries, k, schema, n_blocks, size["rows"], per_owner, in_round)
    hits = fragment_search(corpus, queries, k, schema, chunks=F.lit(1), blocks=F.lit(n_blocks), per_owner=per_owner)
    return rank_hits(hits, k, size["rows"], distinct=per_owner)


def _blocked_search(
    corpus: DataFrame, queries: DataFrame, k: int, schema: T.StructType, n_blocks: int, n_queries: int, per_owner: bool, in_round: int
) -> DataFrame:
    """Ranked hits of a query set block by block, the corpus scanned in place for each.

    A task holds one block. The blocks of a round are searched by one job, and its hits are written
    before the next round is sent, so the driver holds one round at a time. Hits are merged in two
    rounds: first among some of the tasks, then of all, so that no task meets the k rows of every
    task for a query.
    """
    blocked = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)))
    ranked = []
    for first in range(0, n_blocks, in_round):
        table = blocked.filter(F.col("_block").between(first, first + in_round - 1)).toArrow()
        numbers = pc.unique(table["_block"]).to_pylist()
        found = [_broadcast_search(corpus, table.filter(pc.equal(table["_block"], n)), k, schema, per_owner) for n in numbers]
        if not found:
            continue
        hits = reduce(DataFrame.unionByName, [part for part, _ in found])
        if per_owner:
            hits = hits.groupBy("query_id", "doc_id").agg(F.min("dist_sq").alias("dist_sq"))
        order = [F.col("dist_sq").asc(), F.col("doc_id").asc()]
        dealt = hits.withColumn("_part", F.spark_partition_id() % _MERGED)
        some = top_k(dealt, k, ["query_id", "_part"], order).select("query_id", "doc_id", "dist_sq")
        ranked.append(staged(rank_hits(some, k, n_queries), f"block{first}"))
        for _, sent in found:
            sent.destroy()
    return small(reduce(DataFrame.unionByName, ranked), n_queries * k)


def vectors_size(df: DataFrame, vector_col: str = "vector") -> dict[str, int]:
    """Rows, widest dimension and raw bytes of a vector table, in one small aggregate."""
    row = df.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.max(F.size(vector_col)), F.lit(0)).alias("dim"),
        F.coalesce(F.sum(F.size(vector_col)), F.lit(0)).alias("elements"),
    ).first()
    return {"rows": row["rows"], "dim": row["dim"], "bytes": 4 * row["elements"]}


def _is_int8(corpus: DataFrame, queries: DataFrame) -> bool:
    kinds = {df.schema["vector"].dataType.elementType.typeName() for df in (corpus, queries)}
    if kinds == {"byte"}:
        return True
    if "byte" in kinds:
        raise ValueError("corpus and queries must both be float or both be int8")
    return False


def _hit_schema(corpus: DataFrame, queries: DataFrame, integral: bool) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("doc_id", corpus.schema["doc_id"].dataType),
            T.StructField("dist_sq", T.LongType() if integral else T.DoubleType()),
        ]
    )


def hits_batch(top: RunningTopK, query_ids: np.ndarray, arrow: pa.Schema) -> pa.RecordBatch:
    pos, ids, value = top.result()
    columns = [query_ids[pos], ids, value]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, from_pandas=False).cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
    )


def arrow_schema(schema: T.StructType) -> pa.Schema:
    kinds = {"byte": pa.int8(), "short": pa.int16(), "integer": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    return pa.schema([(f.name, kinds.get(f.dataType.typeName(), pa.string())) for f in schema])


def _broadcast_search(
    corpus: DataFrame, table: pa.Table, k: int, schema: T.StructType, per_owner: bool
) -> tuple[DataFrame, Broadcast]:
    """Local top k of every task, and what was sent to them; the caller has checked the queries' size."""
    block = corpus.sparkSession.sparkContext.broadcast((ids_of(table["query_id"]), matrix_of(table["vector"])))
    arrow = arrow_schema(schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q = block.value
        top = LocalTopK(q, k, per_owner)
        for batch in batches:
            if batch.num_rows and len(q):
                top.add(matrix_of(batch.column(1), q.shape[1]), ids_of(batch.column(0)))
                top.flush()
        yield hits_batch(top, query_ids, arrow)

    return corpus.mapInArrow(search, schema), block


def fragments(
    corpus: DataFrame,
    queries: DataFrame,
    search: Callable[[pa.Table, pa.Table], pa.Table],
    schema: T.StructType,
    *,
    chunks: Column,
    blocks: Column,
    spread: Sequence[str] = ("doc_id",),
    within: Sequence[str] = (),
) -> DataFrame:
    """Run ``search`` on every (corpus chunk, query block) pair that shares the ``within`` columns.

    A corpus row belongs to one chunk and is sent to every block; a query belongs to one block
    and is sent to every chunk. Rows are hashed by id, so a cell that holds a third of the
    corpus or of the queries is cut into as many pieces as its size asks for.
    """
    keys = [*within, "_chunk", "_block"]

    def pieces(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n.cast("int") - 1))

    left = corpus.withColumn("_chunk", F.pmod(F.xxhash64(*spread), chunks).cast("int"))
    left = left.withColumn("_block", pieces(blocks))
    right = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), blocks).cast("int"))
    right = right.withColumn("_chunk", pieces(chunks))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, schema)


def fragment_search(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    schema: T.StructType,
    *,
    chunks: Column,
    blocks: Column,
    per_owner: bool = False,
    within: Sequence[str] = (),
) -> DataFrame:
    """Local top k of every (corpus chunk, query block) pair, for query sets too large to send.

    With ``per_owner`` equal rows are folded and the vector is hashed too, so one owner can span
    many chunks.
    """
    if per_owner:
        corpus = corpus.dropDuplicates()
    arrow = arrow_schema(schema)

    def search(x: pa.Table, q: pa.Table) -> pa.Table:
        hits = []
        step = max(1, _PIECE // max(1, q["vector"].nbytes // max(1, q.num_rows)))
        for at in range(0, max(1, q.num_rows), step):
            piece = q.slice(at, step)
            matrix = matrix_of(piece["vector"])
            top = LocalTopK(matrix, k, per_owner)
            if piece.num_rows:
                for batch in x.to_batches(max_chunksize=10_000):
                    top.add(matrix_of(batch["vector"], matrix.shape[1]), ids_of(batch["doc_id"]))
                    top.flush()
            hits.append(hits_batch(top, ids_of(piece["query_id"]), arrow))
        return pa.Table.from_batches(hits)

    return fragments(
        corpus,
        queries,
        search,
        schema,
        chunks=chunks,
        blocks=blocks,
        spread=("doc_id", "vector") if per_owner else ("doc_id",),
        within=within,
    )
