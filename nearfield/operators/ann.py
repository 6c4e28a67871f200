"""Approximate nearest neighbours over an index of cells kept as a table.

With pivots, every vector belongs to the cell of its nearest pivot, and a query looks only into
the cells of its ``nprobe`` nearest pivots; probing all cells is the exact search. With random
projections, a cell is a bucket of vectors that fall into the same steps of a few projections.
Either way the index is an ordinary table with a ``cell`` column, and what a query finds in its
cells is ranked by exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions import vectors as V
from nearfield.operators.kernel import LocalTopK, ids_of, matrix_of
from nearfield.operators.knn import (
    BROADCAST_BYTES,
    CHUNK_BYTES,
    _hit_schema,
    _is_int8,
    arrow_schema,
    fragment_search,
    hits_batch,
    knn,
    rank_hits,
    small,
    vectors_size,
)
from nearfield.session import file_count, staged, stored_bytes

_PRUNE_LITERALS = 2_000  # probed cells that still go into the scan filter as literals
_LISTED = 1_000_000  # buckets of a box that are listed where the names of all buckets are not at hand
_BOX = 32  # buckets of a box that are listed in any case where they are


def sample_pivots(corpus: DataFrame, m: int, id_col: str = "doc_id", vector_col: str = "vector") -> DataFrame:
    """A repeatable sample of m vectors as ``(cell, vector)``: those with the smallest id hash.

    The row count first narrows the hash range to little more than m rows, so only those reach
    the sort; the result is the same as sorting everything. The sample is taken now and comes
    back as a small local table, since index and queries both read it.
    """
    hashed = corpus.select(
        F.col(id_col).alias("cell"),
        F.col(vector_col).alias("vector"),
        F.md5(F.col(id_col).cast("string").cast("binary")).alias("_hash"),
    )
    total = corpus.count()
    share = (m + 8 * m**0.5 + 32) / max(1, total)
    near = hashed.filter(F.col("_hash") < f"{int(share * 16**8):08x}") if share < 1 else hashed

    def smallest(rows: DataFrame) -> pa.Table:
        return rows.orderBy("_hash", "cell").limit(m).select("cell", "vector").toArrow()

    taken = smallest(near)
    if taken.num_rows < min(m, total):
        taken = smallest(hashed)
    return corpus.sparkSession.createDataFrame(taken, hashed.select("cell", "vector").schema)


def train_pivots(corpus: DataFrame, start: DataFrame, rounds: int = 10, vector_col: str = "vector") -> DataFrame:
    """``start (cell, vector)`` moved to the means of their rows, ``rounds`` times.

    Every task sums the rows of each cell before anything moves: a round sends one sum per cell and
    task. Means are single floats, so the order of the additions does not show. A cell without rows
    keeps its place. Few rows per cell suffice; train on a sample of a large corpus:
    ``train_pivots(hash_pivots(corpus, 100 * m), sample_pivots(corpus, m))``.
    """
    spark = corpus.sparkSession
    kind = start.schema["cell"].dataType
    cell = arrow_schema(T.StructType([T.StructField("cell", kind)])).field(0).type
    name = kind.simpleString()
    centres = start.select("cell", F.col("vector").cast("array<float>").alias("vector"))
    points = staged(corpus.select(F.col(vector_col).cast("array<float>").alias("vector")), "points")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict = {}
        total: dict = {}
        for batch in batches:
            x, cells = matrix_of(batch["vector"]).astype(np.float64), ids_of(batch["cell"])
            order = np.argsort(cells, kind="stable")
            present, at = np.unique(cells[order], return_index=True)
            for c, members in zip(present.tolist(), np.split(order, at[1:])):
                n[c] = n.get(c, 0) + len(members)
                total[c] = total.get(c, 0.0) + x[members].sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*n], cell), pa.array([*n.values()], pa.int64()), pa.array([t.tolist() for t in total.values()], pa.list_(pa.float64()))],
            names=["cell", "n", "total"],
        )

    def mean(parts: pa.Table) -> pa.Table:
        total = matrix_of(parts["total"]).sum(axis=0) / sum(parts["n"].to_pylist())
        return pa.table({"cell": parts["cell"][:1], "moved": pa.array([total.astype(np.float32)], pa.list_(pa.float32()))})

    for _ in range(rounds):
        parts = nearest_cells(points, centres, 1).select("cell", "vector").mapInArrow(sums, f"cell {name}, n bigint, total array<double>")
        moved = parts.groupBy("cell").applyInArrow(mean, f"cell {name}, moved array<float>")
        joined = centres.join(moved, "cell", "left").select("cell", F.coalesce("moved", "vector").alias("vector"))
        # As large as the start, whose size the assignment checks.
        centres = spark.createDataFrame(joined.toArrow(), centres.schema)
    return centres


def nearest_cells(
    df: DataFrame,
    pivots: DataFrame,
    n: int = 1,
    vector_col: str = "vector",
    max_pivot_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Every row of ``df`` with its n nearest cells: n output rows each, ``cell`` and ``cell_rank``.

    The pivots are broadcast; their size is checked, because m is the caller's choice.
    """
    size = vectors_size(pivots)
    if size["bytes"] > max_pivot_bytes:
        raise ValueError(f"{size['rows']} pivots take {size['bytes']} bytes, more than max_pivot_bytes")
    table = pivots.select("cell", "vector").toArrow()
    if not table.num_rows:
        raise ValueError("no pivots")
    block = df.sparkSession.sparkContext.broadcast((ids_of(table["cell"]), matrix_of(table["vector"])))
    at = df.columns.index(vector_col)
    cell_type = pivots.schema["cell"].dataType
    schema = T.StructType([*df.schema.fields, T.StructField("cell", cell_type), T.StructField("cell_rank", T.LongType())])
    cell_arrow = arrow_schema(T.StructType([T.StructField("cell", cell_type)])).field(0).type

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, centres = block.value
        for batch in batches:
            if not batch.num_rows:
                continue
            near = LocalTopK(matrix_of(batch.column(at), centres.shape[1]), n)
            near.add(centres, cells)
            pos, found, _ = near.result()
            order = np.argsort(pos, kind="stable")
            pos, found = pos[order], found[order]
            rank = np.arange(len(pos)) - np.searchsorted(pos, pos, side="left") + 1
            out = batch if n == 1 else batch.take(pa.array(pos))
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(found).cast(cell_arrow), pa.array(rank, pa.int64())],
                names=[*batch.schema.names, "cell", "cell_rank"],
            )

    return df.mapInArrow(assign, schema)


def assign_cells(df: DataFrame, pivots: DataFrame, vector_col: str = "vector") -> DataFrame:
    """The index rows of a corpus: every row with the cell of its nearest pivot."""
    return nearest_cells(df, pivots, 1, vector_col).drop("cell_rank")


def write_index(assigned: DataFrame, path: str, files: int | None = None, id_col: str = "doc_id") -> None:
    """Store an index so that a search reads only the probed cells.

    Range partitioning on (cell, id) gives evenly sized tasks: a cell that holds a third of the
    corpus spans many of them, and small cells share one. The assignment is staged first, because
    range partitioning reads its input twice. Without ``files`` their number follows from its size.
    """
    stored = staged(assigned, "cells")
    ranged = stored.repartitionByRange(files or file_count(assigned.sparkSession, stored_bytes(stored)), "cell", id_col).sortWithinPartitions("cell", id_col)
    ranged.write.mode("overwrite").partitionBy("cell").parquet(path)


def ann_search(
    index: DataFrame,
    queries: DataFrame,
    pivots: DataFrame,
    k: int,
    nprobe: int,
    *,
    id_col: str = "doc_id",
    vector_col: str = "vector",
    query_id_col: str = "query_id",
    query_vector_col: str = "vector",
    broadcast_bytes: int = BROADCAST_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """k nearest neighbours within the ``nprobe`` nearest cells of every query, exactly ranked."""
    index = index.select("cell", F.col(id_col).alias("doc_id"), F.col(vector_col).alias("vector"))
    queries = queries.select(F.col(query_id_col).alias("query_id"), F.col(query_vector_col).alias("vector"))
    size = vectors_size(queries)
    probes = nearest_cells(queries, pivots, nprobe).drop("cell_rank")
    return search_cells(index, probes, k, nprobe, size, broadcast_bytes, chunk_bytes)


def search_cells(
    index: DataFrame,
    probes: DataFrame,
    k: int,
    nprobe: int,
    size: dict[str, int],
    broadcast_bytes: int = BROADCAST_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """k nearest rows of ``index (cell, doc_id, vector)`` for ``probes (query_id, vector, cell)``.

    ``size`` is that of the queries before probing, as ``vectors_size`` measures it.
    """
    schema = _hit_schema(index, probes, _is_int8(index, probes))
    if size["bytes"] * max(1, nprobe) <= broadcast_bytes:
        hits = _broadcast_cells(index, probes, k, schema)
    else:
        hits = _fragment_cells(index, probes, k, schema, size, nprobe, broadcast_bytes, chunk_bytes)
    return rank_hits(hits, k, size["rows"])


def hashed_cells(
    df: DataFrame, n: int = 1, *, projections: int = 3, width: float = 1.0, seed: int = 17, vector_col: str = "vector"
) -> DataFrame:
    """Every row with its bucket under random projections, and its ``n - 1`` next best buckets.

    A projection is cut into steps of ``width``; a bucket is one step of each. The next buckets
    are those across the nearest step borders. Index and queries must use the same settings.
    """
    if not 1 <= n <= 2 * projections + 1:
        raise ValueError(f"n must lie between 1 and {2 * projections + 1}")
    at = df.columns.index(vector_col)
    schema = T.StructType([*df.schema.fields, T.StructField("cell", T.LongType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column(at)).astype(np.float64)
            draws = np.random.default_rng(seed)
            mix = draws.integers(1, 2**62, projections) * 2 + 1
            steps = x @ draws.standard_normal((x.shape[1], projections)) / width
            home = np.floor(steps)
            inside = steps - home
            own = (home.astype(np.int64) * mix).sum(axis=1)
            border = np.argsort(np.hstack([inside, 1 - inside]), axis=1, kind="stable")[:, : n - 1]
            moves = np.concatenate([-mix, mix])[border]
            cells = np.hstack([own[:, None], own[:, None] + moves])
            rows = batch if n == 1 else batch.take(pa.array(np.repeat(np.arange(len(x)), n)))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(cells.ravel())], names=[*batch.schema.names, "cell"]
            )

    return df.mapInArrow(assign, schema)


def hashed_search(
    index: DataFrame,
    queries: DataFrame,
    k: int,
    nprobe: int,
    *,
    projections: int = 3,
    width: float = 1.0,
    seed: int = 17,
    broadcast_bytes: int = BROADCAST_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """k nearest neighbours within ``nprobe`` buckets of an index made by ``hashed_cells``.

    Fewer than k where those buckets hold fewer rows; ``filled_search`` goes on until there are k.
    """
    index, queries = index.select("cell", "doc_id", "vector"), queries.select("query_id", "vector")
    probes = hashed_cells(queries, nprobe, projections=projections, width=width, seed=seed)
    return search_cells(index, probes, k, nprobe, vectors_size(queries), broadcast_bytes, chunk_bytes)


def filled_search(
    index: DataFrame,
    queries: DataFrame,
    k: int,
    nprobe: int,
    *,
    projections: int = 3,
    width: float = 1.0,
    seed: int = 17,
    reach: float = 1.0,
    broadcast_bytes: int = BROADCAST_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """k nearest neighbours in an index made by ``hashed_cells``; every query gets its k hits.

    First each query looks into its ``nprobe`` best buckets. One that finds fewer than k rows looks
    into twice as wide a box of buckets, until it has k or the index has no more. Its k-th distance
    then says how far a nearer row can lie along each projection: the last round searches that box.
    With ``reach`` 1 the buckets left out are all farther away, so the result is exact; a smaller
    reach shrinks the last box by that factor and may miss neighbours, but never returns fewer.
    """
    index = index.select("cell", "doc_id", "vector")
    queries = staged(queries.select("query_id", "vector"), "queries")
    settings = {"projections": projections, "width": width, "seed": seed}
    limits = {"broadcast_bytes": broadcast_bytes, "chunk_bytes": chunk_bytes}
    cells = index.groupBy("cell").agg(F.count("*").alias("n"))
    there = cells.agg(F.count("*").alias("cells"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    # Bucket names go along with the task, if there are not too many for that. A box too large to be
    # listed is left to the exact search.
    known = ids_of(cells.select("cell").toArrow()["cell"]) if there["cells"] * 8 <= broadcast_bytes else None
    enough = min(k, there["rows"])
    size = vectors_size(queries)
    first = search_cells(index, hashed_cells(queries, nprobe, **settings), k, nprobe, size, **limits)
    hits = staged(first.select("query_id", "doc_id", "dist_sq"), "hits")
    steps = 1.0
    while True:
        best = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.max("dist_sq").cast("double").alias("far"))
        state = queries.join(best, "query_id", "left").select("query_id", "vector", "far", F.coalesce("n", F.lit(0)).alias("n"))
        short = state.filter(F.col("n") < enough).select("query_id", "vector", F.lit(steps).alias("steps"), F.lit(None).cast("double").alias("far"))
        short = staged(_box_cells(short, known, reach, **settings), "short")
        if short.isEmpty():
            break
        rest = hits.join(short.select("query_id").distinct(), "query_id", "left_anti")
        hits = staged(rest.unionByName(_search_boxes(index, short, k, limits)), "hits")
        steps *= 2
    boxes = staged(_box_cells(state.select("query_id", "vector", F.lit(0.0).alias("steps"), "far"), known, reach, **settings), "boxes")
    seen = hits if boxes.isEmpty() else hits.unionByName(_search_boxes(index, boxes, k, limits)).distinct()
    return rank_hits(seen, k, size["rows"])


def _search_boxes(index: DataFrame, boxes: DataFrame, k: int, limits: dict[str, int]) -> DataFrame:
    """Hits of listed boxes, by bucket, and of boxes too large for that, whose queries meet every row."""
    listed, whole = boxes.filter(F.col("cell").isNotNull()), boxes.filter(F.col("cell").isNull()).drop("cell")
    parts = []
    if not listed.isEmpty():
        parts.append(search_cells(index, listed, k, 1, vectors_size(listed), **limits))
    if not whole.isEmpty():
        parts.append(knn(index, whole, k, **limits))
    return reduce(DataFrame.unionByName, [hits.select("query_id", "doc_id", "dist_sq") for hits in parts])


def _box_cells(df: DataFrame, known: np.ndarray | None, reach: float, projections: int, width: float, seed: int) -> DataFrame:
    """``(query_id, vector, cell)`` of the buckets in a box around each query.

    The box spans ``steps`` steps each way or, where ``far`` is given, all steps that a row within
    that squared distance can fall into. A box that is too large to list, as is one with over an
    eighth of all buckets, is a single row without a cell: its query would be sent once per bucket.
    """
    schema = T.StructType([df.schema["query_id"], df.schema["vector"], T.StructField("cell", T.LongType())])
    most = _LISTED if known is None else max(_BOX, len(known) // 8)

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                batch = whole.slice(at, 100)
                x = matrix_of(batch["vector"]).astype(np.float64)
                draws = np.random.default_rng(seed)
                mix = draws.integers(1, 2**62, projections) * 2 + 1
                normals = draws.standard_normal((x.shape[1], projections))
                places = x @ normals / width
                # A margin for the rounding of distances and products.
                far = np.sqrt(batch["far"].to_numpy(zero_copy_only=False).astype(np.float64)) * reach * (1 + 1e-9) + 1e-9
                radius = np.where(np.isnan(far)[:, None], 0.0, far[:, None] * np.linalg.norm(normals, axis=0) / width)
                radius = radius + batch["steps"].to_numpy()[:, None]
                low, high = np.floor(places - radius), np.floor(places + radius)
                named = []
                for i in range(len(x)):
                    if np.prod(high[i] - low[i] + 1) > (_LISTED if known is None else len(known)):
                        # A box of more buckets than there are may still hold few of those.
                        inside = known if known is not None and len(known) <= most else [None]
                        named.append(inside)
                        continue
                    axes = [np.arange(a, b + 1, dtype=np.int64) * f for a, b, f in zip(low[i].astype(np.int64), high[i].astype(np.int64), mix)]
                    cells = np.unique(sum(np.meshgrid(*axes, indexing="ij")).ravel())
                    cells = cells if known is None else cells[np.isin(cells, known)]
                    named.append(cells if len(cells) <= most else [None])
                lists = pa.array(named, pa.list_(pa.int64()))
                rows = np.repeat(np.arange(len(x)), [len(c) for c in named])
                taken = batch.select(["query_id", "vector"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*taken.columns, lists.flatten()], names=["query_id", "vector", "cell"])

    return df.mapInArrow(boxes, schema)


def _broadcast_cells(index: DataFrame, probes: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    """Scan only the probed cells and keep a local top k; the queries are small enough to send."""
    table = probes.toArrow()  # size checked by the caller
    ids, first, inverse = np.unique(ids_of(table["query_id"]), return_index=True, return_inverse=True)
    matrix = matrix_of(table["vector"])[first]
    cells = ids_of(table["cell"])
    order = np.argsort(cells, kind="stable")
    names, starts = np.unique(cells[order], return_index=True)
    rows = np.split(inverse[order], starts[1:])
    block = index.sparkSession.sparkContext.broadcast((ids, matrix, dict(zip(names.tolist(), rows, strict=False))))
    if 0 < len(names) <= _PRUNE_LITERALS:
        index = index.filter(F.col("cell").isin(names.tolist()))
    elif len(names):
        # Too many for literals: the list is joined, and Spark prunes the index's folders at run time.
        # The range makes the list count as selective, without which it does not.
        listed = pa.table({"cell": pa.array(names.tolist())})
        listed = staged(index.sparkSession.createDataFrame(listed), "probed")
        listed = listed.where(F.col("cell").between(names[0].item(), names[-1].item()))
        index = index.join(F.broadcast(listed), "cell", "left_semi")
    arrow = arrow_schema(schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q, probing = block.value
        top = LocalTopK(q, k)
        for batch in batches:
            if not batch.num_rows or not len(q):
                continue
            batch_cells = ids_of(batch.column(0))
            x, x_ids = matrix_of(batch.column(2), q.shape[1]), ids_of(batch.column(1))
            by_cell = np.argsort(batch_cells, kind="stable")
            present, at = np.unique(batch_cells[by_cell], return_index=True)
            for cell, members in zip(present.tolist(), np.split(by_cell, at[1:]), strict=True):
                if cell in probing:
                    top.add(x[members], x_ids[members], rows=probing[cell])
            top.flush()
        yield hits_batch(top, query_ids, arrow)

    return index.mapInArrow(search, schema)


def _fragment_cells(
    index: DataFrame,
    probes: DataFrame,
    k: int,
    schema: T.StructType,
    size: dict[str, int],
    nprobe: int,
    block_bytes: int,
    chunk_bytes: int,
) -> DataFrame:
    """Join cell by cell in fragments: each cell is cut into chunks and blocks by its own counts."""
    row_bytes = max(1, size["dim"]) * 4

    def pieces(df: DataFrame, name: str, limit: int) -> DataFrame:
        n = F.ceil(F.count("*") * F.lit(row_bytes) / F.lit(limit))
        return df.groupBy("cell").agg(F.greatest(F.lit(1), n).cast("int").alias(name))

    sizes = pieces(index, "_chunks", chunk_bytes).join(pieces(probes, "_blocks", block_bytes), "cell")

    def sized(df: DataFrame) -> DataFrame:
        # At most one row per probe; broadcast while that is little, so no cell is shuffled whole.
        return df.join(small(sizes.toDF(*sizes.columns), size["rows"] * nprobe, 24), "cell")

    return fragment_search(
        sized(index), sized(probes), k, schema, chunks=F.col("_chunks"), blocks=F.col("_blocks"), within=("cell",)
    )


def lookup(hits: DataFrame, docs: DataFrame, fields: list[str], id_col: str = "doc_id") -> DataFrame:
    """Hits with the stored fields of their documents.

    An equi-join on the id. Hits of a search carry their size bound, so a small hit list is
    broadcast and the documents are scanned in place; a large one is joined by shuffle, where
    Spark splits a document that very many queries hit.
    """
    stored = docs.select(F.col(id_col).alias("doc_id"), *fields)
    return hits.join(stored, "doc_id")


def rescore(hits: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Exact distance and score of given ``(query_id, doc_id)`` pairs, such as hits of int8 search."""
    pairs = hits.select("query_id", "doc_id").join(docs.select("doc_id", "vector"), "doc_id")
    pairs = pairs.join(queries.select("query_id", F.col("vector").alias("_query")), "query_id")
    dist = V.l2_sq(F.col("vector"), F.col("_query"))
    return pairs.select("query_id", "doc_id", dist.alias("dist_sq"), V.score(dist).alias("score"))
