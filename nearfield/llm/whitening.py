"""Embedding whitening with Spark MLlib's BlockMatrix.

1. Vectors become integers ``x`` (64 steps a unit, shifted). The fit list, each distinct ``x`` once,
   is written; its number of rows and its sums per dimension are exact longs.
2. Every vector of a table is centred, given a row index (its task's first index and its place in the
   task) and laid into blocks of ``BLOCK_ROWS`` rows; these are the blocks of a ``BlockMatrix``.
3. Scatter: the transposed fit matrix times itself. The middle dimension is split, so the partial
   products of one block of the result spread over tasks and only sums of d x d numbers meet.
4. The driver decomposes the d x d covariance. d is the dimension, at most ``MAX_DIM``.
5. Blocks times the whitening matrix (one small block) project the rows; results meet their ids
   block by block. The same product over the fit list gives the covariance after whitening.

Everything that moves is a block of bounded size. Only d x d numbers reach the driver, and one count
per task.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped; repeated
rows and ids are answered one by one, null ids included. All other vectors must have one dimension of
1 to ``MAX_DIM``, else the operator raises, as it does for entries whose integers or deviations pass
a long. A component without variance (an eigenvalue of at most 1e-12 of the largest) can't be
whitened: its ``whitened`` is null and it stays out of ``identity_error``. An empty table gives no
rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import arrow_rows
from nearfield.session import staged

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
BLOCK_ROWS = 2_048
MAX_DIM = 2_048
#: An eigenvalue up to this share of the largest counts as none.
NO_VARIANCE = 1e-12
#: Largest sum of squares that float arithmetic is trusted to bound before it is added as longs.
LONG_LIMIT = 2.0**62


class Whitening(NamedTuple):
    """A fitted projection: ``(x - sums / n) @ matrix`` for the first components of ``x``."""

    n: int
    sums: np.ndarray  # long, per dimension
    values: np.ndarray  # eigenvalues, falling
    matrix: np.ndarray  # dimension x components; a column of zeros where there is no variance
    trace: float
    identity_error: float | None


def integers(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows whose vector is whole and finite."""
    number = lambda c: c.cast("double")
    finite = lambda c: c.isNotNull() & ~F.isnan(number(c)) & (F.abs(number(c)) != float("inf"))
    kept = rows.where(F.col(vector).isNotNull() & F.forall(vector, finite))
    steps = lambda c: F.when(F.abs(number(c) * SCALE) < LONG_LIMIT, F.floor(number(c) * SCALE)).otherwise(
        F.raise_error(F.lit("an entry passes a long")).cast("long")
    )
    x = F.transform(vector, lambda c: steps(c) + SHIFT)
    return kept.select(F.col(vec_id).alias("vec_id"), x.alias("x"))


def distinct_vectors(table: DataFrame) -> DataFrame:
    """Each distinct x once; copies meet after each task has dropped its own."""
    return table.select("x").distinct()


def totals(fit: DataFrame) -> tuple[int, np.ndarray]:
    """Rows and exact sums per dimension, summed in each task before anything moves."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(0, object)
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch["x"])
                # Upper and lower halves add up without overflow.
                part = (x >> 32).sum(axis=0).astype(object) * 2**32 + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
                if n and len(part) != len(sums):
                    raise ValueError("vectors of different dimensions")
                sums, n = (part if not n else sums + part), n + batch.num_rows
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "d": [len(sums)], "i": [[*range(len(sums))]], "s": [[str(v) for v in sums]]})

    parts = fit.mapInArrow(add, "n bigint, d bigint, i array<bigint>, s array<string>")
    size = parts.agg(F.sum("n").alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).first()
    if not size["n"]:
        return 0, np.zeros(0, np.int64)
    if size["low"] != size["high"] or not 0 < size["high"] <= MAX_DIM:
        raise ValueError(f"vectors need one dimension of 1 to {MAX_DIM}; there are {size['low']} to {size['high']}")
    by = parts.select(F.explode(F.arrays_zip("i", "s")).alias("e")).groupBy("e.i").agg(F.sum(F.col("e.s").cast("decimal(38,0)")).alias("s"))
    sums = {r["i"]: int(r["s"]) for r in by.collect()}  # one row per dimension
    return int(size["n"]), np.array([sums[i] for i in range(size["high"])], np.int64)


def matrix_of(column: pa.Array) -> np.ndarray:
    """The rows x dimensions of a list column; all lists must have one length."""
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vectors of different dimensions")
    return column.flatten().to_numpy().reshape(len(column), -1)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Sum over the dimensions of (n x - S)^2, in longs."""
    if (np.square(n * x.astype(np.float64) - sums).sum(axis=1) >= LONG_LIMIT).any():
        raise OverflowError("a deviation passes a long")
    return np.square(n * x - sums).sum(axis=1)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    rows = sum(b.num_rows for b in batches)
    yield pa.RecordBatch.from_pydict({"task": [TaskContext.get().partitionId()], "rows": [rows]})


BLOCK = "block int, ids array<bigint>, deviations array<bigint>, height int, entries array<double>"


def _lay(batches: Iterator[pa.RecordBatch], first: dict[int, tuple[int, int]], n: int, sums: np.ndarray, block_rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of centred rows, entries column by column; a task's blocks start at its own number."""
    from pyspark import TaskContext

    block, end = first[TaskContext.get().partitionId()]
    types = {"block": pa.int32(), "ids": pa.list_(pa.int64()), "deviations": pa.list_(pa.int64()), "height": pa.int32(), "entries": pa.list_(pa.float64())}

    def full(ids: list, x: np.ndarray) -> pa.RecordBatch:
        if block >= end:
            raise RuntimeError("a task has read other rows than were counted for it")
        row = [[block], [ids], [deviations(x, n, sums).tolist()], [len(x)], [((n * x - sums) / n).ravel(order="F")]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types.values())], list(types))

    ids: list = []
    held: list[np.ndarray] = []
    for batch in batches:
        if batch.num_rows:
            ids += batch["vec_id"].to_pylist()
            held.append(matrix_of(batch["x"]))
        while len(ids) >= block_rows:
            x = np.concatenate(held)
            yield full(ids[:block_rows], x[:block_rows])
            ids, held, block = ids[block_rows:], [x[block_rows:]], block + 1
    if ids:
        yield full(ids, np.concatenate(held))


def blocks(table: DataFrame, n: int, sums: np.ndarray, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(block, ids, deviations, height, entries) of the centred rows of a written table (vec_id, x).

    A first pass counts the rows of each task's split, which fixes the blocks' numbers: a task that
    is run again lays the same blocks.
    """
    sizes = sorted((r["task"], r["rows"]) for r in table.select("vec_id").mapInArrow(_sizes, "task bigint, rows bigint").collect())
    first, at = {}, 0
    for task, rows in sizes:  # one number per task
        first[task] = (at, at := at - (-rows // block_rows))
    return table.mapInArrow(functools.partial(_lay, first=first, n=n, sums=sums, block_rows=block_rows), BLOCK)


def block_matrix(laid: DataFrame, width: int, block_rows: int = BLOCK_ROWS) -> BlockMatrix:
    """The blocks as one MLlib matrix of ``width`` columns.

    A task's last block may hold fewer rows; it is filled up with zeros, which add nothing to a
    scatter and whose products are not read.
    """

    def cell(row) -> tuple[tuple[int, int], DenseMatrix]:
        entries = np.zeros((width, block_rows))
        entries[:, : row["height"]] = np.reshape(row["entries"], (width, row["height"]))
        return (row["block"], 0), DenseMatrix(block_rows, width, entries.ravel())

    number = (laid.agg(F.max("block")).first()[0] or 0) + 1
    return BlockMatrix(laid.select("block", "height", "entries").rdd.map(cell), block_rows, width, number * block_rows, width)


def product(left: BlockMatrix, right: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """``left`` times ``right``; the sum over the middle dimension is split over ``splits`` tasks."""
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def scatter(matrix: BlockMatrix, slots: int) -> np.ndarray:
    """Transposed times itself, d x d, over up to four tasks a slot."""
    splits = max(1, min(matrix.numRowBlocks, 4 * slots))
    return product(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()


def projected(laid: DataFrame, matrix: np.ndarray, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(block, values): the rows of the blocks times ``matrix``, component by component."""
    spark = laid.sparkSession
    width, k = matrix.shape
    right = spark.sparkContext.parallelize([((0, 0), DenseMatrix(width, k, matrix.ravel(order="F").tolist()))], 1)
    made = product(block_matrix(laid, width, block_rows), BlockMatrix(right, width, k))
    rows = made.blocks.map(lambda b: (b[0][0], b[1].toArray().ravel(order="F").tolist()))
    return spark.createDataFrame(rows, "block int, values array<double>")


def _spread(laid: DataFrame, block_rows: int) -> np.ndarray:
    """Covariance of blocks (height, values), centred before multiplying: sums first, then products."""

    def of(row: tuple[int, list]) -> np.ndarray:
        height, values = row
        return np.reshape(values, (-1, block_rows))[:, :height]

    pairs = laid.rdd.map(tuple)
    add = lambda a, b: (a[0] + b[0], a[1] + b[1])
    n, total = pairs.map(lambda r: (r[0], of(r).sum(axis=1))).treeReduce(add)
    mean = total / n
    products = lambda r: (y := of(r) - mean[:, None]) @ y.T
    return pairs.map(products).treeReduce(np.add) / n


def fit(table: DataFrame, components: int = COMPONENTS, block_rows: int = BLOCK_ROWS) -> Whitening | None:
    """Whitening of the distinct vectors of ``table`` (vec_id, x); None if there are none."""
    spark = table.sparkSession
    distinct = staged(distinct_vectors(table), "vectors")
    with arrow_rows(spark, BLOCK_ROWS):
        n, sums = totals(distinct)
        if not n:
            return None
        laid = staged(blocks(distinct.select(F.lit(None).cast("long").alias("vec_id"), "x"), n, sums, block_rows), "fit-blocks")
    values, vectors = np.linalg.eigh(scatter(block_matrix(laid, len(sums), block_rows), spark.sparkContext.defaultParallelism) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, len(values))
    live = values[:k] > NO_VARIANCE * max(values[0], 0)
    matrix = np.where(live, vectors[:, :k] / np.sqrt(np.where(live, values[:k], 1)), 0.0)
    error = None
    if live.any():
        whitened = staged(projected(laid, matrix, block_rows), "fit-whitened").join(laid.select("block", "height"), "block")
        after = _spread(whitened.select("height", "values"), block_rows)[np.ix_(live, live)]
        error = float(np.abs(after - np.eye(len(after))).max())
    return Whitening(n, sums, values, matrix, float(values.sum()), error)


def whiten(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every kept row."""
    table = staged(integers(rows, vec_id, vector), "integers")
    fitted = fit(table, components, block_rows)
    head = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if fitted is None:
        return rows.sparkSession.createDataFrame([], head)
    with arrow_rows(rows.sparkSession, BLOCK_ROWS):
        laid = staged(blocks(table, fitted.n, fitted.sums, block_rows), "blocks")
    made = staged(projected(laid, fitted.matrix, block_rows), "whitened")
    joined = laid.select("block", "ids", "deviations", "height").join(made, "block")
    live = fitted.values[: fitted.matrix.shape[1]] > NO_VARIANCE * max(fitted.values[0], 0)
    shares = fitted.values / fitted.trace if fitted.trace > 0 else np.zeros(len(fitted.values))
    each = F.posexplode(F.arrays_zip("ids", "deviations")).alias("place", "v")
    row = joined.select("values", each).select("values", "place", F.col("v.ids").alias("vec_id"), F.col("v.deviations").alias("deviation"))
    number = F.explode(
        F.array(*[F.struct(F.lit(i).alias("i"), F.lit(bool(ok)).alias("ok"), F.lit(float(s)).alias("share")) for i, (ok, s) in enumerate(zip(live, shares))])
    ).alias("c")
    value = F.get("values", F.col("c.i") * block_rows + F.col("place"))
    return row.select("*", number).select(
        "vec_id",
        (F.col("c.i") + 1).cast("int").alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        F.when(F.col("c.ok"), value).alias("whitened"),
        F.col("c.share").alias("explained"),
        F.lit(fitted.identity_error).cast("double").alias("identity_error"),
    )
