"""A two-level tree of pivots, for more cells than one broadcast can hold.

The upper level is a small table of roots, the lower level a table of leaves of any size; every leaf
hangs under its nearest root. A row goes to its nearest root, which is broadcast, and then to the
nearest leaf under that root, which meets it by a join on the root. Queries go the same way with
several roots and leaves each. No step needs all leaves in one place:

* A root with more leaves than ``max_leaves`` is split by more roots, taken from its own leaves, so
  what one group of the join holds is bounded. Equal leaves are one leaf, so splitting ends.
* A root with very many rows is dealt over as many groups as its rows fill, its leaves repeated.

The index is stored by root, sorted by leaf: a search reads the folders of the probed roots, and in
their files the row groups that hold its leaves.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.operators import ann
from nearfield.operators.kernel import LocalTopK, ids_of, matrix_of
from nearfield.operators.knn import BROADCAST_BYTES, CHUNK_BYTES, arrow_schema, small, vectors_size
from nearfield.session import file_count, staged

MAX_LEAVES = 4_096
GROUP_BYTES = 64 << 20  # rows that one group of the join holds
_ROUNDS = 30


@dataclass(frozen=True)
class PivotTree:
    """``roots (root, vector)``, few, and ``leaves (root, cell, vector)``, any number."""

    roots: DataFrame
    leaves: DataFrame

    def write(self, path: str) -> PivotTree:
        """Store the tree; the leaves by root, so that a search reads those of its roots."""
        self.roots.write.mode("overwrite").parquet(f"{path}/roots")
        ranged = self.leaves.repartitionByRange("root", "cell").sortWithinPartitions("root", "cell")
        ranged.write.mode("overwrite").parquet(f"{path}/leaves")
        return PivotTree.load(self.roots.sparkSession, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> PivotTree:
        return PivotTree(spark.read.parquet(f"{path}/roots"), spark.read.parquet(f"{path}/leaves"))


def hash_pivots(corpus: DataFrame, m: int, id_col: str = "doc_id", vector_col: str = "vector") -> DataFrame:
    """About m rows as ``(cell, vector)``: those whose id hash lies in the lowest m-th part.

    A filter and nothing else, so m may be millions; ``sample_pivots`` keeps exactly m and brings
    them to the driver.
    """
    total = corpus.count()
    rows = corpus.select(F.col(id_col).alias("cell"), F.col(vector_col).alias("vector"))
    if m >= total:
        return rows
    hashed = F.md5(F.col("cell").cast("string").cast("binary"))
    return rows.filter(hashed < f"{int(m / total * 16**8):08x}")


def build_tree(pivots: DataFrame, n_roots: int | None = None, max_leaves: int = MAX_LEAVES) -> PivotTree:
    """A tree over ``pivots (cell, vector)``; by default with as many roots as leaves under each."""
    spark = pivots.sparkSession
    # Equal leaves would only tie with each other; the smallest one stays.
    single = staged(pivots.groupBy("vector").agg(F.min("cell").alias("cell")).select("cell", "vector"), "leaves")
    total = single.count()
    if not total:
        raise ValueError("no pivots")
    roots = ann.sample_pivots(single, min(total, n_roots or math.ceil(total**0.5)), id_col="cell")
    for _ in range(_ROUNDS):
        hung = staged(_hang(single, roots), "tree")
        counts = hung.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > max_leaves)
        if counts.isEmpty():
            return PivotTree(roots.withColumnRenamed("cell", "root"), hung)
        order = Window.partitionBy("root").orderBy(F.md5(F.col("cell").cast("string").cast("binary")), "cell")
        crowded = hung.join(small(counts, roots.count(), 16), "root").withColumn("_place", F.row_number().over(order))
        added = crowded.filter(F.col("_place") <= F.ceil(2 * F.col("n") / max_leaves)).select("cell", "vector")
        added = added.join(roots.select("cell"), "cell", "left_anti")
        more = roots.unionByName(added)
        size = vectors_size(more)
        if size["bytes"] > BROADCAST_BYTES:
            raise ValueError(f"{size['rows']} roots take {size['bytes']} bytes; allow more leaves under a root")
        roots = spark.createDataFrame(more.toArrow(), roots.schema)
    raise ValueError(f"a root still has more than {max_leaves} leaves after {_ROUNDS} rounds")


def _hang(leaves: DataFrame, roots: DataFrame) -> DataFrame:
    """``(root, cell, vector)``: every leaf under its nearest root."""
    named = leaves.select(F.col("cell").alias("leaf"), "vector")
    near = ann.nearest_cells(named, roots, 1)
    return near.select(F.col("cell").alias("root"), F.col("leaf").alias("cell"), "vector")


def assign_leaves(df: DataFrame, tree: PivotTree, vector_col: str = "vector", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Every row of ``df`` with its ``root`` and, under it, its ``cell``."""
    root_type, cell_type = tree.leaves.schema["root"].dataType, tree.leaves.schema["cell"].dataType
    rooted = ann.nearest_cells(df, tree.roots.withColumnRenamed("root", "cell"), 1, vector_col)
    rooted = staged(rooted.drop("cell_rank").withColumnRenamed("cell", "root"), "rooted")
    size = rooted.agg(F.coalesce(F.max(F.size(vector_col)), F.lit(1)).alias("dim")).first()
    per_group = max(1, group_bytes // (4 * max(1, size["dim"] or 1)))
    groups = rooted.groupBy("root").agg(F.ceil(F.count("*") / per_group).cast("int").alias("_groups"))
    groups = small(groups, tree.roots.count(), 16)
    dealt = rooted.join(groups, "root").withColumn("_group", F.pmod(F.xxhash64(vector_col, *df.columns[:1]), F.col("_groups")).cast("int"))
    repeated = tree.leaves.join(groups, "root").withColumn("_group", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)))
    # The types as they were read back: a group's table can't promise that elements are never null.
    fields = [rooted.schema[c] for c in df.columns]
    schema = T.StructType([*fields, T.StructField("root", root_type), T.StructField("cell", cell_type)])
    names = [*df.columns, "root"]
    cell_arrow = arrow_schema(T.StructType([T.StructField("cell", cell_type)])).field(0).type

    def nearest(rows: pa.Table, leaves: pa.Table) -> pa.Table:
        kept = rows.select(names)
        if not rows.num_rows:
            return kept.append_column("cell", pa.array([], cell_arrow))
        centres, ids = matrix_of(leaves["vector"]), ids_of(leaves["cell"])
        cells = []
        for at in range(0, rows.num_rows, 10_000):
            near = LocalTopK(matrix_of(rows[vector_col].slice(at, 10_000), centres.shape[1]), 1)
            near.add(centres, ids)
            pos, found, _ = near.result()
            cells.append(found[np.argsort(pos, kind="stable")])
        return kept.append_column("cell", pa.array(np.concatenate(cells)).cast(cell_arrow))

    keys = ["root", "_group"]
    left = dealt.select(*names, "_group").groupBy(*keys)
    return left.cogroup(repeated.select("root", "_group", "cell", "vector").groupBy(*keys)).applyInArrow(nearest, schema)


def write_tree_index(assigned: DataFrame, path: str, file_bytes: int = 128 << 20, id_col: str = "doc_id", vector_col: str = "vector") -> None:
    """Store assigned rows by root, sorted by leaf and id, in tasks of about ``file_bytes``.

    Each root is dealt over as many tasks as its own rows fill, by ranges of leaf and id, so one
    that holds a third of the rows spans many.
    """
    assigned = staged(assigned, "leaves")
    size = vectors_size(assigned, vector_col)
    files = file_count(assigned.sparkSession, size["bytes"], file_bytes)
    ranged = assigned.repartitionByRange(files, "root", "cell", id_col).sortWithinPartitions("root", "cell", id_col)
    ranged.write.mode("overwrite").partitionBy("root").parquet(path)


def tree_search(
    index: DataFrame,
    queries: DataFrame,
    tree: PivotTree,
    k: int,
    nroots: int,
    nprobe: int,
    *,
    broadcast_bytes: int = BROADCAST_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """k nearest rows of ``index (root, cell, doc_id, vector)`` within each query's probed leaves.

    A query looks at the leaves under its ``nroots`` nearest roots and probes the ``nprobe``
    nearest of them; probing everything is the exact search.
    """
    queries = queries.select("query_id", "vector")
    size = vectors_size(queries)
    by_root = ann.nearest_cells(queries, tree.roots.withColumnRenamed("root", "cell"), nroots).drop("cell_rank")
    by_root = staged(by_root, "probed-roots")
    upper = tree.leaves.select(F.col("root").alias("cell"), F.col("cell").alias("doc_id"), "vector")
    found = ann.search_cells(upper, by_root, nprobe, nroots, size, broadcast_bytes, chunk_bytes)
    probes = found.select("query_id", F.col("doc_id").alias("cell")).join(queries, "query_id").select("query_id", "vector", "cell")
    # At most one row per root.
    roots = [r["cell"] for r in by_root.select("cell").distinct().collect()]
    rows = index.filter(F.col("root").isin(roots)) if 0 < len(roots) <= ann._PRUNE_LITERALS else index
    return ann.search_cells(
        rows.select("cell", "doc_id", "vector"), staged(probes, "probes"), k, nprobe, size, broadcast_bytes, chunk_bytes
    )
