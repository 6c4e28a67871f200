"""Registered vector queries over the ``embeddings`` table; every vector is also a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.operators import ann, bounds, pivot_tree, recall
from nearfield.operators.knn import knn
from nearfield.session import scratch_path
from nearfield.sources import cell_index, tables, vector_files
from nearfield.streaming import ingest

K = 5
PIVOTS, NPROBE = 10, 4
TRAIN_ROUNDS = 3
LEAVES, ROOTS, NROOTS = 60, 8, 3


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf}/embeddings.parquet")
    return raw.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")


def as_queries(df: DataFrame, vector_col: str = "vector") -> DataFrame:
    return df.select(F.col("doc_id").alias("query_id"), F.col(vector_col).alias("vector"))


def int8_corpus(docs: DataFrame) -> DataFrame:
    quantized = bounds.quantize_table(docs, bounds.frozen_bounds(docs))
    return quantized.select("doc_id", F.col("qvector").alias("vector"))


def exact_hits(docs: DataFrame) -> DataFrame:
    return knn(docs, as_queries(docs), K)


def int8_hits(docs: DataFrame) -> DataFrame:
    small = int8_corpus(docs)
    return knn(small, as_queries(small), K)


def pivot_hits(docs: DataFrame, nprobe: int = NPROBE) -> DataFrame:
    pivots = ann.sample_pivots(docs, PIVOTS)
    return ann.ann_search(ann.assign_cells(docs, pivots), as_queries(docs), pivots, K, nprobe)


def _elements(df: DataFrame, vector_col: str) -> DataFrame:
    rows = df.select(F.col("doc_id").alias("vec_id"), F.posexplode(vector_col).alias("pos", "q"))
    return rows.select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("q").cast("long").alias("q"))


def vector_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return bounds.vector_bounds(corpus(spark, sf))


def vector_profile(spark: SparkSession, sf: str) -> DataFrame:
    return bounds.vector_profile(corpus(spark, sf)).withColumn("mean_norm", F.round("mean_norm", 6))


def vector_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted and rejected rows after every vector with a negative first element lost one element."""
    v = F.col("vector")
    docs = corpus(spark, sf).withColumn("vector", F.when(F.get(v, F.lit(0)) < 0, F.slice(v, 1, 63)).otherwise(v))
    accepted, rejected = V.split_valid(docs, dim=64)
    both = accepted.select(F.lit("accepted").alias("kind")).unionAll(rejected.select(F.lit("rejected").alias("kind")))
    return both.groupBy("kind").agg(F.count("*").alias("n"))


def quantize_clamped(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus(spark, sf)
    return _elements(bounds.quantize_table(docs, bounds.vector_bounds(docs)), "qvector")


def quantize_wrapped(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds at half the true ones, so that many elements lie outside and wrap around."""
    docs = corpus(spark, sf)
    half = bounds.vector_bounds(docs).select((F.col("vmin") / 2).alias("vmin"), (F.col("vmax") / 2).alias("vmax"))
    half = half.select(F.col("vmin").cast("float").alias("vmin"), F.col("vmax").cast("float").alias("vmax"))
    return _elements(bounds.quantize_table(docs, half, overflow="wrap"), "qvector")


def query_quantize_corpus_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Queries twice as long as the corpus vectors, quantized on the scale of the corpus."""
    docs = corpus(spark, sf)
    queries = docs.withColumn("vector", F.transform("vector", lambda x: (x + x).cast("float")))
    return _elements(bounds.quantize_table(queries, bounds.vector_bounds(docs)), "qvector")


def knn_exact(spark: SparkSession, sf: str) -> DataFrame:
    hits = exact_hits(corpus(spark, sf))
    return hits.select("query_id", "doc_id", "rank", F.round(F.sqrt("dist_sq"), 6).alias("dist"))


def knn_blocked(spark: SparkSession, sf: str) -> DataFrame:
    """A query set in blocks of a few hundred KB; the corpus is scanned in place for each."""
    docs = corpus(spark, sf)
    hits = knn(docs, as_queries(docs), K, broadcast_bytes=200 << 10, chunk_bytes=64 << 10)
    return hits.select("query_id", "doc_id", "rank", F.round(F.sqrt("dist_sq"), 6).alias("dist"))


def knn_float_scored(spark: SparkSession, sf: str) -> DataFrame:
    hits = exact_hits(corpus(spark, sf))
    return hits.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def knn_int8(spark: SparkSession, sf: str) -> DataFrame:
    return int8_hits(corpus(spark, sf)).select("query_id", "doc_id", "rank", "dist_sq")


def knn_int8_scored(spark: SparkSession, sf: str) -> DataFrame:
    hits = int8_hits(corpus(spark, sf))
    return hits.select("query_id", "doc_id", "rank", F.round("score", 12).alias("score"))


def knn_int8_rescored(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of the int8 search with their exact float distance."""
    docs = corpus(spark, sf)
    exact = ann.rescore(int8_hits(docs), docs, as_queries(docs))
    return exact.select("query_id", "doc_id", F.round("dist_sq", 6).alias("dist_sq"))


def knn_hits_lookup(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus(spark, sf)
    hits = ann.lookup(exact_hits(docs), tables.with_title(docs), ["title", "label"])
    return hits.select("query_id", "rank", "doc_id", "title", "label", F.round("score", 6).alias("score"))


def multi_vector_doc_knn(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors of a label are one document; it ranks by its nearest vector."""
    docs = corpus(spark, sf)
    hits = knn(docs, as_queries(docs), K, id_col="label", per_owner=True)
    return hits.select("query_id", F.col("doc_id").alias("label"), "rank", F.round("dist_sq", 6).alias("dist_sq"))


def ann_pivot(spark: SparkSession, sf: str) -> DataFrame:
    hits = pivot_hits(corpus(spark, sf))
    return hits.select("query_id", "doc_id", "rank", F.round("dist_sq", 6).alias("dist_sq"))


def ann_pivot_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The same search over an index written as a table, reading only probed cells."""
    docs = corpus(spark, sf)
    pivots = ann.sample_pivots(docs, PIVOTS)
    path = scratch_path(spark, "index")
    ann.write_index(ann.assign_cells(docs, pivots), path)
    hits = ann.ann_search(spark.read.parquet(path), as_queries(docs), pivots, K, NPROBE)
    return hits.select("query_id", "doc_id", "rank", F.round("dist_sq", 6).alias("dist_sq"))


def ann_pivot_int8(spark: SparkSession, sf: str) -> DataFrame:
    """Cells, probes and distances all on int8 vectors: every value is an exact integer."""
    small = int8_corpus(corpus(spark, sf))
    pivots = ann.sample_pivots(small, PIVOTS)
    hits = ann.ann_search(ann.assign_cells(small, pivots), as_queries(small), pivots, K, NPROBE)
    return hits.select("query_id", "doc_id", "rank", "dist_sq")


def ann_trained_pivots(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus(spark, sf)
    pivots = ann.train_pivots(docs, ann.sample_pivots(docs, PIVOTS), TRAIN_ROUNDS)
    hits = ann.ann_search(ann.assign_cells(docs, pivots), as_queries(docs), pivots, K, NPROBE)
    return hits.select("query_id", "doc_id", "rank", F.round("dist_sq", 6).alias("dist_sq"))


def ann_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Two levels of pivots; the index is stored by root and reads the probed roots only."""
    docs = corpus(spark, sf)
    tree = pivot_tree.build_tree(pivot_tree.hash_pivots(docs, LEAVES), ROOTS)
    path = scratch_path(spark, "tree")
    pivot_tree.write_tree_index(pivot_tree.assign_leaves(docs, tree), path)
    hits = pivot_tree.tree_search(spark.read.parquet(path), as_queries(docs), tree, K, NROOTS, NPROBE)
    return hits.select("query_id", "doc_id", "rank", F.round("dist_sq", 6).alias("dist_sq"))


def ann_lsh(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus(spark, sf)
    hits = ann.filled_search(ann.hashed_cells(docs), as_queries(docs), K, nprobe=7)
    return hits.select("query_id", "doc_id", "rank", F.round("dist_sq", 6).alias("dist_sq"))


def cell_sizes(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus(spark, sf)
    assigned = ann.assign_cells(docs, ann.sample_pivots(docs, PIVOTS))
    return assigned.groupBy("cell").agg(F.count("*").alias("n"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("recall", F.round("recall", 6))


def recall_int8_vs_float(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus(spark, sf)
    return _rounded(recall.recall_at_k(exact_hits(docs), int8_hits(docs), K))


def recall_ann_vs_exact(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus(spark, sf)
    return _rounded(recall.recall_at_k(exact_hits(docs), pivot_hits(docs), K))


def recall_exact_vs_ann(spark: SparkSession, sf: str) -> DataFrame:
    """The index as the truth and the exact search as the candidate."""
    docs = corpus(spark, sf)
    return _rounded(recall.recall_at_k(pivot_hits(docs), exact_hits(docs), K))


def hits_in_truth(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus(spark, sf)
    return recall.matched_hits(exact_hits(docs), int8_hits(docs))


def recall_per_query(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus(spark, sf)
    return _rounded(recall.recall_per_query(exact_hits(docs), int8_hits(docs), K))


def recall_vs_ground_truth(spark: SparkSession, sf: str) -> DataFrame:
    """int8 hits against a ground-truth file of the exact neighbours, written and read as ivecs."""
    docs = corpus(spark, sf)
    lists = recall.ids_per_query(exact_hits(docs))
    path = scratch_path(spark, "truth")
    vector_files.write_vecs(lists, path, "query_id", "doc_ids", "ivecs")
    truth = vector_files.truth_pairs(vector_files.read_ivecs(spark, path))
    return _rounded(recall.recall_at_k(truth, int8_hits(docs), K))


def ids_per_query(spark: SparkSession, sf: str) -> DataFrame:
    ids = recall.ids_per_query(exact_hits(corpus(spark, sf)))
    return ids.select("query_id", F.array_join("doc_ids", ",").alias("doc_ids"))


def set_intersection_size(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus(spark, sf)
    a = exact_hits(docs).select(*recall.HIT_KEY)
    b = int8_hits(docs).select(*recall.HIT_KEY)
    return a.intersect(b).groupBy("query_id").agg(F.count("*").alias("n_common"))


def storage_footprint(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus(spark, sf)
    return bounds.storage_footprint(bounds.quantize_table(docs, bounds.vector_bounds(docs)))


def stream_ingest_int8(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus arrives as four files, each a micro-batch, on the scale of the whole corpus."""
    docs = corpus(spark, sf)
    frozen = bounds.vector_bounds(docs).first()
    path = scratch_path(spark, "ingest")
    docs.select("doc_id", "vector").repartition(4, "doc_id").write.parquet(f"{path}/in")
    source = spark.readStream.schema("doc_id long, vector array<float>").option("maxFilesPerTrigger", 1)
    run = ingest.stream_ingest(
        source.parquet(f"{path}/in"), f"{path}/table", f"{path}/bounds", f"{path}/log", frozen["vmin"], frozen["vmax"]
    )
    run.awaitTermination()
    return _elements(spark.read.parquet(f"{path}/table"), "qvector")


def stream_ingest_ann(spark: SparkSession, sf: str) -> DataFrame:
    """Rows get their index cell as they arrive; the ingested table is then searched as an index."""
    docs = corpus(spark, sf)
    frozen = bounds.vector_bounds(docs).first()
    pivots = ann.sample_pivots(docs, PIVOTS)
    path = scratch_path(spark, "ingest-ann")
    docs.select("doc_id", "vector").repartition(3, "doc_id").write.parquet(f"{path}/in")
    source = spark.readStream.schema("doc_id long, vector array<float>").parquet(f"{path}/in")
    run = ingest.stream_ingest(
        source, f"{path}/table", f"{path}/bounds", f"{path}/log", frozen["vmin"], frozen["vmax"], pivots
    )
    run.awaitTermination()
    hits = ann.ann_search(cell_index.read_index(spark, f"{path}/table"), as_queries(docs), pivots, K, NPROBE)
    return hits.select("query_id", "doc_id", "rank", F.round("dist_sq", 6).alias("dist_sq"))


def cell_index_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """An index that grew by two batches, one of them twice, was folded, and grew again."""
    docs = corpus(spark, sf)
    pivots = ann.sample_pivots(docs, PIVOTS)
    assigned = ann.assign_cells(docs, pivots)
    path = scratch_path(spark, "cells")
    for number, part in ((0, 0), (1, 1), (1, 1)):
        cell_index.write_generation(assigned.filter(F.col("doc_id") % 3 == part), path, number)
    cell_index.compact(spark, path)
    cell_index.write_generation(assigned.filter(F.col("doc_id") % 3 == 2), path, 2)
    hits = ann.ann_search(cell_index.read_index(spark, path), as_queries(docs), pivots, K, NPROBE)
    return hits.select("query_id", "doc_id", "rank", F.round("dist_sq", 6).alias("dist_sq"))


def stream_observed_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds seen by an ingest whose frozen bounds are narrower than the data."""
    docs = corpus(spark, sf)
    path = scratch_path(spark, "drift")
    docs.select("doc_id", "vector").repartition(4, "doc_id").write.parquet(f"{path}/in")
    source = spark.readStream.schema("doc_id long, vector array<float>").option("maxFilesPerTrigger", 1)
    run = ingest.stream_ingest(
        source.parquet(f"{path}/in"), f"{path}/table", f"{path}/bounds", f"{path}/log", -0.25, 0.25
    )
    run.awaitTermination()
    return ingest.observed_bounds(spark, f"{path}/bounds", -0.25, 0.25)


QUERIES = {
    fn.__name__: fn
    for fn in (
        vector_bounds,
        vector_profile,
        vector_validation,
        quantize_clamped,
        quantize_wrapped,
        query_quantize_corpus_bounds,
        knn_exact,
        knn_blocked,
        knn_float_scored,
        knn_int8,
        knn_int8_scored,
        knn_int8_rescored,
        knn_hits_lookup,
        multi_vector_doc_knn,
        ann_pivot,
        ann_pivot_stored,
        ann_pivot_int8,
        ann_trained_pivots,
        ann_tree,
        ann_lsh,
        cell_sizes,
        recall_int8_vs_float,
        recall_ann_vs_exact,
        recall_exact_vs_ann,
        hits_in_truth,
        recall_per_query,
        recall_vs_ground_truth,
        ids_per_query,
        set_intersection_size,
        storage_footprint,
        stream_ingest_int8,
        stream_ingest_ann,
        cell_index_compacted,
        stream_observed_bounds,
    )
}

# --- SQL counterparts ---------------------------------------------------------------------

_BOUNDS = """b AS (
  SELECT min(list_min(embedding)) AS vmin, max(list_max(embedding)) AS vmax FROM embeddings
)"""


def _level(v: str, lo: str, hi: str) -> str:
    return f"floor((({v} - {lo}) / ({hi} - {lo}) * 255::FLOAT)::DOUBLE + 0.5) - 128"


def _clamped(vector: str) -> str:
    level = _level("v", "vmin", "vmax")
    return f"list_transform({vector}, lambda v: greatest(-128, least(127, {level}))::BIGINT)"


_INT8 = f"""{_BOUNDS}, i8 AS (
  SELECT vec_id AS id, {_clamped('embedding')} AS v FROM embeddings, b
)"""
_FLOATS = "fl AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"


def _dist(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _exact(name: str, source: str, kind: str = "DOUBLE") -> str:
    return f"""{name}_pairs AS (
  SELECT q.id AS query_id, c.id AS doc_id, {_dist('q.v', 'c.v')}::{kind} AS dist_sq FROM {source} q, {source} c
), {name} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist_sq, doc_id) AS rank FROM {name}_pairs
  ) WHERE rank <= {K}
)"""


def _pivoted(name: str, source: str, kind: str = "DOUBLE") -> str:
    return f"""pivots AS (
  SELECT id AS cell, v FROM {source} ORDER BY md5(id::VARCHAR), id LIMIT {PIVOTS}
), near AS (
  SELECT c.id, c.v, p.cell, row_number() OVER (PARTITION BY c.id ORDER BY {_dist('c.v', 'p.v')}, p.cell) AS n
  FROM {source} c, pivots p
), {name}_pairs AS (
  SELECT q.id AS query_id, c.id AS doc_id, {_dist('q.v', 'c.v')}::{kind} AS dist_sq
  FROM near q JOIN near c ON q.cell = c.cell WHERE q.n <= {NPROBE} AND c.n = 1
), {name} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist_sq, doc_id) AS rank FROM {name}_pairs
  ) WHERE rank <= {K}
)"""


def _recall(truth: str, candidate: str, n: str = "count(DISTINCT t.query_id)") -> str:
    return f"""SELECT {n} AS n_queries, count(c.doc_id) AS matched,
  round(count(c.doc_id)::DOUBLE / ({float(K)} * {n}), 6) AS recall
FROM {truth} t LEFT JOIN {candidate} c ON t.query_id = c.query_id AND t.doc_id = c.doc_id"""


def _trained(rounds: int = TRAIN_ROUNDS) -> str:
    """Rounds of assignment and means, each on the centres of the one before."""
    steps = [f"c0 AS (SELECT id AS cell, v FROM fl ORDER BY md5(id::VARCHAR), id LIMIT {PIVOTS})"]
    for i in range(rounds):
        steps.append(f"""a{i} AS (
  SELECT id, f.v, cell FROM fl f, c{i} c QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_dist('f.v', 'c.v')}, cell) = 1
), m{i} AS (
  SELECT cell, list((s / n)::FLOAT::DOUBLE ORDER BY j) AS v FROM (
    SELECT cell, j, sum(x) AS s, count(*) AS n FROM (SELECT cell, generate_subscripts(v, 1) AS j, unnest(v) AS x FROM a{i}) GROUP BY cell, j
  ) GROUP BY cell
), c{i + 1} AS (SELECT cell, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (cell))""")
    return ", ".join(steps)


def _within(cells: str) -> str:
    """Hits among rows of the probed cells: ``near (id, v, cell, n)`` has them in order."""
    return f"""near AS (
  SELECT f.id, f.v, p.cell, row_number() OVER (PARTITION BY f.id ORDER BY {_dist('f.v', 'p.v')}, p.cell) AS n FROM fl f, {cells} p
), pairs AS (
  SELECT q.id AS query_id, c.id AS doc_id, {_dist('q.v', 'c.v')} AS dist_sq
  FROM near q JOIN near c ON q.cell = c.cell WHERE q.n <= {NPROBE} AND c.n = 1
), hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist_sq, doc_id) AS rank FROM pairs QUALIFY rank <= {K}
)"""


_TREE = f"""chosen AS (
  SELECT min(id) AS cell, v FROM fl, (SELECT count(*) AS total FROM fl)
  WHERE total <= {LEAVES} OR md5(id::VARCHAR) < printf('%08x', floor({float(LEAVES)} / total * 16 ** 8)::BIGINT) GROUP BY v
), roots AS (SELECT cell AS root, v FROM chosen ORDER BY md5(cell::VARCHAR), cell LIMIT {ROOTS}),
leaves AS (
  SELECT c.cell, c.v, r.root FROM chosen c, roots r
  QUALIFY row_number() OVER (PARTITION BY c.cell ORDER BY {_dist('c.v', 'r.v')}, r.root) = 1
), by_root AS (
  SELECT f.id, f.v, r.root, row_number() OVER (PARTITION BY f.id ORDER BY {_dist('f.v', 'r.v')}, r.root) AS n FROM fl f, roots r
), homes AS (
  SELECT f.id, f.v, l.cell FROM by_root f JOIN leaves l ON f.n = 1 AND f.root = l.root
  QUALIFY row_number() OVER (PARTITION BY f.id ORDER BY {_dist('f.v', 'l.v')}, l.cell) = 1
), probes AS (
  SELECT f.id, f.v, l.cell FROM by_root f JOIN leaves l ON f.n <= {NROOTS} AND f.root = l.root
  QUALIFY row_number() OVER (PARTITION BY f.id ORDER BY {_dist('f.v', 'l.v')}, l.cell) <= {NPROBE}
), hits AS (
  SELECT q.id AS query_id, c.id AS doc_id, {_dist('q.v', 'c.v')} AS dist_sq FROM probes q JOIN homes c USING (cell)
  QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY {_dist('q.v', 'c.v')}, c.id) <= {K}
)"""


_ELEMENTS = "SELECT vec_id, generate_subscripts(q, 1) - 1 AS pos, unnest(q) AS q FROM quantized"
_FLOAT_KNN = f"WITH {_FLOATS}, {_exact('hits', 'fl')}"
_INT8_KNN = f"WITH {_INT8}, {_exact('hits', 'i8', 'BIGINT')}"
_BOTH_KNN = f"WITH {_FLOATS}, {_INT8}, {_exact('f', 'fl')}, {_exact('i', 'i8', 'BIGINT')}"
_PIVOT_KNN = f"WITH {_FLOATS}, {_pivoted('hits', 'fl')}"
_QUANTIZED = f"WITH {_BOUNDS}, quantized AS (SELECT vec_id, {_clamped('embedding')} AS q FROM embeddings, b) {_ELEMENTS}"
_WRAP_LEVEL = _level("v", "lo", "hi")

ORACLES = {
    "vector_bounds": f"WITH {_BOUNDS} SELECT vmin, vmax FROM b",
    "vector_profile": """SELECT count(*) AS n_vectors, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim,
  round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS mean_norm
FROM embeddings""",
    "vector_validation": """SELECT CASE WHEN embedding[1] < 0 THEN 'rejected' ELSE 'accepted' END AS kind, count(*) AS n
FROM embeddings GROUP BY 1""",
    "quantize_clamped": _QUANTIZED,
    "quantize_wrapped": f"""WITH {_BOUNDS}, h AS (
  SELECT (vmin::DOUBLE / 2)::FLOAT AS lo, (vmax::DOUBLE / 2)::FLOAT AS hi FROM b
), quantized AS (
  SELECT vec_id, list_transform(embedding, lambda v:
    (((({_WRAP_LEVEL})::BIGINT + 128) % 256 + 256) % 256) - 128) AS q
  FROM embeddings, h
) {_ELEMENTS}""",
    "query_quantize_corpus_bounds": f"""WITH {_BOUNDS}, queries AS (
  SELECT vec_id, list_transform(embedding, lambda x: (x + x)::FLOAT) AS v2 FROM embeddings
), quantized AS (SELECT vec_id, {_clamped('v2')} AS q FROM queries, b) {_ELEMENTS}""",
    "knn_exact": f"{_FLOAT_KNN} SELECT query_id, doc_id, rank, round(sqrt(dist_sq), 6) AS dist FROM hits",
    "knn_blocked": f"{_FLOAT_KNN} SELECT query_id, doc_id, rank, round(sqrt(dist_sq), 6) AS dist FROM hits",
    "knn_float_scored": f"{_FLOAT_KNN} SELECT query_id, doc_id, rank, round(1 / (1 + dist_sq), 6) AS score FROM hits",
    "knn_int8": f"{_INT8_KNN} SELECT query_id, doc_id, rank, dist_sq FROM hits",
    "knn_int8_scored": f"""{_INT8_KNN}
SELECT query_id, doc_id, rank, round(1.0::DOUBLE / (1 + dist_sq), 12) AS score FROM hits""",
    "knn_int8_rescored": f"""WITH {_FLOATS}, {_INT8}, {_exact('i', 'i8', 'BIGINT')}
SELECT query_id, doc_id, round({_dist('q.v', 'c.v')}, 6) AS dist_sq
FROM i JOIN fl q ON q.id = query_id JOIN fl c ON c.id = doc_id""",
    "knn_hits_lookup": f"""{_FLOAT_KNN}
SELECT query_id, rank, doc_id, 'title' AS title, label, round(1 / (1 + dist_sq), 6) AS score
FROM hits JOIN embeddings ON vec_id = doc_id""",
    "multi_vector_doc_knn": f"""WITH {_FLOATS}, docs AS (
  SELECT q.id AS query_id, e.label, min({_dist('q.v', 'c.v')}) AS dist_sq
  FROM fl q, fl c JOIN embeddings e ON e.vec_id = c.id GROUP BY ALL
)
SELECT query_id, label, rank, round(dist_sq, 6) AS dist_sq FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist_sq, label) AS rank FROM docs
) WHERE rank <= {K}""",
    "ann_pivot": f"{_PIVOT_KNN} SELECT query_id, doc_id, rank, round(dist_sq, 6) AS dist_sq FROM hits",
    "ann_pivot_stored": f"{_PIVOT_KNN} SELECT query_id, doc_id, rank, round(dist_sq, 6) AS dist_sq FROM hits",
    "ann_pivot_int8": f"""WITH {_INT8}, {_pivoted('hits', 'i8', 'BIGINT')}
SELECT query_id, doc_id, rank, dist_sq FROM hits""",
    "ann_trained_pivots": f"""WITH {_FLOATS}, {_trained()}, {_within(f'c{TRAIN_ROUNDS}')}
SELECT query_id, doc_id, rank, round(dist_sq, 6) AS dist_sq FROM hits""",
    "ann_tree": f"""WITH {_FLOATS}, {_TREE} SELECT query_id, doc_id,
  row_number() OVER (PARTITION BY query_id ORDER BY dist_sq, doc_id) AS rank, round(dist_sq, 6) AS dist_sq FROM hits""",
    # The last box holds every row that can be nearer, so the buckets' search is the exact one.
    "ann_lsh": f"{_FLOAT_KNN} SELECT query_id, doc_id, rank, round(dist_sq, 6) AS dist_sq FROM hits",
    "cell_sizes": f"{_PIVOT_KNN} SELECT cell, count(*) AS n FROM near WHERE n = 1 GROUP BY cell",
    "recall_int8_vs_float": f"{_BOTH_KNN} {_recall('f', 'i')}",
    "recall_ann_vs_exact": f"WITH {_FLOATS}, {_exact('f', 'fl')}, {_pivoted('a', 'fl')} {_recall('f', 'a')}",
    "recall_exact_vs_ann": f"WITH {_FLOATS}, {_exact('f', 'fl')}, {_pivoted('a', 'fl')} {_recall('a', 'f')}",
    "hits_in_truth": f"{_BOTH_KNN} SELECT query_id, doc_id FROM f INTERSECT SELECT query_id, doc_id FROM i",
    "recall_per_query": f"""{_BOTH_KNN}
SELECT f.query_id, count(i.doc_id) AS matched, round(count(i.doc_id) / {float(K)}::DOUBLE, 6) AS recall
FROM f LEFT JOIN i ON f.query_id = i.query_id AND f.doc_id = i.doc_id GROUP BY f.query_id""",
    "recall_vs_ground_truth": f"{_BOTH_KNN} {_recall('f', 'i')}",
    "ids_per_query": f"""{_FLOAT_KNN}
SELECT query_id, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS doc_ids FROM hits GROUP BY query_id""",
    "set_intersection_size": f"""{_BOTH_KNN}, common AS (
  SELECT query_id, doc_id FROM f INTERSECT SELECT query_id, doc_id FROM i
)
SELECT query_id, count(*) AS n_common FROM common GROUP BY query_id""",
    "storage_footprint": """SELECT sum(len(embedding) * 4)::BIGINT AS float_bytes, sum(len(embedding))::BIGINT AS int8_bytes,
  sum(len(embedding) * 4)::DOUBLE / sum(len(embedding)) AS ratio FROM embeddings""",
    "stream_ingest_int8": _QUANTIZED,
    "stream_ingest_ann": f"{_PIVOT_KNN} SELECT query_id, doc_id, rank, round(dist_sq, 6) AS dist_sq FROM hits",
    "cell_index_compacted": f"{_PIVOT_KNN} SELECT query_id, doc_id, rank, round(dist_sq, 6) AS dist_sq FROM hits",
    "stream_observed_bounds": f"""WITH {_BOUNDS}
SELECT (SELECT count(*) FROM embeddings) AS n_rows, 0::BIGINT AS n_rejected, vmin, vmax,
  vmin < -0.25::FLOAT OR vmax > 0.25::FLOAT AS drifted FROM b""",
}
