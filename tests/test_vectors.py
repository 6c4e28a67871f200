import math

import numpy as np
import pytest
from pyspark.errors import PythonException, SparkRuntimeException
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.operators import ann, bounds, recall
from nearfield.operators import knn as knn_module
from nearfield.operators.knn import knn
from nearfield.session import scratch_path
from nearfield.sources.documents import vector_rows

DEMO = [("far", [9, 9]), ("north", [0, 4]), ("east", [4, 0])]


def table(spark, rows, columns="doc_id long, vector array<float>"):
    return spark.createDataFrame(rows, columns)


def random_corpus(spark, n=400, dim=12, seed=1, parts=5, hot=True):
    """Vectors of which a third are one and the same."""
    x = np.random.default_rng(seed).standard_normal((n, dim)).astype(np.float32)
    if hot:
        x[::3] = x[0]
    return table(spark, [(i, [float(v) for v in row]) for i, row in enumerate(x)]).repartition(parts)


def queries_of(docs):
    return docs.select(F.col("doc_id").alias("query_id"), "vector")


def collected(hits):
    return sorted(tuple(r) for r in hits.collect())


def test_demo_search(spark):
    docs = vector_rows(spark, DEMO)
    query = table(spark, [(0, [2.0, 2.0])], "query_id long, vector array<float>")
    hits = ann.lookup(knn(docs, query, 3), docs, ["title"]).orderBy("rank").collect()
    assert [(r["rank"], r["doc_id"], r["title"]) for r in hits] == [(1, 1, "north"), (2, 2, "east"), (3, 0, "far")]
    # Squared distances 8, 8 and 98: the first two tie.
    assert [r["score"] for r in hits] == pytest.approx([1 / 9, 1 / 9, 1 / 99])


@pytest.mark.parametrize(
    ("v", "clamped", "wrapped"),
    [(-1.0, -128, -128), (-0.5, -64, -64), (0.0, 0, 0), (0.5, 63, 63), (1.0, 127, 127), (1.1, 127, -116), (-1.1, -128, 115)],
)
def test_quantize_goldens(spark, v, clamped, wrapped):
    df = table(spark, [(0, [v])])
    lo, hi = F.lit(-1.0), F.lit(1.0)
    row = df.select(
        V.quantize_int8(F.col("vector"), lo, hi)[0].alias("c"),
        V.quantize_int8(F.col("vector"), lo, hi, "wrap")[0].alias("w"),
        V.quantize_int8(F.col("vector"), lo, lo)[0].alias("z"),
    ).first()
    assert (row["c"], row["w"], row["z"]) == (clamped, wrapped, 0)


def test_quantize_is_monotone(spark):
    values = sorted(np.random.default_rng(2).uniform(-3, 3, 500).tolist())
    df = table(spark, [(0, values)])
    out = df.select(V.quantize_int8(F.col("vector"), F.lit(-1.0), F.lit(2.0)).alias("q")).first()["q"]
    assert out == sorted(out) and min(out) == -128 and max(out) == 127


@pytest.mark.parametrize("overflow", ["clamp", "wrap"])
def test_batch_quantization_equals_the_expression(spark, overflow):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.uniform(-3, 3, i % 7)], lo, hi) for i, (lo, hi) in enumerate([(-1.0, 2.0), (0.5, 0.5)] * 40)]
    df = spark.createDataFrame([*rows, (99, None, 0.0, 1.0)], "doc_id long, vector array<float>, lo double, hi double")
    args = (F.col("vector"), F.col("lo"), F.col("hi"), overflow)
    both = df.select(V.quantize_int8(*args).alias("a"), V.quantize_int8_batches(*args).alias("b"))
    assert both.count() == both.filter(F.col("a").eqNullSafe(F.col("b"))).count()


def test_bounds_of_negative_and_nan_vectors(spark):
    df = table(spark, [(0, [-3.0, -1.0]), (1, [float("nan"), -2.0])])
    assert tuple(bounds.vector_bounds(df).first()) == (-3.0, -1.0)


def test_split_valid(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [1.0, nan]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, [-inf, 0.0])]
    ok, bad = V.split_valid(table(spark, rows), dim=2)
    assert [r["doc_id"] for r in ok.collect()] == [0]
    assert sorted(r["doc_id"] for r in bad.collect()) == [1, 2, 3, 4, 5, 6, 7]


def test_broadcast_and_partitioned_search_agree(spark):
    docs = random_corpus(spark)
    one = knn(docs, queries_of(docs), 5)
    many = knn(docs, queries_of(docs), 5, broadcast_bytes=4_000, chunk_bytes=3_000)
    assert collected(one) == collected(many)
    assert collected(one) == collected(knn(docs.repartition(17), queries_of(docs), 5))


def test_large_query_sets_leave_the_corpus_in_place(spark, monkeypatch):
    docs, shuffled = random_corpus(spark, 700), []
    ranked = knn_module.rank_hits
    monkeypatch.setattr(knn_module, "rank_hits", lambda hits, *a, **b: shuffled.append(hits) or ranked(hits, *a, **b))
    for owner in (False, True):
        by = docs.withColumn("doc_id", F.col("doc_id") % 90) if owner else docs
        want = collected(knn(by, queries_of(docs), 5, per_owner=owner))
        shuffled.clear()
        got = knn(by, queries_of(docs), 5, per_owner=owner, broadcast_bytes=9_000, chunk_bytes=2_000)
        assert len(shuffled) == 4 and collected(got) == want
    columns = [line for line in shuffled[0]._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert columns and not any("vector" in line for line in columns)


def test_owner_search_ways_agree(spark):
    docs = random_corpus(spark).withColumn("owner", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("doc_id") % 40))
    args = dict(id_col="owner", per_owner=True)
    one = knn(docs, queries_of(docs), 4, **args)
    many = knn(docs, queries_of(docs), 4, broadcast_bytes=4_000, chunk_bytes=3_000, **args)
    assert collected(one) == collected(many)


def test_text_ids(spark):
    docs = random_corpus(spark, 60).withColumn("doc_id", F.concat(F.lit("v"), F.col("doc_id")))
    one = knn(docs, queries_of(docs), 3)
    many = knn(docs, queries_of(docs), 3, broadcast_bytes=1_000, chunk_bytes=1_000)
    assert collected(one) == collected(many)


def test_edges(spark):
    docs = random_corpus(spark, 3)
    assert knn(docs, queries_of(docs), 10).count() == 9  # k beyond the corpus
    assert knn(docs.filter("false"), queries_of(docs), 5).count() == 0
    assert knn(docs, queries_of(docs).filter("false"), 5).count() == 0
    with pytest.raises(ValueError):
        knn(docs, queries_of(docs), 0)
    mixed = docs.unionByName(table(spark, [(9, [1.0, 2.0])]))
    with pytest.raises(PythonException, match="dimensions differ"):
        knn(mixed, queries_of(docs), 5).count()


def test_pair_distance(spark):
    df = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0])], "a array<float>, b array<float>")
    assert df.select(V.l2(F.col("a"), F.col("b"))).first()[0] == 5.0
    assert df.select(V.l2_sq_int8(F.col("a").cast("array<tinyint>"), F.col("b").cast("array<tinyint>"))).first()[0] == 25
    with pytest.raises(SparkRuntimeException, match="dimensions"):
        df.select(V.l2_sq(F.col("a"), F.slice("b", 1, 1))).collect()


def test_probing_all_cells_is_exact_and_recall_grows(spark):
    docs = random_corpus(spark, hot=False)
    exact = knn(docs, queries_of(docs), 5)
    pivots = ann.sample_pivots(docs, 8)
    index = ann.assign_cells(docs, pivots)
    found = []
    for nprobe in (1, 3, 8):
        hits = ann.ann_search(index, queries_of(docs), pivots, 5, nprobe)
        found.append(recall.recall_at_k(exact, hits, 5).first()["recall"])
    assert found == sorted(found) and found[-1] == 1.0
    assert collected(ann.ann_search(index, queries_of(docs), pivots, 5, 8)) == collected(exact)


def test_hot_cell_is_cut_into_fragments(spark):
    docs = random_corpus(spark, 600)
    pivots = ann.sample_pivots(docs, 6)
    index = ann.assign_cells(docs, pivots)
    one = ann.ann_search(index, queries_of(docs), pivots, 5, 2)
    many = ann.ann_search(index, queries_of(docs), pivots, 5, 2, broadcast_bytes=3_000, chunk_bytes=2_000)
    assert collected(one) == collected(many)


def test_hashed_cells_find_exact_hits_within_their_buckets(spark):
    docs = random_corpus(spark)
    index = ann.hashed_cells(docs, width=3.0)
    exact = {(r["query_id"], r["doc_id"]): r["dist_sq"] for r in knn(docs, queries_of(docs), 400).collect()}
    cells = {r["doc_id"]: r["cell"] for r in index.collect()}
    probes = {}
    for r in ann.hashed_cells(queries_of(docs), 4, width=3.0).collect():
        probes.setdefault(r["query_id"], set()).add(r["cell"])
    want = []
    for q, looked in probes.items():
        near = sorted((exact[q, d], d) for d, c in cells.items() if c in looked)[:5]
        want += [(q, d, i + 1) for i, (_, d) in enumerate(near)]
    hits = ann.hashed_search(index, queries_of(docs), 5, 4, width=3.0)
    cut = ann.hashed_search(index, queries_of(docs), 5, 4, width=3.0, broadcast_bytes=3_000, chunk_bytes=2_000)
    assert [r[:3] for r in collected(hits)] == sorted(want)
    assert collected(hits) == collected(cut)
    with pytest.raises(ValueError):
        ann.hashed_cells(docs, 8)


def test_stored_index_reads_only_probed_cells(spark):
    docs = random_corpus(spark)
    pivots = ann.sample_pivots(docs, 6)
    path = scratch_path(spark, "test-index")
    ann.write_index(ann.assign_cells(docs, pivots), path, files=3)
    stored = spark.read.parquet(path)
    assert stored.count() == 400
    query = queries_of(docs).filter("query_id = 1")
    hits = ann.ann_search(stored, query, pivots, 5, 1)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell", "cell")
    assert collected(hits) == collected(ann.ann_search(ann.assign_cells(docs, pivots), query, pivots, 5, 1))


def test_pivot_sample_is_repeatable(spark):
    docs = random_corpus(spark, 2000, dim=2, hot=False)
    all_sorted = docs.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary"))).limit(25)
    want = {r["doc_id"] for r in all_sorted.collect()}
    assert {r["cell"] for r in ann.sample_pivots(docs.repartition(3), 25).collect()} == want


def test_ann_edges(spark):
    docs = random_corpus(spark, 20)
    pivots = ann.sample_pivots(docs, 50)  # more than there are rows: all of them
    assert pivots.count() == 20
    index = ann.assign_cells(docs, pivots)
    none = queries_of(docs).filter("query_id < 0")
    assert ann.ann_search(index, none, pivots, 5, 2).count() == 0
    assert ann.ann_search(index.filter("doc_id < 0"), queries_of(docs), pivots, 5, 2).count() == 0
    assert ann.ann_search(index, queries_of(docs), pivots, 100, 50).count() == 400
    with pytest.raises(ValueError, match="no pivots"):
        ann.assign_cells(docs, pivots.filter("cell < 0"))


def test_too_many_pivots_raise(spark):
    docs = random_corpus(spark)
    with pytest.raises(ValueError, match="pivots"):
        ann.nearest_cells(docs, ann.sample_pivots(docs, 50), max_pivot_bytes=100)


def test_recall_counts_distinct_pairs(spark):
    truth = spark.createDataFrame([(0, 1), (0, 2), (1, 5)], "query_id long, doc_id long")
    cand = spark.createDataFrame([(0, 1), (0, 1), (0, 9)], "query_id long, doc_id long")
    assert tuple(recall.recall_at_k(truth, cand, 2).first()) == (2, 1, 0.25)
    assert recall.recall_at_k(truth, truth, 2, n_queries=3).first()["recall"] == 0.5
    per_query = {r["query_id"]: r["matched"] for r in recall.recall_per_query(truth, cand, 2).collect()}
    assert per_query == {0: 1, 1: 0}


def test_margin_of_error(spark):
    df = spark.createDataFrame([(0.2, 100), (2.0, 100)], "m double, n long")
    out = [r[0] for r in df.select(recall.margin_of_error_proportion(F.col("m"), F.col("n"))).collect()]
    assert round(out[0], 4) == 0.0784 and math.isnan(out[1])


def test_blocks_of_queries_are_searched_in_rounds(spark, monkeypatch):
    """small blocks share a job, whose hits are written once."""
    from nearfield.operators import knn as knn_module

    docs = spark.createDataFrame([(i, [float(i % 17), float(i % 5)]) for i in range(400)], "doc_id long, vector array<float>")
    queries = docs.withColumnRenamed("doc_id", "query_id")
    written = []
    staged = knn_module.staged
    monkeypatch.setattr(knn_module, "staged", lambda df, label: written.append(label) or staged(df, label))
    hits = knn_module.knn(docs, queries, 3, broadcast_bytes=200, chunk_bytes=64)
    assert len(written) == 8  # 16 blocks, two in a round
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, knn_module.knn(docs, queries, 3).collect()))


def test_wide_boxes_are_not_sent_bucket_by_bucket(spark, monkeypatch):
    """a query whose box holds most buckets is sent once, to the exact search."""
    import numpy as np

    from nearfield.operators import ann

    rows = np.random.default_rng(4).standard_normal((300, 8))
    docs = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "doc_id long, vector array<float>")
    queries = docs.withColumnRenamed("doc_id", "query_id")
    sent = {}
    staged = ann.staged

    def counted(df, label):
        out = staged(df, label)
        sent[label] = max(out.count(), sent.get(label, 0))
        return out

    monkeypatch.setattr(ann, "staged", counted)
    hits = ann.filled_search(ann.hashed_cells(docs), queries, 3, nprobe=2)
    assert sent["boxes"] <= 300 * 32
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, ann.knn(docs, queries, 3).collect()))
