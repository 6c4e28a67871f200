"""Indexes of many pivots, indexes that grow, and searches that go on until they have k hits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import ann, pivot_tree
from nearfield.operators import keyword as K
from nearfield.operators.knn import knn
from nearfield.session import scratch_path
from nearfield.sources import cell_index, generations
from nearfield.streaming import ingest


def table(spark, x, first=0, parts=4):
    rows = [(first + i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "doc_id long, vector array<float>").repartition(parts)


def queries_of(docs):
    return docs.select(F.col("doc_id").alias("query_id"), "vector")


def collected(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    x = np.random.default_rng(4).standard_normal((300, 6)).astype(np.float32)
    x[::3] = x[0]
    return table(spark, x).cache()


def distances(a, b):
    return ((np.asarray(a, float)[:, None] - np.asarray(b, float)[None]) ** 2).sum(axis=2)


def test_leaves_are_the_nearest_under_the_nearest_root(spark, docs):
    tree = pivot_tree.build_tree(pivot_tree.hash_pivots(docs, 60), 7)
    roots, leaves = tree.roots.collect(), tree.leaves.collect()
    by_root = distances([x["vector"] for x in leaves], [r["vector"] for r in roots]).argmin(axis=1)
    assert [x["root"] for x in leaves] == [roots[i]["root"] for i in by_root]
    for r in pivot_tree.assign_leaves(docs, tree, group_bytes=400).collect():
        root = roots[distances([r["vector"]], [x["vector"] for x in roots]).argmin()]["root"]
        own = sorted((x for x in leaves if x["root"] == root), key=lambda x: x["cell"])
        assert (r["root"], r["cell"]) == (root, own[distances([r["vector"]], [x["vector"] for x in own]).argmin()]["cell"])


def test_elements_that_are_never_null(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vector"))
    tree = pivot_tree.build_tree(pivot_tree.hash_pivots(docs, 40), 4)
    assert collected(pivot_tree.assign_leaves(docs, tree).select("doc_id", "cell")) == [(i, i) for i in range(40)]


def test_crowded_roots_are_split_and_equal_leaves_are_one(spark, docs):
    pivots = docs.select(F.col("doc_id").alias("cell"), "vector")
    tree = pivot_tree.build_tree(pivots, 2, max_leaves=20)
    assert tree.leaves.count() == 201  # a hundred equal ones are one
    assert tree.leaves.groupBy("root").count().agg(F.max("count")).first()[0] <= 20
    with pytest.raises(ValueError, match="no pivots"):
        pivot_tree.build_tree(pivots.filter("cell < 0"))


def test_probing_the_whole_tree_is_exact_and_prunes_by_root(spark, docs, tmp_path):
    tree = pivot_tree.build_tree(pivot_tree.hash_pivots(docs, 80), 9).write(str(tmp_path / "tree"))
    path = str(tmp_path / "index")
    pivot_tree.write_tree_index(pivot_tree.assign_leaves(docs, tree), path, file_bytes=2_000)
    stored = spark.read.parquet(path)
    assert stored.count() == 300
    asked = queries_of(docs.filter("doc_id < 40"))
    assert collected(pivot_tree.tree_search(stored, asked, tree, 5, 9, 80)) == collected(knn(docs, asked, 5))
    hits = pivot_tree.tree_search(stored, asked.filter("query_id = 1"), tree, 5, 1, 2)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    filters = [line.split("PartitionFilters: [")[1].split("]")[0] for line in plan.splitlines() if "PartitionFilters: [" in line]
    assert any("root#" in f for f in filters)


def test_trained_pivots_equal_means_in_memory(spark, docs):
    rows = sorted(docs.collect())
    x, start = np.array([r["vector"] for r in rows], np.float32), ann.sample_pivots(docs, 6)
    far = spark.createDataFrame([(999, [1e3] * 6)], start.schema)
    cells = sorted(start.unionByName(far).collect())
    centres = np.array([c["vector"] for c in cells], np.float32)
    for _ in range(4):
        near = distances(x, centres).argmin(axis=1)
        for c in set(near.tolist()):
            centres[c] = x[near == c].astype(float).mean(axis=0).astype(np.float32)
    got = sorted(ann.train_pivots(docs.repartition(7), start.unionByName(far), 4).collect())
    assert [g["cell"] for g in got] == [c["cell"] for c in cells]
    assert np.allclose([g["vector"] for g in got], centres, rtol=1e-6)  # the far one stays where it is


@pytest.mark.parametrize("limit", [64 << 20, 100])
def test_filled_search_is_exact(spark, docs, monkeypatch, limit):
    monkeypatch.setattr(ann, "_LISTED", 50)
    index = ann.hashed_cells(docs, width=0.7)
    asked = queries_of(docs.filter("doc_id < 25"))
    options = {"width": 0.7, "broadcast_bytes": limit, "chunk_bytes": 4_000}
    got = ann.filled_search(index, asked, 5, 1, **options)
    assert collected(got) == collected(knn(docs, asked, 5))
    few = ann.filled_search(index, asked, 5, 1, reach=0.1, **options)
    assert few.groupBy("query_id").count().filter("count = 5").count() == 25


def test_filled_search_of_small_indexes(spark, docs):
    few = docs.filter("doc_id < 3")
    asked = queries_of(docs.filter("doc_id < 10"))
    assert collected(ann.filled_search(ann.hashed_cells(few), asked, 5, 1)) == collected(knn(few, asked, 5))
    assert ann.filled_search(ann.hashed_cells(few.filter("doc_id < 0")), asked, 5, 1).count() == 0
    assert ann.filled_search(ann.hashed_cells(few), asked.filter("query_id < 0"), 5, 1).count() == 0


def files_of(path):
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_cell_index_shows_complete_generations_only(spark, docs, tmp_path):
    path, assigned = str(tmp_path), ann.assign_cells(docs, ann.sample_pivots(docs, 6))
    cell_index.write_generation(assigned.filter("doc_id < 100"), path, 0, file_bytes=500)
    before = files_of(tmp_path)
    # Rows without an entry: a batch that broke off.
    assigned.filter("doc_id >= 250").withColumn("generation", F.lit(1)).write.mode("append").partitionBy("cell", "generation").parquet(f"{path}/rows")
    assert cell_index.read_index(spark, path).count() == 100
    for _ in range(2):
        cell_index.write_generation(assigned.filter("doc_id >= 100"), path, 1, lambda: 3, file_bytes=500)
    assert collected(cell_index.read_index(spark, path).select("doc_id", "cell")) == collected(assigned.select("doc_id", "cell"))
    assert before.items() <= files_of(tmp_path).items()
    assert cell_index.compact(spark, path, 4_000) == -1 and cell_index.compact(spark, path) is None
    cell_index.write_generation(assigned.filter("doc_id = 7"), path, 1)  # a replay of what is folded shows nothing
    assert collected(cell_index.read_index(spark, path).select("doc_id", "cell")) == collected(assigned.select("doc_id", "cell"))
    assert [tuple(r)[1:3] for r in generations.counting(spark, path).collect()] == [(300, 3)]
    assert cell_index.vacuum(spark, path) > 0
    assert cell_index.read_index(spark, path).count() == 300


def test_stream_into_cells_checks_the_dimension(spark, docs, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    odd = spark.createDataFrame([(900, [1.0]), (901, None), (902, [float("nan")] * 6)], docs.schema)
    docs.unionByName(odd).coalesce(3).write.parquet(folder)
    pivots = ann.sample_pivots(docs, 6)
    source = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    ingest.stream_ingest(source, f"{out}/t", f"{out}/b", f"{out}/log", -1.0, 1.0, pivots).awaitTermination()
    stored = cell_index.read_index(spark, f"{out}/t")
    assert collected(stored.select("doc_id", "cell")) == collected(ann.assign_cells(docs, pivots).select("doc_id", "cell"))
    seen = ingest.observed_bounds(spark, f"{out}/b", -1.0, 1.0).first()
    assert (seen["n_rows"], seen["n_rejected"]) == (300, 3)


WORDS = ["red", "blue", "green", "red blue", "blue red red", "green green blue", "red green", "old words", "blue", ""]


def texts(spark, ids, shift=0):
    return spark.createDataFrame([(i, WORDS[(i + shift) % len(WORDS)]) for i in ids], "doc_id long, text string")


def state(index):
    """Everything a search can see of an index."""
    found = K.search(index, {q: [K.match(q)] for q in WORDS[:-1]}, 50, field="text")
    return collected(found), collected(index.terms()), collected(index.stats())


def test_text_index_grows_like_one_built_at_once(spark, tmp_path):
    path = str(tmp_path / "index")
    K.store_index(texts(spark, range(20)), ["text"], path, files=2)
    before = files_of(tmp_path)
    grown = K.append_index(texts(spark, range(20, 37)), ["text"], path, files=2)
    fresh = lambda docs: K.store_index(docs, ["text"], scratch_path(spark, "fresh"), files=2)
    assert state(grown) == state(fresh(texts(spark, range(37))))
    assert before.items() <= files_of(tmp_path).items()
    grown = K.append_index(texts(spark, range(5, 15), shift=3), ["text"], path, files=2, replace_docs=True)
    changed = texts(spark, [i for i in range(37) if not 5 <= i < 15]).unionByName(texts(spark, range(5, 15), shift=3))
    assert state(grown) == state(fresh(changed))
    grown = K.delete_documents(spark.createDataFrame([(0,), (1,), (12,), (12,), (400,)], "doc_id long"), path)
    left = changed.filter(~F.col("doc_id").isin(0, 1, 12))
    assert state(grown) == state(fresh(left))
    # A deleted id that comes back counts again.
    back = K.append_index(texts(spark, [12]), ["text"], path, files=1)
    assert state(back) == state(fresh(left.unionByName(texts(spark, [12]))))
    want = state(back)
    assert state(K.compact_index(spark, path, files=2)) == want and len(generations.live(spark, path)) == 1
    assert generations.vacuum(spark, path, "postings", "lexicon", "deleted") > 0
    assert state(K.TextIndex.load(spark, path)) == want
    assert state(K.store_index(texts(spark, range(9)), ["text"], path, files=1)) == state(fresh(texts(spark, range(9))))


def test_postings_without_an_entry_are_not_read(spark, tmp_path):
    path = str(tmp_path / "index")
    stored = K.store_index(texts(spark, range(9)), ["text"], path, files=1)
    want = state(stored)
    K.build_index(texts(spark, range(50, 60)), ["text"]).postings.write.parquet(f"{path}/postings/generation=1")
    assert state(K.TextIndex.load(spark, path)) == want


def test_groups_equal_their_meaning(spark):
    docs = texts(spark, range(10))
    index = K.build_index(docs, ["text"])
    has = {i: set(WORDS[i].split()) for i in range(10)}
    red, blue, green = (K.match(w) for w in ("red", "blue", "green"))
    cases = [
        (K.group(K.match("red blue green"), at_least=2), lambda w: len(w & {"red", "blue", "green"}) >= 2),
        (K.must(K.group(red, green)), lambda w: bool(w & {"red", "green"})),
        (K.group(K.must(blue), K.must_not(K.group(K.must(red), K.must(blue)))), lambda w: "blue" in w and "red" not in w),
        (K.group(K.must(K.group(red, K.group(K.must(green), K.must(blue)))), K.must_not(K.prefix("old"))), lambda w: "red" in w or {"green", "blue"} <= w),
        (K.group(K.must_not(red)), lambda w: False),
        (K.group(red, at_least=0), lambda w: "red" in w),
    ]
    queries = {str(i): [c] for i, (c, _) in enumerate(cases)}
    got = K.search(index, queries, 50, field="text").collect()
    for i, (_, meant) in enumerate(cases):
        assert {r["doc_id"] for r in got if r["query_id"] == str(i)} == {d for d, w in has.items() if meant(w)}
    single = {r["doc_id"]: r["score"] for r in K.search(index, {"q": [red]}, 50, field="text").collect()}
    twice = {r["doc_id"]: r["score"] for r in K.search(index, {"q": [K.group(K.group(red, boost=2.0))]}, 50, field="text").collect()}
    assert twice.keys() == single.keys() and all(np.isclose(twice[d], 2 * s) for d, s in single.items())
    with pytest.raises(ValueError, match="clauses"):
        K.group()


TERMS = [a + b + c for a in ("w", "wo", "ow", "") for b in ("rth", "rht", "rthl", "rtlhess", "rthlessness", "a") for c in ("", "s", "les", "less")]
CLAUSES = [
    *(K.fuzzy(t, edits=e, transpositions=x) for t in ("worthles", "rth", "w", "orwthless", "rthlessnesslse") for e in (0, 1, 2) for x in (True, False)),
    *(K.wildcard(p) for p in ("w*", "*less", "*rth*", "w?r*ss", "?rth", "??", "*", "w*l*s", "*t?l*n*", "a", "zz*", "*?s")),
]


@pytest.mark.parametrize("literals", [5_000, 0])
def test_terms_looked_up_by_form_equal_a_scan(spark, monkeypatch, literals):
    monkeypatch.setattr(K, "_EXPANSIONS", literals)
    docs = spark.createDataFrame(list(enumerate(sorted({t for t in TERMS if t}))), "doc_id long, text string")
    lazy = K.build_index(docs, ["text"])
    path = scratch_path(spark, "forms")
    K.store_index(docs.filter("doc_id % 2 = 0"), ["text"], path, files=2, forms=True)
    stored = K.append_index(docs.filter("doc_id % 2 = 1"), ["text"], path, files=2)
    assert stored.forms is not None
    queries = {str(i): [c] for i, c in enumerate(CLAUSES)}
    got = collected(K.search(stored, queries, 200, field="text"))
    assert got == collected(K.search(lazy, queries, 200, field="text")) and len(got) > 200
    assert K.append_index(docs.limit(0), ["text"], path, files=1).forms is not None


def test_lookups_prune_the_forms(spark):
    docs = spark.createDataFrame([(1, "worthless words")], "doc_id long, text string")
    stored = K.store_index(docs, ["text"], scratch_path(spark, "forms"), files=1, forms=True)
    for clause, pushed in ((K.fuzzy("worth"), "In(form, "), (K.wildcard("w*less"), "StringStartsWith(form,less")):
        plan = stored.forms.filter(K._form_test(clause))._jdf.queryExecution().executedPlan().toString()
        assert pushed in plan
