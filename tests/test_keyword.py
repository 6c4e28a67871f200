import itertools
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from nearfield.functions import text as X
from nearfield.operators import keyword as K
from nearfield.operators.keyword_batch import search_batch
from nearfield.session import scratch_path
from nearfield.sources.documents import text_rows

DEMO = [
    ("River stones", "ab17"),
    ("Grey river at dawn", "cd18"),
    ("Counting birds", "cd19"),
    ("The long walk of winter", "ef19"),
    ("Winter birds", "gh20"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return text_rows(spark, DEMO)


@pytest.fixture(scope="module")
def index(docs):
    return K.build_index(docs, ["title", "isbn"])


def ids(index, *clauses, **options):
    return [r["doc_id"] for r in K.search(index, {"q": list(clauses)}, **options).orderBy("rank").collect()]


def test_demo(index, docs):
    hits = K.search(index, {"q": [K.match("river")]}).join(docs, "doc_id").orderBy("rank").collect()
    assert [r["isbn"] for r in hits] == ["ab17", "cd18"]
    # Five titles of three words on average, two of which, of two and four words, hold the word.
    idf = math.log(1 + (5 - 2 + 0.5) / (2 + 0.5))
    want = [idf / (1 + 1.2 * (0.25 + 0.75 * n / 3)) for n in (2, 4)]
    assert [r["score"] for r in hits] == pytest.approx(want, rel=1e-6)


def test_clauses(index):
    assert ids(index, K.match("walk river")) == [3, 0, 1]
    assert ids(index, K.must(K.match("river")), K.must_not(K.match("dawn"))) == [0]
    assert ids(index, K.must(K.match("river")), K.must(K.match("birds"))) == []
    assert ids(index, K.must_not(K.match("river")), K.match("absent")) == []
    assert ids(index, K.phrase("Long walk")) == [3]
    assert ids(index, K.phrase("walk long")) == []
    assert ids(index, K.prefix("COUNT")) == [2]
    assert ids(index, K.wildcard("*i?er")) == [0, 1]
    assert ids(index, K.fuzzy("rives", edits=1)) == [0, 1]
    assert ids(index, K.term_range("a", "b")) == [1]
    assert ids(index, K.term_range("at", "birds", inclusive=(False, False))) == []
    assert ids(index, K.prefix("cd", field="isbn")) == [1, 2]
    assert ids(index, K.match("river"), K.match("ef19", field="isbn", boost=50.0), n=1) == [3]


def test_tiny_scores_keep_their_order(spark):
    """Words that all documents hold: weights far under any fixed number of decimals."""
    rows = [(i, "all " * (1 + i)) for i in range(4)]
    index = K.build_index(spark.createDataFrame(rows, "doc_id long, text string"), ["text"])
    scored = K.search(index, {"q": [K.match("all", boost=1e-12)]}, field="text").orderBy("rank").collect()
    assert [r["doc_id"] for r in scored] == [3, 2, 1, 0] and 0 < scored[0]["score"] < 1e-11


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_fuzzy_equals_damerau_distance(spark, edits):
    """All words over three letters, around words with and without repeated letters."""
    words = ["".join(w) for n in range(1, 6) for w in itertools.product("abc", repeat=n)]
    df = spark.createDataFrame([(w,) for w in words], "term string")
    con = duckdb.connect()
    for text in ("abc", "aabc", "cab", "ab", "abcab", "a"):
        test = K._term_test(K.fuzzy(text, edits=edits))
        got = {r["term"] for r in df.filter(test).collect()}
        sql = f"SELECT w FROM unnest(?) AS t(w) WHERE damerau_levenshtein(w, '{text}') <= {edits}"
        assert got == {r[0] for r in con.execute(sql, [words]).fetchall()}, text


def test_patterns_with_many_terms_fall_back(spark, monkeypatch):
    docs = corpus(spark)
    stored = K.store_index(docs, ["text"], scratch_path(spark, "test-patterns"), files=2)
    clauses = {"q": [K.wildcard("*e*")], "f": [K.fuzzy("rod", edits=1)]}
    few = sorted(map(tuple, K.search(stored, clauses, field="text").collect()))
    monkeypatch.setattr(K, "_EXPANSIONS", 1)
    assert sorted(map(tuple, K.search(stored, clauses, field="text").collect())) == few


def test_wildcard_metacharacters_are_literal(spark):
    index = K.build_index(spark.createDataFrame([(0, "a_b axb 100")], "doc_id long, title string"), ["title"])
    assert ids(index, K.wildcard("a_b")) == [0]
    assert ids(index, K.wildcard("1%")) == []


def test_batch_of_queries(index):
    got = K.search(index, {"a": [K.match("river")], "b": [K.prefix("count")]}).select("query_id", "doc_id").collect()
    assert sorted(map(tuple, got)) == [("a", 0), ("a", 1), ("b", 2)]


def test_repeated_word_counts_twice(index):
    one = K.search(index, {0: [K.match("river")]}).first()["score"]
    two = K.search(index, {0: [K.match("river river")]}).first()["score"]
    assert two == pytest.approx(2 * one, abs=1e-8)


def test_bad_clauses_raise(index):
    with pytest.raises(ValueError):
        K.search(index, {"q": [K.must(K.match("two words"))]})
    with pytest.raises(ValueError):
        K.fuzzy("x", edits=3)
    with pytest.raises(ValueError):
        K.search(index, {})


TRICKY = [
    "Don't stop: U.S.A. 3.14 foo_bar __x __ a:b x1,2 1,234.5 a..b x-y",
    "漢字かなカタカナー été สวัสดี ครับ 한국어 Ünïcödé İstanbul ΣΟΦΟΣ",
    "z" * 600 + " " + "y" * 256 + "9 " + "a.b" * 400,
    "",
    "😀 c++ C# e-mail me@example.com http://a.b/c?d=1 2024-01-01T00:00:00Z",
    "été co­operate ' '' .. _ 'quoted' l’été",
]


def test_tokens_equal_the_re2_form(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "i int, t string")
    got = {r["i"]: r["x"] for r in rows.select("i", X.tokenize(F.col("t")).alias("x")).collect()}
    con = duckdb.connect()
    pattern = X.token_pattern(java=False).replace("'", "''")
    for i, text in enumerate(TRICKY):
        want = con.execute(f"SELECT regexp_extract_all(lower(translate(?, 'Σİ', 'σi')), '{pattern}')", [text]).fetchall()[0][0]
        pieces = [t[at : at + X.MAX_TOKEN] for t in want for at in range(0, len(t), X.MAX_TOKEN)]
        assert got[i] == pieces, text[:60]


def test_known_tokens(spark):
    df = spark.createDataFrame([(TRICKY[0],)], "t string")
    assert df.select(X.tokenize(F.col("t"))).first()[0] == [
        "don't", "stop", "u.s.a", "3.14", "foo_bar", "__x", "a:b", "x1,2", "1,234.5", "a", "b", "x", "y",
    ]
    assert spark.sql("SELECT CAST(NULL AS STRING) t").select(X.tokenize(F.col("t"))).first()[0] == []


def test_very_long_token_does_not_overflow(spark):
    df = spark.createDataFrame([("a.b_1," * 100_000,)], "t string")
    assert df.select(F.size(X.tokenize(F.col("t")))).first()[0] > 100


def test_compact_length(spark):
    got = [r[0] for r in spark.range(0, 3000).select(X.compact_length(F.col("id"))).collect()]
    assert got[:41] == list(range(41)) and got[41:44] == [40, 42, 42]
    assert got == sorted(got) and all(g <= i < g * 1.13 + 1 for i, g in enumerate(got))


def corpus(spark):
    """A third of the documents are copies, and one word is in every document."""
    words = ["red", "green", "blue", "old", "new", "ring", "bolt"]
    rows = []
    for i in range(90):
        text = "common red ring" if i % 3 == 0 else "common " + " ".join(words[(i * j) % 7] for j in range(1, 2 + i % 9))
        rows.append((i, text))
    return spark.createDataFrame([*rows, (90, ""), (91, None)], "doc_id long, text string").repartition(4)


def test_batch_search_equals_clause_search(spark):
    docs = corpus(spark)
    texts = [(0, "common"), (1, "red red ring"), (2, "Old NEW bolt absent"), (3, "absent"), (4, "")]
    queries = spark.createDataFrame(texts, "query_id long, text string")
    want = K.search(K.build_index(docs, ["text"]), {i: [K.match(t)] for i, t in texts}, 7, field="text")
    want = sorted(tuple(r) for r in want.collect())
    sent = search_batch(docs, queries, "text", 7)
    cut = search_batch(docs, queries, "text", 7, broadcast_bytes=200, chunk_bytes=1_500)
    for got in (sent, cut):
        rows = sorted(tuple(r) for r in got.collect())
        assert [r[:3] for r in rows] == [r[:3] for r in want]
        assert [r[3] for r in rows] == pytest.approx([r[3] for r in want], abs=2e-9)


def test_batch_search_of_nothing(spark):
    docs = corpus(spark)
    queries = docs.select(F.col("doc_id").alias("query_id"), "text")
    assert search_batch(docs.filter("doc_id < 0"), queries, "text").count() == 0
    assert search_batch(docs, queries.filter("query_id < 0"), "text").count() == 0
    assert K.search(K.build_index(docs.filter("doc_id < 0"), ["text"]), {"q": [K.match("red")]}, field="text").count() == 0


def test_stored_index_equals_lazy_index(spark):
    docs = corpus(spark)
    lazy = K.build_index(docs, ["text"])
    stored = K.store_index(docs, ["text"], scratch_path(spark, "test-text"), files=3)
    order = ["field", "term", "doc_id"]
    assert stored.postings.orderBy(order).collect() == lazy.postings.orderBy(order).collect()
    assert stored.lexicon.orderBy("field", "term").collect() == lazy.lexicon.orderBy("field", "term").collect()
    clauses = {"q": [K.match("red"), K.phrase("common red"), K.prefix("bo")]}
    assert K.search(stored, clauses, field="text").collect() == K.search(lazy, clauses, field="text").collect()
    plan = stored.postings.filter("field = 'text' AND term = 'red'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,red)" in plan


def test_parts_are_analysed_by_all_slots(spark, tmp_path):
    """F16: a table in one file of one row group is spread before its texts are analysed."""
    from nearfield.plans import keyword as plan

    spark.createDataFrame([(i, "blue bolt", "ECONOMY") for i in range(50)], "p_partkey long, p_name string, p_type string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert plan.part_index(spark, str(tmp_path)).rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_texts_are_analysed_once_for_words_and_patterns(spark, monkeypatch):
    """a query with both kinds of clauses reads the documents once for its postings."""
    docs = spark.createDataFrame([(1, "under the trash"), (2, "the thean cat"), (3, "under cat")], "doc_id long, text string")
    index = K.build_index(docs, ["text"])
    passes = []
    matching = K.TextIndex.matching
    monkeypatch.setattr(K.TextIndex, "matching", lambda self, test: passes.append(1) or matching(self, test))
    clauses = [K.match("the under"), K.must_not(K.prefix("thean"))]
    hits = K.search(index, {"q": clauses}, 5, field="text")
    assert sorted(r["doc_id"] for r in hits.collect()) == [1, 3]
    assert len(passes) == 1
