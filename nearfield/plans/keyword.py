"""Registered keyword queries over whole texts of ``documents`` and two fields of ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import text as X
from nearfield.operators import keyword as K
from nearfield.operators.ann import lookup
from nearfield.operators.keyword_batch import search_batch
from nearfield.session import scratch_path, widen

N = 10


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return widen(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang"), "doc_id")


def text_index(spark: SparkSession, sf: str) -> K.TextIndex:
    return K.build_index(documents(spark, sf), ["text"])


def part_index(spark: SparkSession, sf: str) -> K.TextIndex:
    parts = widen(spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name", "p_type"), "p_partkey")
    return K.build_index(parts, ["p_name", "p_type"], id_col="p_partkey")


def _search(index: K.TextIndex, clauses: dict[str, list[K.Clause]], **options) -> DataFrame:
    hits = K.search(index, clauses, N, **options)
    return hits.withColumn("score", F.round("score", 6))


def tokens_per_document(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", F.explode(F.array(X.tokenize(F.col("text")))).alias("t"))
    joined = F.array_join("t", " ")
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(joined.cast("binary")).alias("digest"))


def term_stats(spark: SparkSession, sf: str) -> DataFrame:
    return text_index(spark, sf).terms().select("term", "doc_freq")


def postings(spark: SparkSession, sf: str) -> DataFrame:
    rows = text_index(spark, sf).postings
    return rows.select("term", "doc_id", "tf", "doc_len", F.col("positions")[0].cast("long").alias("first_pos"))


def field_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = part_index(spark, sf).stats().unionByName(text_index(spark, sf).stats())
    return stats.withColumn("avg_len", F.round("avg_len", 6))


OR_QUERIES = {"common": "The of and", "mixed": "onenerth ouument theron trash", "french": "aioupale queeuxai le"}


def keyword_or(spark: SparkSession, sf: str) -> DataFrame:
    return _search(text_index(spark, sf), {q: [K.match(t)] for q, t in OR_QUERIES.items()}, field="text")


def keyword_or_compact_norms(spark: SparkSession, sf: str) -> DataFrame:
    clauses = {q: [K.match(t)] for q, t in OR_QUERIES.items()}
    return _search(text_index(spark, sf), clauses, field="text", compact_norms=True)


def keyword_stored_index(spark: SparkSession, sf: str) -> DataFrame:
    """The same search over an index written as tables."""
    stored = K.store_index(documents(spark, sf), ["text"], scratch_path(spark, "text-index"))
    return _search(stored, {q: [K.match(t)] for q, t in OR_QUERIES.items()}, field="text")


def stored_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequencies and field totals as the stored index counts them."""
    docs = documents(spark, sf)
    stored = K.store_index(docs, ["text", "lang"], scratch_path(spark, "text-index"))
    totals = stored.stats().select("field", F.lit("").alias("term"), F.col("n_docs").alias("n"), "total_len")
    terms = stored.terms().select("field", "term", F.col("doc_freq").alias("n"), F.lit(None).cast("long").alias("total_len"))
    return terms.unionByName(totals)


def keyword_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Every text of ``benchmark`` is a query against every document."""
    queries = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    hits = search_batch(documents(spark, sf), queries, "text", N)
    return hits.withColumn("score", F.round("score", 6))


def keyword_must(spark: SparkSession, sf: str) -> DataFrame:
    clauses = [K.must(K.match("trash")), K.must(K.match("idiot")), K.match("the")]
    return _search(text_index(spark, sf), {"q": clauses}, field="text")


def keyword_must_not(spark: SparkSession, sf: str) -> DataFrame:
    clauses = [K.match("under trash"), K.must_not(K.match("idiot"))]
    return _search(text_index(spark, sf), {"q": clauses}, field="text")


PHRASES = {"two": "of the", "three": "the and attion", "twice": "the the"}


def keyword_phrase(spark: SparkSession, sf: str) -> DataFrame:
    clauses = {q: [K.phrase(t)] for q, t in PHRASES.items()}
    return _search(text_index(spark, sf), clauses, field="text")


def keyword_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return _search(text_index(spark, sf), {"q": [K.prefix("thean")]}, field="text")


def keyword_wildcard(spark: SparkSession, sf: str) -> DataFrame:
    return _search(text_index(spark, sf), {"q": [K.wildcard("w?r*ss")]}, field="text")


def keyword_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    clauses = {
        "two": [K.fuzzy("worthles", transpositions=False)],
        "one": [K.fuzzy("idiots", edits=1, boost=2.0, transpositions=False)],
    }
    return _search(text_index(spark, sf), clauses, field="text")


SWAPPED = {"one": ("idito", 1), "two": ("tehn", 2), "long": ("wrothlses", 2)}


def keyword_fuzzy_swaps(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring letters swapped count as one edit; terms are looked up by stored forms."""
    stored = K.store_index(documents(spark, sf), ["text"], scratch_path(spark, "text-index"), forms=True)
    clauses = {q: [K.fuzzy(t, edits=e)] for q, (t, e) in SWAPPED.items()}
    clauses["pattern"] = [K.wildcard("*less")]
    return _search(stored, clauses, field="text")


def keyword_range(spark: SparkSession, sf: str) -> DataFrame:
    clauses = {"closed": [K.term_range("under", "undon")], "open": [K.term_range("id", "ig", inclusive=(False, False))]}
    return _search(text_index(spark, sf), clauses, field="text")


def keyword_fields_boost(spark: SparkSession, sf: str) -> DataFrame:
    clauses = [K.match("blue bolt", field="p_name", boost=2.0), K.match("economy", field="p_type")]
    return _search(part_index(spark, sf), {"q": clauses})


def keyword_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Scored, phrase and pattern clauses in one query, across fields."""
    clauses = [
        K.must(K.prefix("sma", field="p_type")),
        K.phrase("hot gizmo", field="p_name", boost=3.0),
        K.match("ring", field="p_name"),
        K.must_not(K.term_range("blue", "cold", field="p_name")),
    ]
    return _search(part_index(spark, sf), {"q": clauses})


def keyword_group(spark: SparkSession, sf: str) -> DataFrame:
    """Groups in groups: two of three words, beside a group that asks for one and refuses another."""
    rude = K.must(K.group(K.match("trash idiot worthless"), at_least=2))
    plain = K.group(K.must(K.match("the")), K.must_not(K.group(K.match("under"), K.prefix("thean"))), boost=2.0)
    either = [K.group(K.phrase("of the"), K.must(K.match("and"))), K.group(K.must(K.match("trash")), K.match("under"))]
    return _search(text_index(spark, sf), {"q": [rude, plain], "either": either}, field="text")


def _grown(spark: SparkSession, sf: str) -> K.TextIndex:
    """An index stored with two thirds of the documents, given the others and rid of some.

    Even ids come first, and with them wrong texts of the ids that end in 5; all ids but the even
    ones are appended, replacing those, and the ids that end in 2 are deleted at last.
    """
    docs = documents(spark, sf)
    path = scratch_path(spark, "grown-index")
    wrong = docs.filter("doc_id % 10 = 5").withColumn("text", F.concat(F.lit("trash trash "), F.col("text")))
    K.store_index(docs.filter("doc_id % 2 = 0").unionByName(wrong), ["text"], path)
    K.append_index(docs.filter("doc_id % 2 = 1"), ["text"], path, replace_docs=True)
    return K.delete_documents(docs.filter("doc_id % 10 = 2").select("doc_id"), path)


def keyword_append(spark: SparkSession, sf: str) -> DataFrame:
    return _search(_grown(spark, sf), {q: [K.match(t)] for q, t in OR_QUERIES.items()}, field="text")


def appended_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequencies and totals of a grown index, as its generations add up."""
    grown = _grown(spark, sf)
    totals = grown.stats().select(F.lit("").alias("term"), F.col("n_docs").alias("n"), "total_len")
    return grown.terms().select("term", F.col("doc_freq").alias("n"), F.lit(None).cast("long").alias("total_len")).unionByName(totals)


def keyword_hits_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Hits with their stored fields, as a result list shows them."""
    parts = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("doc_id"), "p_name", "p_type")
    hits = _search(part_index(spark, sf), {"q": [K.match("anvil", field="p_name")]})
    return lookup(hits, parts, ["p_name", "p_type"]).select("rank", "doc_id", "p_name", "p_type")


QUERIES = {
    fn.__name__: fn
    for fn in (
        tokens_per_document,
        term_stats,
        postings,
        field_stats,
        keyword_or,
        keyword_or_compact_norms,
        keyword_stored_index,
        stored_lexicon,
        keyword_batch,
        keyword_must,
        keyword_must_not,
        keyword_phrase,
        keyword_prefix,
        keyword_wildcard,
        keyword_fuzzy,
        keyword_fuzzy_swaps,
        keyword_range,
        keyword_fields_boost,
        keyword_mixed,
        keyword_group,
        keyword_append,
        appended_lexicon,
        keyword_hits_lookup,
    )
}

# --- SQL counterparts ---------------------------------------------------------------------


def _tokens(text: str) -> str:
    pattern = X.token_pattern(java=False).replace("'", "''")
    raw = f"regexp_extract_all(lower(translate(coalesce({text}, ''), 'Σİ', 'σi')), '{pattern}')"
    cut = f"lambda t: list_transform(range(0, (length(t) + {X.MAX_TOKEN - 1}) // {X.MAX_TOKEN}), lambda i: substr(t, i * {X.MAX_TOKEN} + 1, {X.MAX_TOKEN}))"
    return f"flatten(list_transform({raw}, {cut}))"


def _analysed(*sources: tuple[str, str, str]) -> str:
    """CTEs for ``(field, table, id)`` sources: tok, pos, post, totals and df."""
    parts = " UNION ALL ".join(
        f"SELECT '{field}' AS field, {key} AS doc_id, {_tokens(field)} AS tokens FROM {table}" for field, table, key in sources
    )
    return f"""tok AS ({parts}), pos AS (
  SELECT field, doc_id, len(tokens) AS doc_len, generate_subscripts(tokens, 1) - 1 AS pos, unnest(tokens) AS term FROM tok
), post AS (
  SELECT field, term, doc_id, doc_len, count(*) AS tf, min(pos) AS first_pos FROM pos GROUP BY field, term, doc_id, doc_len
), totals AS (
  SELECT field, count(*) AS n_docs, sum(len(tokens)) AS total_len, sum(len(tokens))::DOUBLE / count(*) AS avg_len
  FROM tok WHERE len(tokens) > 0 GROUP BY field
), df AS (
  SELECT field, term, count(*) AS doc_freq, any_value(n_docs) AS n_docs, any_value(avg_len) AS avg_len
  FROM post JOIN totals USING (field) GROUP BY field, term
)"""


_LEFT = "(SELECT * FROM documents WHERE doc_id % 10 <> 2)"
_TEXT = f"WITH {_analysed(('text', 'documents', 'doc_id'))}"
_PART = f"WITH {_analysed(('p_name', 'part', 'p_partkey'), ('p_type', 'part', 'p_partkey'))}"
_IDF = "ln(1 + (n_docs - doc_freq + 0.5::DOUBLE) / (doc_freq + 0.5::DOUBLE))"


def _tf(freq: str, length: str = "doc_len") -> str:
    return f"({freq}) / (({freq}) + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * ({length}) / avg_len))"


def _ranked(rows: str) -> str:
    """Top n of ``(query_id, doc_id, score)`` rows."""
    return f"""SELECT query_id, doc_id, rank, round(score::FLOAT::DOUBLE, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score::FLOAT DESC, doc_id) AS rank FROM ({rows})
) WHERE rank <= {N}"""


def _values(queries: dict[str, str]) -> str:
    """Query tokens as rows, split on spaces."""
    rows = [f"('{q}', '{t}')" for q, text in queries.items() for t in text.lower().split()]
    return f"typed(query_id, term) AS (VALUES {', '.join(rows)})"


def _bm25_sum(length: str = "doc_len") -> str:
    return f"""SELECT query_id, doc_id, sum({_IDF} * {_tf('tf', length)}) AS score
FROM typed JOIN post USING (term) JOIN df USING (field, term) GROUP BY query_id, doc_id"""


_COMPACT = """CASE WHEN doc_len < 40 THEN doc_len
  ELSE 24 + (((doc_len - 24) >> (length(bin(doc_len - 24)) - 4)::INT) << (length(bin(doc_len - 24)) - 4)::INT) END"""


def _constant(queries: list[tuple[str, str, float]], source: str = _TEXT) -> str:
    rows = " UNION ALL ".join(
        f"SELECT DISTINCT '{q}' AS query_id, doc_id, {boost}::DOUBLE AS score FROM post WHERE {test}" for q, test, boost in queries
    )
    return f"{source} {_ranked(rows)}"


def _phrase(query: str, text: str, field: str, boost: float = 1.0) -> str:
    terms = text.split()
    joins = " ".join(
        f"JOIN pos p{i} ON p{i}.doc_id = p0.doc_id AND p{i}.field = p0.field AND p{i}.pos = p0.pos + {i} AND p{i}.term = '{t}'"
        for i, t in enumerate(terms)
        if i
    )
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""SELECT '{query}' AS query_id, doc_id, {boost} * idf * {_tf('freq')} AS score FROM (
  SELECT p0.doc_id, p0.field, p0.doc_len, count(*) AS freq FROM pos p0 {joins}
  WHERE p0.term = '{terms[0]}' AND p0.field = '{field}' GROUP BY ALL
) JOIN (
  SELECT sum({_IDF}) AS idf, any_value(avg_len) AS avg_len
  FROM unnest([{listed}]) AS u(term) JOIN df USING (term) WHERE field = '{field}'
) ON true"""


_MUST = """SELECT 'q' AS query_id, doc_id, sum({score}) AS score
FROM post JOIN df USING (field, term) WHERE term IN ({terms}) GROUP BY doc_id HAVING {test}"""


ORACLES = {
    "tokens_per_document": f"""WITH t AS (SELECT doc_id, {_tokens('text')} AS t FROM documents)
SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM t""",
    "term_stats": f"{_TEXT} SELECT term, doc_freq FROM df",
    "postings": f"{_TEXT} SELECT term, doc_id, tf, doc_len, first_pos FROM post",
    "field_stats": f"""WITH {_analysed(('p_name', 'part', 'p_partkey'), ('p_type', 'part', 'p_partkey'), ('text', 'documents', 'doc_id'))}
SELECT field, n_docs, total_len::BIGINT AS total_len, round(avg_len, 6) AS avg_len FROM totals""",
    "keyword_or": f"{_TEXT}, {_values(OR_QUERIES)} {_ranked(_bm25_sum())}",
    "keyword_or_compact_norms": f"{_TEXT}, {_values(OR_QUERIES)} {_ranked(_bm25_sum(_COMPACT))}",
    "keyword_stored_index": f"{_TEXT}, {_values(OR_QUERIES)} {_ranked(_bm25_sum())}",
    "stored_lexicon": f"""WITH {_analysed(('text', 'documents', 'doc_id'), ('lang', 'documents', 'doc_id'))}
SELECT field, term, doc_freq AS n, NULL::BIGINT AS total_len FROM df
UNION ALL SELECT field, '', n_docs, total_len::BIGINT FROM totals""",
    "keyword_batch": f"""{_TEXT}, typed AS (
  SELECT item_id AS query_id, unnest({_tokens('text')}) AS term FROM benchmark
) {_ranked(_bm25_sum())}""",
    "keyword_must": f"""{_TEXT} {_ranked(_MUST.format(
        score=f"{_IDF} * {_tf('tf')}", terms="'trash', 'idiot', 'the'", test="count_if(term <> 'the') = 2"))}""",
    "keyword_must_not": f"""{_TEXT} {_ranked(_MUST.format(
        score=f"CASE WHEN term = 'idiot' THEN 0 ELSE {_IDF} * {_tf('tf')} END", terms="'under', 'trash', 'idiot'",
        test="count_if(term = 'idiot') = 0"))}""",
    "keyword_phrase": f"{_TEXT} {_ranked(' UNION ALL '.join(_phrase(q, t, 'text') for q, t in PHRASES.items()))}",
    "keyword_prefix": _constant([("q", "term LIKE 'thean%'", 1.0)]),
    "keyword_wildcard": _constant([("q", "term LIKE 'w_r%ss'", 1.0)]),
    "keyword_fuzzy": _constant(
        [("two", "levenshtein(term, 'worthles') <= 2", 1.0), ("one", "levenshtein(term, 'idiots') <= 1", 2.0)]
    ),
    "keyword_fuzzy_swaps": _constant(
        [(q, f"damerau_levenshtein(term, '{t}') <= {e}", 1.0) for q, (t, e) in SWAPPED.items()]
        + [("pattern", "term LIKE '%less'", 1.0)]
    ),
    "keyword_range": _constant(
        [("closed", "term >= 'under' AND term <= 'undon'", 1.0), ("open", "term > 'id' AND term < 'ig'", 1.0)]
    ),
    "keyword_fields_boost": f"""{_PART}, typed(field, term, boost) AS (
  VALUES ('p_name', 'blue', 2), ('p_name', 'bolt', 2), ('p_type', 'economy', 1)
) {_ranked(f'''SELECT 'q' AS query_id, doc_id, sum(boost * {_IDF} * {_tf('tf')}) AS score
FROM typed JOIN post USING (field, term) JOIN df USING (field, term) GROUP BY doc_id''')}""",
    "keyword_mixed": f"""{_PART}, parts AS (
  SELECT DISTINCT 'q' AS query_id, doc_id, 1::DOUBLE AS score, 'must' AS occur FROM post
  WHERE field = 'p_type' AND term LIKE 'sma%'
  UNION ALL SELECT *, 'should' FROM ({_phrase('q', 'hot gizmo', 'p_name', 3.0)})
  UNION ALL SELECT 'q', doc_id, {_IDF} * {_tf('tf')}, 'should' FROM post JOIN df USING (field, term)
  WHERE field = 'p_name' AND term = 'ring'
  UNION ALL SELECT DISTINCT 'q', doc_id, 0::DOUBLE, 'not' FROM post
  WHERE field = 'p_name' AND term BETWEEN 'blue' AND 'cold'
) {_ranked('''SELECT query_id, doc_id, sum(score) AS score FROM parts GROUP BY query_id, doc_id
HAVING count_if(occur = 'must') = 1 AND count_if(occur = 'not') = 0''')}""",
    "keyword_group": f"""{_TEXT}, words AS (
  SELECT doc_id, term, {_IDF} * {_tf('tf')} AS s FROM post JOIN df USING (field, term) WHERE term IN ('trash', 'idiot', 'worthless', 'the', 'under', 'and')
), w AS (
  SELECT doc_id, {", ".join(f"max(s) FILTER (term = '{t}') AS {t}_" for t in ("trash", "idiot", "worthless", "the", "under", "and"))}
  FROM words GROUP BY doc_id
), pre AS (SELECT DISTINCT doc_id FROM post WHERE term LIKE 'thean%'),
ph AS ({_phrase('either', 'of the', 'text')}),
d AS (
  SELECT w.*, pre.doc_id IS NOT NULL AS pre_, ph.score AS ph_ FROM w LEFT JOIN pre USING (doc_id) LEFT JOIN ph USING (doc_id)
) {_ranked('''SELECT 'q' AS query_id, doc_id, coalesce(trash_, 0) + coalesce(idiot_, 0) + coalesce(worthless_, 0)
    + CASE WHEN the_ IS NOT NULL AND under_ IS NULL AND NOT pre_ THEN 2 * the_ ELSE 0 END AS score
  FROM d WHERE (trash_ IS NOT NULL)::INT + (idiot_ IS NOT NULL)::INT + (worthless_ IS NOT NULL)::INT >= 2
  UNION ALL SELECT 'either', doc_id, CASE WHEN and_ IS NOT NULL THEN and_ + coalesce(ph_, 0) ELSE 0 END
    + CASE WHEN trash_ IS NOT NULL THEN trash_ + coalesce(under_, 0) ELSE 0 END
  FROM d WHERE and_ IS NOT NULL OR trash_ IS NOT NULL''')}""",
    "keyword_append": f"WITH {_analysed(('text', _LEFT, 'doc_id'))}, {_values(OR_QUERIES)} {_ranked(_bm25_sum())}",
    "appended_lexicon": f"""WITH {_analysed(('text', _LEFT, 'doc_id'))}
SELECT term, doc_freq AS n, NULL::BIGINT AS total_len FROM df UNION ALL SELECT '', n_docs, total_len::BIGINT FROM totals""",
    "keyword_hits_lookup": f"""{_PART}, hits AS ({_ranked(f'''SELECT 'q' AS query_id, doc_id, {_IDF} * {_tf('tf')} AS score
FROM post JOIN df USING (field, term) WHERE field = 'p_name' AND term = 'anvil' ''')})
SELECT rank, doc_id, p_name, p_type FROM hits JOIN part ON p_partkey = doc_id""",
}
