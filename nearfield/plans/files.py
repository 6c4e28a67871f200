"""Registered file queries: tables written in every supported format and read back whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.operators import recall
from nearfield.operators.knn import knn
from nearfield.plans.vectors import _FLOATS, K, corpus, exact_hits
from nearfield.plans.vectors import _exact as _exact_sql
from nearfield.session import scratch_path
from nearfield.sources import delimited, documents, tables, vector_files

FIRST = 100  # row cap, a feature of its own
RANGE = (100, 300)


def _checksums(df: DataFrame) -> DataFrame:
    """``(vec_id, dim, total)``: enough to tell whether every element came back."""
    total = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return df.select("vec_id", F.size("vector").cast("long").alias("dim"), F.round(total, 6).alias("total"))


def fvecs_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "fvecs")
    vector_files.write_vecs(corpus(spark, sf), path, "doc_id", "vector", "fvecs")
    return _checksums(vector_files.read_fvecs(spark, path).withColumnRenamed("ordinal", "vec_id"))


def ivecs_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of the labels' vector ids, of any length and with a repeat, as ivecs."""
    docs = corpus(spark, sf).withColumn("bucket", F.floor(F.col("doc_id") / (F.col("label") + 2)).cast("long"))
    lists = docs.groupBy("bucket").agg(F.sort_array(F.collect_list(F.col("doc_id").cast("int"))).alias("ids"))
    lists = lists.select("bucket", F.concat("ids", F.slice("ids", 1, 1)).alias("ids"))
    path = scratch_path(spark, "ivecs")
    vector_files.write_vecs(lists, path, "bucket", "ids", "ivecs")
    back = vector_files.read_ivecs(spark, path, layout="variable")
    return back.select("query_ordinal", F.array_join(F.sort_array("neighbors"), ",").alias("ids"))


def tsv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "tsv2")
    titled = corpus(spark, sf).select(F.concat(F.lit("vec\t"), F.col("doc_id")).alias("title"), "vector")
    delimited.export_tsv(titled, path)
    back = delimited.read_pairs(spark.read.text(path))
    return _checksums(back.withColumn("vec_id", F.substring_index("title", " ", -1).cast("long")))


def _write_triples(spark: SparkSession, sf: str, path: str) -> None:
    """Three-column lines; labels 7, 8 and 9 get a missing, a trailing empty and an extra column."""
    line = F.concat_ws("\t", F.col("doc_id"), F.col("label"), V.format_floats(F.col("vector")))
    short = F.concat_ws("\t", F.col("doc_id"), V.format_floats(F.col("vector")))
    value = F.when(F.col("label") == 7, short).when(F.col("label") == 8, F.concat(line, F.lit("\t")))
    value = value.when(F.col("label") == 9, F.concat(line, F.lit("\tx"))).otherwise(line)
    corpus(spark, sf).select(value.alias("value")).write.text(path)


def tsv_triples(spark: SparkSession, sf: str) -> DataFrame:
    """Lenient reading keeps every line; a missing third column is a null vector."""
    path = scratch_path(spark, "tsv3")
    _write_triples(spark, sf, path)
    back = delimited.read_triples(spark.read.text(path))
    return back.select(F.col("unique_id").cast("long").alias("vec_id"), F.col("vector").isNotNull().alias("has_vector"))


def tsv_strict(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "tsv3")
    _write_triples(spark, sf, path)
    back = delimited.read_triples(spark.read.text(path), strict=True)
    return _checksums(back.withColumn("vec_id", F.col("unique_id").cast("long")))


def numbered_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line numbers follow the order of files and lines, here that of the vector ids."""
    path = scratch_path(spark, "lines")
    ordered = corpus(spark, sf).repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id")
    delimited.export_tsv(ordered, path, title_col="doc_id")
    back = delimited.read_pairs(delimited.numbered_lines(spark, path))
    return back.select("ordinal", F.col("title").cast("long").alias("vec_id"))


def columnar_json_zip(spark: SparkSession, sf: str) -> DataFrame:
    """Files of parallel lists, each of a hundred rows, with one title too many."""
    path = scratch_path(spark, "columnar")
    docs = corpus(spark, sf).withColumn("file_no", F.floor(F.col("doc_id") / 100))
    rows = F.sort_array(F.collect_list(F.struct("doc_id", "vector")))
    lists = docs.groupBy("file_no").agg(rows.alias("rows")).select(
        F.to_json(
            F.struct(
                F.array_append(F.transform("rows", lambda r: r["doc_id"].cast("string")), F.lit("extra")).alias("title"),
                F.transform("rows", lambda r: r["vector"]).alias("emb"),
            )
        ).alias("value")
    )
    lists.write.option("maxRecordsPerFile", 1).text(path)
    back = documents.read_columnar_json(spark, path)
    return _checksums(back.withColumn("vec_id", F.col("title").cast("long")))


def query_json(spark: SparkSession, sf: str) -> DataFrame:
    """The mean vector of the corpus, written as a query file, then searched for."""
    docs = corpus(spark, sf)
    mean = docs.select(F.posexplode("vector").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("x"))
    one = mean.agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"))  # one value per dimension
    path = scratch_path(spark, "query")
    one.select(F.transform("v", lambda e: e["x"]).alias("emb")).coalesce(1).write.json(path)
    hits = knn(docs, documents.read_query_json(spark, path), K)
    return hits.select("query_id", "doc_id", "rank", F.round("dist_sq", 6).alias("dist_sq"))


def dataset_split(spark: SparkSession, sf: str) -> DataFrame:
    """A dataset folder by subset and split; only the asked-for folder is read."""
    path = scratch_path(spark, "dataset")
    docs = corpus(spark, sf).select(
        F.col("doc_id").cast("string").alias("title"),
        F.col("vector").alias("emb"),
        F.when(F.col("label") < 5, "en").otherwise("fr").alias("subset"),
        F.when(F.col("label") == 0, "test").otherwise("train").alias("split"),
    )
    docs.write.partitionBy("subset", "split").parquet(path)
    back = documents.read_dataset(spark, path, split="train", subset="en")
    return _checksums(back.withColumn("vec_id", F.col("title").cast("long")))


def float_parsing(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers in text as floats, by way of double and directly."""
    text = F.concat_ws(",", F.transform("vector", lambda x: x.cast("double").cast("string")))
    docs = corpus(spark, sf).select(F.col("doc_id").alias("vec_id"), "vector", text.alias("t"))
    both = docs.select(
        "vec_id", "vector", V.parse_floats(F.col("t")).alias("a"), V.parse_floats(F.col("t"), via_double=False).alias("b")
    )
    return both.select(
        "vec_id", (F.col("a") == F.col("vector")).alias("via_double"), (F.col("b") == F.col("vector")).alias("direct")
    )


def append_table(spark: SparkSession, sf: str) -> DataFrame:
    """Documents appended in two writes; the table is their union, with the default title."""
    path = scratch_path(spark, "append")
    docs = tables.with_title(corpus(spark, sf))
    tables.append_vectors(docs.filter(F.col("label") < 5), path)
    tables.append_vectors(docs.filter(F.col("label") >= 5), path)
    return spark.read.parquet(path).groupBy("title", "label").agg(F.count("*").alias("n"))


def compact_table(spark: SparkSession, sf: str) -> DataFrame:
    """Many small files rewritten as few; content and row count stay."""
    source, target = scratch_path(spark, "many"), scratch_path(spark, "few")
    corpus(spark, sf).repartition(16, "doc_id").write.parquet(source)
    tables.compact_table(spark, source, target, "doc_id", file_bytes=256 << 10)
    return _checksums(spark.read.parquet(target).withColumnRenamed("doc_id", "vec_id"))


def multi_vector_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors cut in two as documents with two vectors, exploded and searched by nearest child."""
    v = F.col("vector")
    docs = corpus(spark, sf).select("doc_id", F.array(F.slice(v, 1, 32), F.slice(v, 33, 32)).alias("vectors"))
    children = tables.explode_vectors(docs)
    queries = children.select((F.col("doc_id") * 2 + F.col("vec_no")).alias("query_id"), "vector")
    hits = knn(children, queries, K, per_owner=True)
    asked = (F.floor(F.col("query_id") / 2).alias("query_doc"), (F.col("query_id") % 2).alias("query_vec"))
    return hits.select(*asked, "doc_id", "rank", F.round("dist_sq", 6).alias("dist_sq"))


def first_n_rows(spark: SparkSession, sf: str) -> DataFrame:
    return tables.first_rows(corpus(spark, sf), FIRST, "doc_id").select(F.col("doc_id").alias("vec_id"), "label")


def row_range(spark: SparkSession, sf: str) -> DataFrame:
    ranged = tables.row_range(corpus(spark, sf), *RANGE, ordinal_col="doc_id")
    return ranged.select(F.col("doc_id").alias("vec_id"), "label")


def fvecs_row_range(spark: SparkSession, sf: str) -> DataFrame:
    """A record range of vector files; bytes outside of it are not read."""
    path = scratch_path(spark, "fvecs-range")
    vector_files.write_vecs(corpus(spark, sf), path, "doc_id", "vector", "fvecs")
    back = vector_files.read_fvecs(spark, path, start=RANGE[0], stop=RANGE[1])
    return _checksums(back.withColumnRenamed("ordinal", "vec_id"))


def exact_truth_file(spark: SparkSession, sf: str) -> DataFrame:
    """Ground truth of the corpus as an ivecs file, read back as pairs."""
    path = scratch_path(spark, "truth")
    lists = recall.ids_per_query(exact_hits(corpus(spark, sf)))
    vector_files.write_vecs(lists, path, "query_id", "doc_ids", "ivecs")
    return vector_files.truth_pairs(vector_files.read_ivecs(spark, path))


QUERIES = {
    fn.__name__: fn
    for fn in (
        fvecs_roundtrip,
        ivecs_roundtrip,
        tsv_roundtrip,
        tsv_triples,
        tsv_strict,
        numbered_lines,
        columnar_json_zip,
        query_json,
        dataset_split,
        float_parsing,
        append_table,
        compact_table,
        multi_vector_rows,
        first_n_rows,
        row_range,
        fvecs_row_range,
        exact_truth_file,
    )
}

# --- SQL counterparts ---------------------------------------------------------------------

_SUMS = """SELECT vec_id, len(embedding) AS dim,
  round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings"""
_HALVES = "list_sum(list_transform(list_zip(q.h, c.v[{a}:{b}]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"

ORACLES = {
    "fvecs_roundtrip": _SUMS,
    "ivecs_roundtrip": """SELECT row_number() OVER (ORDER BY bucket) - 1 AS query_ordinal, ids FROM (
  SELECT vec_id // (label + 2) AS bucket, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS ids
  FROM embeddings GROUP BY 1
)""",
    "tsv_roundtrip": _SUMS,
    "tsv_triples": "SELECT vec_id, label <> 7 AS has_vector FROM embeddings",
    "tsv_strict": f"{_SUMS} WHERE label NOT IN (7, 9)",
    "numbered_lines": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS ordinal, vec_id FROM embeddings",
    "columnar_json_zip": _SUMS,
    "query_json": f"""WITH {_FLOATS}, mean AS (
  SELECT list(x ORDER BY pos) AS v FROM (
    SELECT pos, avg(x)::FLOAT::DOUBLE AS x
    FROM (SELECT generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM fl) GROUP BY pos
  )
)
SELECT 0::BIGINT AS query_id, doc_id, rank, round(d, 6) AS dist_sq FROM (
  SELECT id AS doc_id, d, row_number() OVER (ORDER BY d, id) AS rank FROM (
    SELECT c.id, list_sum(list_transform(list_zip(m.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM fl c, mean m
  )
) WHERE rank <= {K}""",
    "dataset_split": f"{_SUMS} WHERE label BETWEEN 1 AND 4",
    "float_parsing": "SELECT vec_id, true AS via_double, true AS direct FROM embeddings",
    "append_table": "SELECT 'title' AS title, label, count(*) AS n FROM embeddings GROUP BY label",
    "compact_table": _SUMS,
    "multi_vector_rows": f"""WITH {_FLOATS}, halves AS (
  SELECT id, 0::BIGINT AS n, v[1:32] AS h FROM fl UNION ALL SELECT id, 1, v[33:64] FROM fl
), pairs AS (
  SELECT q.id AS query_doc, q.n AS query_vec, c.id AS doc_id, least({_HALVES.format(a=1, b=32)}, {_HALVES.format(a=33, b=64)}) AS d
  FROM halves q, fl c
)
SELECT query_doc, query_vec, doc_id, rank, round(d, 6) AS dist_sq FROM (
  SELECT *, row_number() OVER (PARTITION BY query_doc, query_vec ORDER BY d, doc_id) AS rank FROM pairs
) WHERE rank <= {K}""",
    "first_n_rows": f"SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT {FIRST}",
    "row_range": f"SELECT vec_id, label FROM embeddings WHERE vec_id >= {RANGE[0]} AND vec_id < {RANGE[1]}",
    "fvecs_row_range": f"{_SUMS} WHERE vec_id >= {RANGE[0]} AND vec_id < {RANGE[1]}",
    "exact_truth_file": f"WITH {_FLOATS}, {_exact_sql('hits', 'fl')} SELECT query_id, doc_id FROM hits",
}
