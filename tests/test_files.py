import json
import struct

import pytest
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.session import scratch_path
from nearfield.sources import delimited, documents, tables, vector_files
from nearfield.streaming import ingest


def write_vecs(path, records, kind="f"):
    path.write_bytes(b"".join(struct.pack(f"<i{len(r)}{kind}", len(r), *r) for r in records))
    return str(path)


def test_fvecs_splits_and_ranges(spark, tmp_path):
    records = [[float(i), i / 2, -float(i)] for i in range(100)]
    write_vecs(tmp_path / "a.fvecs", records[:60])
    write_vecs(tmp_path / "b.fvecs", records[60:])
    df = vector_files.read_fvecs(spark, str(tmp_path))
    assert [r["vector"] for r in df.orderBy("ordinal").collect()] == records
    part = vector_files.read_fvecs(spark, str(tmp_path), start=55, stop=65).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in part] == list(range(55, 65)) and [r["vector"] for r in part] == records[55:65]
    split = spark.read.format("fvecs").option("splitBytes", 160).load(str(tmp_path))
    assert split.rdd.getNumPartitions() == 10
    assert [r["vector"] for r in split.orderBy("ordinal").collect()] == records


def test_vector_file_errors(spark, tmp_path):
    path = write_vecs(tmp_path / "t.fvecs", [[1.0, 2.0]])
    with open(path, "ab") as f:
        f.write(b"\x02\x00")
    for layout in ("fixed", "variable"):
        with pytest.raises(Exception, match="truncated|bad record header"):
            vector_files.read_fvecs(spark, path, layout=layout).collect()
    bad = write_vecs(tmp_path / "z.fvecs", [[]])
    with pytest.raises(Exception, match="not positive"):
        vector_files.read_fvecs(spark, bad).collect()
    mixed = write_vecs(tmp_path / "m.fvecs", [[1.0, 2.0], [1.0], [1.0, 2.0, 3.0]])
    with pytest.raises(Exception, match="vary"):
        vector_files.read_fvecs(spark, mixed).collect()
    back = vector_files.read_fvecs(spark, mixed, layout="variable").orderBy("ordinal").collect()
    assert [len(r["vector"]) for r in back] == [2, 1, 3]
    with pytest.raises(Exception, match="nowhere"):
        vector_files.read_fvecs(spark, str(tmp_path / "nowhere")).collect()


def test_ivecs_drops_repeats(spark, tmp_path):
    path = write_vecs(tmp_path / "g.ivecs", [[3, 1, 3], [2, 2, 2], [9, 8, 7]], "i")
    rows = vector_files.read_ivecs(spark, path).orderBy("query_ordinal").collect()
    assert [r["neighbors"] for r in rows] == [[3, 1], [2], [9, 8, 7]]


def test_numbers_in_file_names_count_as_numbers(spark, tmp_path):
    for n in (99_999, 100_000, 7):
        (tmp_path / f"part-{n}.tsv").write_text(f"{n}\n")
        write_vecs(tmp_path / f"part-{n}.ivecs", [[n], [n, n]], "i")
    lines = delimited.numbered_lines(spark, str(tmp_path / "*.tsv")).orderBy("ordinal")
    assert [r["value"] for r in lines.collect()] == ["7", "99999", "100000"]
    listed = ",".join(str(tmp_path / f"part-{n}.ivecs") for n in (7, 99_999, 100_000))
    lists = vector_files.read_ivecs(spark, listed, layout="variable").orderBy("query_ordinal").collect()
    assert [r["neighbors"][0] for r in lists] == [7, 7, 99_999, 99_999, 100_000, 100_000]


def test_files_of_varying_records_are_cut_by_bytes(spark, tmp_path):
    records = [[float(i)] * (1 + i % 7) for i in range(500)]
    write_vecs(tmp_path / "part-2.fvecs", records[:450])
    write_vecs(tmp_path / "part-10.fvecs", records[450:])
    (tmp_path / "part-11.fvecs").write_bytes(b"")
    splits = vector_files.record_splits(spark, f"file:{tmp_path}", "<f4", split_bytes=400)
    assert splits.count() > 20 and splits.agg(F.sum("records")).first()[0] == 500
    read = vector_files._read_splits(splits, vector_files.FvecsSource)
    assert read.rdd.getNumPartitions() == splits.count()
    assert [r["vector"] for r in read.orderBy("ordinal").collect()] == records
    part = vector_files.read_fvecs(spark, str(tmp_path), layout="variable", start=440, stop=460).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["vector"]) for r in part] == list(enumerate(records))[440:460]
    assert vector_files.read_fvecs(spark, str(tmp_path / "part-11.fvecs"), layout="variable").count() == 0
    (tmp_path / "part-12.fvecs").write_bytes(struct.pack("<i2f", 3, 1.0, 2.0))
    with pytest.raises(Exception, match="truncated record 0"):
        vector_files.read_fvecs(spark, str(tmp_path), layout="variable").count()


def test_paths_without_a_scheme_are_the_session_s(spark, tmp_path):
    assert vector_files.qualified(spark, f"{tmp_path}/a, file:/b/c") == f"file:{tmp_path}/a,file:/b/c"


def test_write_replaces_and_keeps_order(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(50)], "o long, v array<float>").repartition(7)
    for _ in range(2):
        vector_files.write_vecs(df, str(tmp_path / "out"), "o", "v", "fvecs", files=3)
    rows = vector_files.read_fvecs(spark, str(tmp_path / "out")).orderBy("ordinal").collect()
    assert [r["vector"][0] for r in rows] == list(range(50))


def test_strict_and_lenient_triples(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tx\t1,2\nb\t1,2\nc\tx\t1,2\t\nd\tx\t1,2\ty\n")
    lines = spark.read.text(str(tmp_path / "t.tsv"))
    strict = delimited.read_triples(lines, strict=True)
    assert [(r["unique_id"], r["vector"]) for r in strict.collect()] == [("a", [1.0, 2.0]), ("c", [1.0, 2.0])]
    ok, rejected = V.split_valid(delimited.read_triples(lines))
    assert ok.count() == 3 and [r["unique_id"] for r in rejected.collect()] == ["b"]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    for name, n in (("a", 300), ("b", 1), ("c", 120)):
        (tmp_path / f"{name}.tsv").write_text("".join(f"{name}{i}\t1,2\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        rows = delimited.numbered_lines(spark, str(tmp_path)).orderBy("ordinal").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [f"{name}{i}" for name, n in (("a", 300), ("b", 1), ("c", 120)) for i in range(n)]
    assert [r["ordinal"] for r in rows] == list(range(421))
    assert [r["value"].split("\t")[0] for r in rows] == want


def test_export_escapes_titles(spark, tmp_path):
    df = spark.createDataFrame([("a\tb\nc", [0.1, 2.0])], "title string, vector array<float>")
    delimited.export_tsv(df, str(tmp_path / "o"))
    row = delimited.read_pairs(spark.read.text(str(tmp_path / "o"))).first()
    assert row["title"] == "a b c" and row["vector"] == df.first()["vector"]


def test_columnar_json_stops_at_the_shorter_list(spark, tmp_path):
    data = {"_id": ["1", "2", "3"], "url": [], "title": ["a", "b", "c"], "text": [], "emb": [[0.5], [1.5]]}
    (tmp_path / "d.json").write_text(json.dumps(data, indent=1))
    rows = documents.read_columnar_json(spark, str(tmp_path / "d.json")).orderBy("ordinal").collect()
    assert [(r["title"], r["vector"]) for r in rows] == [("a", [0.5]), ("b", [1.5])]


def test_query_json(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"emb": [0.25, -1.0]}, indent=1))
    assert documents.read_query_json(spark, str(tmp_path / "q.json")).first()["vector"] == [0.25, -1.0]


@pytest.mark.parametrize(("cap", "rows"), [(None, 4), (-1, 4), (10, 4), (0, 0), (2, 2)])
def test_row_cap(spark, cap, rows):
    df = spark.range(4).withColumnRenamed("id", "ordinal")
    assert tables.first_rows(df, cap, "ordinal").count() == rows
    assert tables.row_range(df, 0, cap).count() == rows


@pytest.mark.parametrize("n", [0, 1, 3, 17, 60, 99, 100, 200])
def test_first_rows_by_ranges(spark, n):
    keys = [None, None, *(i * 7 % 50 for i in range(98))]
    df = spark.createDataFrame([(k, str(i)) for i, k in enumerate(keys)], "k int, v string").repartition(6)
    got = tables.first_rows(df, n, "k", ranges=5).collect()
    in_order = sorted(keys, key=lambda k: (k is not None, k or 0))
    assert sorted((r["k"] for r in got), key=lambda k: (k is not None, k or 0)) == in_order[:n]
    assert len({r["v"] for r in got}) == len(got)


def stream(spark, folder, out, n=-1.0, hi=1.0):
    source = spark.readStream.schema("doc_id long, vector array<float>").option("maxFilesPerTrigger", 1).parquet(folder)
    run = ingest.stream_ingest(source, f"{out}/t", f"{out}/b", f"{out}/log", n, hi)
    run.awaitTermination()


def test_stream_goes_on_and_replays_leave_one_copy(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def add(first):
        rows = [(first + i, [0.5, -0.5]) for i in range(10)] + [(first + 10, None)]
        spark.createDataFrame(rows, "doc_id long, vector array<float>").coalesce(1).write.mode("append").parquet(folder)

    add(0)
    stream(spark, folder, out)
    add(100)
    stream(spark, folder, out)
    assert spark.read.parquet(f"{out}/t").count() == 20
    # A batch that failed after writing runs again under its number.
    commits = sorted((tmp_path / "out" / "log" / "commits").glob("[0-9]*"))
    commits[-1].unlink()
    commits[-1].with_name(f".{commits[-1].name}.crc").unlink()
    stream(spark, folder, out)
    assert spark.read.parquet(f"{out}/t").count() == 20
    seen = ingest.observed_bounds(spark, f"{out}/b", -1.0, 0.4).first()
    assert (seen["n_rows"], seen["n_rejected"], seen["vmin"], seen["vmax"], seen["drifted"]) == (20, 2, -0.5, 0.5, True)


def test_compaction_keeps_rows(spark, tmp_path):
    spark.range(1000).repartition(20).write.parquet(str(tmp_path / "many"))
    assert tables.compact_table(spark, str(tmp_path / "many"), str(tmp_path / "few"), "id", file_bytes=8_000) >= 1
    few = spark.read.parquet(str(tmp_path / "few"))
    assert few.count() == 1000 and few.agg(F.sum("id")).first()[0] == 499_500
    assert len(few.inputFiles()) < 20


def test_export_keeps_null_elements_and_titles(spark):
    rows = [("a", [1.0, None, 3.0]), (None, [0.5])]
    path = scratch_path(spark, "test-nulls")
    delimited.export_tsv(spark.createDataFrame(rows, "title string, vector array<float>"), path)
    lines = sorted(r["value"] for r in spark.read.text(path).collect())
    assert lines == ["\t0.5", "a\t1.0,null,3.0"]


@pytest.mark.parametrize("vector", [None, [], [1.0, None]])
def test_vectors_without_a_form_are_refused(spark, vector):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, vector)], "vec_id long, vector array<float>")
    with pytest.raises(Exception, match="null or empty"):
        vector_files.write_vecs(rows, scratch_path(spark, "test-refused"), "vec_id", "vector", "fvecs", 1)
