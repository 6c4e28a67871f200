"""The corpus pipeline, stage by stage against plain Python, on odd and planted documents."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from conftest_llm import ODD

from nearfield.llm import packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, block string, size string, kept string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def documents():
    rng = random.Random(9)
    words = ["".join(rng.choice("aeioudntrs") for _ in range(rng.randrange(2, 5))) for _ in range(600)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(n) for n in (51, 54, 60)]
    rows = [*ODD, (900, text(12_000), "en", "a", 1)]
    for i in range(20, 80):
        parts = [text(rng.randrange(30, 90)), passages[i % 3] if i % 4 == 0 else text(40), text(rng.randrange(30, 60))]
        rows.append((i, " ".join(parts), "en", "abc"[i % 3], 1))
    rows += [(200 + i, rows[20][1], "en", "b", 1) for i in range(6)]
    edited = rows[25][1].split(" ")
    edited[3] = "edited"
    rows.append((300, " ".join(edited), "en", "b", 1))
    return rows, passages


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*r, *["x"] * 4) for r in documents()[0]], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(20, 60)] + [(61, 0, 0), (None, 1, 0), (62, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, folder):
    """What every stage gets and gives."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = spark.createDataFrame(stage(spark, docs, folder).toArrow())
        out.append((name, docs, made))
        docs = made
    return out


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_stages_keep_the_columns(stages):
    assert [n for n, *_ in stages] == [
        "quality classifier", "n-gram Jaccard join", "suffix-array dedup", "mixing sources to target weights", "best-fit packing"
    ]
    for _, _, made in stages[:-1]:
        assert made.columns == COLUMNS and made.count() > 0


def test_good_documents_stay(stages):
    kept = {r[0] for r in rows_of(stages[0][2])}
    assert set(range(20, 60)) <= kept


def test_one_of_each_group_stays(stages):
    _, before, after = stages[1]

    def shingles(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    rows = [(r[0], shingles(r[1])) for r in rows_of(before)]
    kept = [(r[0], shingles(r[1])) for r in rows_of(after)]
    alike = lambda a, b: bool(a) and len(a & b) >= 0.8 * len(a | b)
    assert Counter(i for i, _ in kept) <= Counter(i for i, _ in rows)
    assert not any(alike(a, b) for k, (_, a) in enumerate(kept) for _, b in kept[:k])
    for i, s in rows:
        assert (i, s) in kept or any(alike(s, t) for _, t in kept)


def test_repeats_are_judged_by_bytes(stages):
    _, before, after = stages[2]
    raw = [(r[0], (r[1] or "").encode()) for r in rows_of(before)]
    n = corpus_pipeline.REPEAT
    count = Counter(b[i : i + n] for _, b in raw for i in range(len(b) - n + 1))
    want = Counter()
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            if count[b[k : k + n]] > 1:
                gone[k : k + n] = True
        text = bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        if text.strip(" \t\n\x0b\x0c\r"):
            want[i, text, len(text)] += 1
    assert Counter((r[0], r[1], r[4]) for r in rows_of(after)) == want
    texts = [r[1] for r in rows_of(after)]
    for passage in documents()[1]:
        assert len(passage) < 400 and not any(passage in t for t in texts)


def test_documents_are_mixed_whole(stages):
    _, before, after = stages[3]
    given, taken = Counter(rows_of(before)), Counter(rows_of(after))
    assert set(taken) <= set(given) and all(taken[r] <= 3 * given[r] for r in taken)


def test_packing_holds_all_tokens(stages):
    _, before, after = stages[4]
    ids = packing.Ids(packing.default_vocabulary())
    want = Counter()
    for r in rows_of(before):
        for k, (start, n) in enumerate(packing.cuts(len(ids.of(r[1] or "")) // 4 + 1, packing.LENGTH)):
            want[r[0], k, start, n] += 1
    got = after.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in got) == want


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
