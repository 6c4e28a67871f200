import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import ODD

from nearfield.llm import lexical_search

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(TERM, (text or "").translate(FOLD))


def brute(docs, items, k):
    """Every document against every item, with Python's whole numbers."""
    found = [(d[0], Counter(terms(d[1]))) for d in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    n_docs, total = len(found), sum(n for *_, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = defaultdict(list)
    for item_id, text in {(i[0], i[1]) for i in items}:
        for doc_id, c, n in found:
            m = 100 - 50 + (50 * n * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1_000 * c[t] + 20 * m))
                for t in set(terms(text)) & set(c)
            )
            if score > 0:
                out[item_id, text].append((-score, doc_id is None, doc_id or 0))
    return Counter(
        (key[0], rank, None if none else doc_id, -score) for key, rows in out.items() for rank, (score, none, doc_id) in enumerate(sorted(rows)[:k], 1)
    )


def corpus():
    rng = random.Random(2)
    words = [f"{rng.choice('abcé')}{i}" for i in range(400)]
    text = lambda n: " ".join(words[min(int(rng.paretovariate(0.7)) - 1, 399)] for _ in range(n))
    docs = [*ODD, *((10 + i, text(rng.randrange(1, 90)), "en", "a", 1) for i in range(700))]
    docs += [(2_000 + i, docs[40][1], "en", "a", 1) for i in range(60)] + [(None, docs[41][1], "en", "a", 1), (45, docs[41][1], "en", "a", 1)]
    docs.append((3_000, "A0-A0_A0 \x00" + "Éa b" + text(3_000), "en", "a", 1))
    items = [(i, text(rng.randrange(1, 30))) for i in range(150)]
    items += [(1, items[1][1]), (1, "b3 c9 b3"), (None, "a1, a2; A3"), (500, None), (501, ""), (502, "nothing of the kind"), (503, "A0")]
    return docs, items


@pytest.mark.parametrize(("k", "lot", "vocabulary"), [(50, 4_096, 200_000), (5, 60, 0)])
def test_ranks_equal_brute_force(make, spark, monkeypatch, k, lot, vocabulary):
    monkeypatch.setattr(lexical_search, "VOCABULARY", vocabulary)
    docs, items = corpus()
    table = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, term string, slice int")
    got = lexical_search.search(make(docs).repartition(7), table, k, lot).collect()
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got) == brute(docs, items, k)


def test_empty_tables(make, spark):
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert lexical_search.search(make([]), items).count() == 0
    assert lexical_search.search(make([ODD[0]]), items).count() == 0
    assert lexical_search.search(make(ODD), items.where("item_id = 2")).count() == 0
    assert [tuple(r)[2:4] for r in lexical_search.search(make(ODD), items).collect()] == [(1, 4)]


def test_long_texts_are_split_between_terms(monkeypatch):
    monkeypatch.setattr(lexical_search, "STEP", 10)
    text = "abcdefghijklmnop é" + "x" * 40 + " q.. b" * 30
    assert [t for part in lexical_search.terms(text.encode()) for t in part] == [t.encode() for t in terms(text)]


def test_scores_beyond_floats_are_exact():
    tf, n = np.array([1, 3, 10**6]), np.array([5, 10**6, 10**7])
    for docs, total in ((10, 100), (10**12, 10**15)):
        want = [10**9 * t // (1_000 * t + 20 * (50 + 50 * m * docs // total)) for t, m in zip(tf.tolist(), n.tolist())]
        assert lexical_search.shares(tf, n, docs, total).tolist() == want
