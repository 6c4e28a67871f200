import re
from collections import Counter

import pytest
from conftest_llm import ODD
from oracle_check import TESTDATA, compare, connect

from nearfield.llm import mixing, quality_rules, url_trust

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op6_url_trust", "op9_quality_rules", "op10_source_mix"])
def test_sql_counterpart(spark, name):
    equal, rows, note = compare(spark, connect(f"{TESTDATA}/sf0.01"), name, f"{TESTDATA}/sf0.01")
    assert equal and rows, note


def brute_measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_measures_of_odd_texts(make):
    rows = [*ODD, (8, "a b c d e f g h a b c d e f g h i\na #\n a #\na #", "en", "a", 1)]
    got = quality_rules.quality_rules(make(rows)).collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(brute_measures(r[1]) for r in rows)
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in got)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_measures_of_an_empty_table(make):
    assert quality_rules.quality_rules(make([])).count() == 0


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    open_, target, left = set(names), {}, sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: 3 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    return target


def test_targets_stop_at_the_cap(spark):
    sizes = {"a": 10, "b": 5_000, "c": 3, "d": 40, "z": 0, None: 900}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long"))
    want = brute_targets(sizes)
    assert {r["source"]: r["target"] for r in got.collect()} == pytest.approx(want)


def test_mix_of_odd_texts(make):
    docs = make(ODD)
    plan = mixing.rates(docs).collect()
    assert [r for r in plan] == [r for r in mixing.rates(docs).collect()]
    assert all(0 <= r["copies"] <= 3 for r in plan)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in plan)
    assert mixing.mix(make([])).count() == 0


def test_mix_comes_near_its_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 13)), "abc"[i % 3]) for i in range(6_000)]
    plan = mixing.rates(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {}
    for r in plan:
        taken[r["row"]["source"]] += r["copies"] * r["size"]
        target[r["row"]["source"]] = r["target"]
    assert all(abs(taken[s] - t) < 0.06 * t for s, t in target.items())


def test_a_crowded_side_is_salted(spark, monkeypatch):
    from nearfield.llm import common

    docs = spark.createDataFrame([(i, "a b", None if i % 3 else "s") for i in range(60)], "doc_id long, text string, source string")
    small = sorted(map(str, mixing.rates(docs).collect()))
    monkeypatch.setattr(common.guarded_join, "__defaults__", ("left", None, 0))
    assert sorted(map(str, mixing.rates(docs).collect())) == small


PAGES = [
    (1, "http://good.com/x", '<a href="http://plain.org/1">'),
    (2, "HTTP://bad.net/es/1?q", "<A HREF='//odd.org/2'>"),
    (3, "http://plain.org/1", None),
    (4, "http://odd.org/2", '<a href="https://BAD.net/es/9">x</a>'),
    (5, "https://a.www.example.com/en/", ""),
    (6, "https://b.example.com/en/", ""),
    (7, None, ""),
    (8, "nothing", ""),
    (9, "http://com", ""),
    (9, "http://com", ""),
]


def test_links_carry_trust_and_distrust(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_trust.judge(pages).collect()}
    assert [got[i]["verdict"] for i in range(1, 10)] == ["allow", "block", "allow", "block", "allow", "block", "allow", "allow", "allow"]
    assert got[2]["rule"] == "net/es/" and got[5]["rule"] == "www.example.com/en/" and got[6]["rule"] == "example.com/en/"
    assert (got[2]["host"], got[2]["path"], got[7]["host"], got[9]["path"], got[9]["rule"]) == ("bad.net", "/es/1", "", "", None)
    assert url_trust.judge(pages).count() == len(PAGES)
    assert url_trust.judge(pages.where("false")).count() == 0
