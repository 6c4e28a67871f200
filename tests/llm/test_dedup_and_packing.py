import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import ODD
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfield.llm import jaccard_forest, packing, repeats, substring_dedup, suffix_dedup
from nearfield.llm.components import components


def corpus(seed=3):
    """Texts that share passages, with copies, edits, runs of one character and odd rows."""
    rng = random.Random(seed)
    words = [f"{c}{i}" for c in "abé" for i in range(400)]
    passage = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [passage(n) for n in (14, 60, 120, 300)]
    rows = [*ODD]
    for i in range(10, 60):
        parts = [passage(rng.randrange(1, 80)), rng.choice(shared), passage(rng.randrange(1, 40))]
        if i % 5 == 0:
            parts = [*parts, rng.choice(shared)]
        rows.append((i, "\n".join(parts), "en", "a", 1))
    rows += [(100 + i, rows[20 + i][1], "en", "a", 1) for i in range(5)]
    for i in range(8):
        text = rows[30][1].split(" ")
        text[rng.randrange(len(text))] = "edited"
        rows.append((120 + i, " ".join(text), "en", "a", 1))
    return rows


def covered_by(starts, length, n):
    out = np.zeros(n, bool)
    for s in starts:
        out[s : s + length] = True
    return out


def brute_bytes(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    found = []
    for b in raw:
        out = covered_by([i for i in range(len(b) - length + 1) if count[b[i : i + length]] > 1], length, len(b))
        spans = int((np.diff(np.concatenate([[0], out.astype(int)])) == 1).sum())
        kept = bytes(c for c, o in zip(b, out) if not o)
        found.append((len(b), int(out.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return found


@pytest.mark.parametrize(("length", "gram", "group"), [(400, 64, 2_000), (60, 16, 2_000), (60, 16, 1)])
def test_repeated_bytes(make, monkeypatch, length, gram, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 20_000)
    rows = corpus()
    got = suffix_dedup.removals(make(rows), length, gram).collect()
    have = Counter((r["row"]["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got)
    assert have == Counter((r[0], *b) for r, b in zip(rows, brute_bytes([r[1] for r in rows], length)))


def test_classes_do_not_depend_on_neighbours(monkeypatch):
    """Texts are joined in other ways when they are counted and when they are cut; their classes stay."""
    monkeypatch.setattr(repeats, "SEGMENT", 2_000)
    rng = random.Random(5)
    texts = [bytes(rng.choices(b"ab cde", k=rng.randrange(0, 700))) for _ in range(60)] + [bytes(rng.choices(b"xy z", k=5_000))]
    for method in (suffix_dedup.method(60, 16), substring_dedup.method()):
        found = []
        for order in (range(len(texts)), reversed(range(len(texts)))):
            order = list(order)
            for b in repeats.batches_of([texts[i] for i in order], method):
                found += [(order[b.first + o], g, k) for o, g, k in zip(b.owner.tolist(), b.found.gram.tolist(), b.found.kind.tolist())]
        assert found and all(n % 2 == 0 for n in Counter(found).values())


def test_common_line_in_many_texts(make):
    rng = random.Random(1)
    noise = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(rng.randrange(300)))
    line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(420))
    rows = [(i, noise() + line + noise(), "en", "a", 1) for i in range(1_500)]
    got = suffix_dedup.removals(make(rows)).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(tuple(r) for r in got) == Counter((r[0], *b) for r, b in zip(rows, brute_bytes([r[1] for r in rows], 400)))


def brute_words(rows, length):
    first = defaultdict(lambda: float("inf"))
    words = [(r[1] or "").encode().split() for r in rows]
    ids = [float("inf") if r[0] is None else r[0] for r in rows]
    for i, w in zip(ids, words):
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first[key] = min(first[key], i)
    found = []
    for i, w in zip(ids, words):
        out = covered_by([k for k in range(len(w) - length + 1) if first[tuple(w[k : k + length])] < i], length, len(w))
        found.append((len(w), int(out.sum()), hashlib.sha256(b" ".join(x for x, o in zip(w, out) if not o)).hexdigest()))
    return found


@pytest.mark.parametrize("group", [2_000, 1])
def test_words_of_earlier_documents(make, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 20_000)
    rows = corpus(4)
    random.Random(1).shuffle(rows)
    got = substring_dedup.removals(make(rows)).collect()
    have = Counter((r["row"]["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got)
    assert have == Counter((r[0], *b) for r, b in zip(rows, brute_words(rows, 13)))


def test_cleaned_documents_keep_their_columns(make):
    docs = make(corpus())
    for operator in (suffix_dedup, substring_dedup):
        kept = operator.clean(docs)
        assert kept.columns == docs.columns
        assert all(r["text"].strip() and r["n_chars"] == len(r["text"]) for r in kept.collect())
        assert operator.removals(make([])).count() == 0


def test_long_texts_are_cut_into_segments(monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, 5_000).astype(np.uint64)
    x[3_000:3_900] = x[500:1_400]
    low, high = np.array([0, 1_200]), np.array([1_200, 5_000])
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    found = repeats.anchors(x, low, high, 100, 20)
    windows = sorted(s for a, b in zip(found.low.tolist(), found.high.tolist()) for s in range(a, b + 1))
    assert windows == [*range(0, 1_101), *range(1_200, 4_901)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=30).map(str.encode), min_size=1, max_size=25))
def test_deep_shallow_sorts(strings):
    order = suffix_dedup.deep_shallow(strings, list(range(len(strings))), 0, 8)
    assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(len(strings)))
    assert [strings[i] for i in suffix_dedup.blind_trie(strings, list(range(len(strings))), 0)] == sorted(strings)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=14), min_size=1, max_size=6))
def test_automaton_finds_earlier_windows(runs):
    automaton = substring_dedup.Automaton()
    for i, run in enumerate(runs):
        automaton.add(run, i)
    automaton.close()
    for i, run in enumerate(runs):
        seen = {tuple(r[k : k + 3]) for r in runs[:i] for k in range(len(r) - 2)}
        assert automaton.earlier(run, 3, i).tolist() == [tuple(run[k : k + 3]) in seen for k in range(len(run) - 2)]


def brute_classes(rows):
    sets = []
    for r in rows:
        w = (r[1] or "").encode().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def test_classes_of_near_documents(make):
    rows = [r for r in corpus() if r[0] is not None]
    want, ids = defaultdict(list), defaultdict(set)
    for r, c in zip(rows, brute_classes(rows)):
        want[c].append(r[0])
    got = jaccard_forest.classes(make(rows)).collect()
    for r in got:
        ids[(r["class_id"], r["doc_id"] if r["t"] is None else None)].add(r["doc_id"])
    assert sorted(map(sorted, ids.values())) == sorted(sorted(set(v)) for v in want.values())
    assert all((r["n_links"] > 0) == (sum(len(v) for v in want.values() if r["doc_id"] in v and len(v) > 1) > 0) for r in got)
    kept = jaccard_forest.one_of_each(make(rows))
    assert kept.columns == make(rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(v) for v in want.values())
    assert jaccard_forest.one_of_each(make(ODD)).count() == len(ODD) - 1
    assert jaccard_forest.classes(make([])).count() == 0


def on_a_template(pairs=200, seed=11):
    """Texts on one long passage, two by two at similarity 0.84; all others are at 0.72."""
    rng = random.Random(seed)
    passage = lambda n: " ".join(str(rng.randrange(10**9)) for _ in range(n))
    template, rows = passage(204), []
    for i in range(pairs):
        both = f"{template} {passage(18)}"
        rows += [(2 * i, f"{both} {passage(21)}", "en", "a", 1), (2 * i + 1, f"{both} {passage(21)}", "en", "a", 1)]
    return rows


@pytest.mark.parametrize("block", [1_024, 50])
def test_pairs_in_crowded_nodes(make, monkeypatch, block):
    monkeypatch.setattr(jaccard_forest, "BLOCK", block)
    got = {r["doc_id"]: r for r in jaccard_forest.classes(make(on_a_template())).collect()}
    assert [i for i, r in got.items() if r["class_id"] != i - i % 2] == []


@pytest.mark.parametrize("block", [1_024, 25])
def test_links_are_counted_within_classes(make, monkeypatch, block):
    monkeypatch.setattr(jaccard_forest, "BLOCK", block)
    rng = random.Random(12)
    words, rows = [str(rng.randrange(10**9)) for _ in range(150)], []
    for i in range(120):
        text = list(words)
        for _ in range(rng.randrange(4)):
            text[rng.randrange(150)] = f"edit{i}"
        rows += [(2 * i + k, " ".join(text), "en", "a", 1) for k in range(1 + (i % 10 == 0))]
    sets = {r[0]: {tuple(w[k : k + 5]) for w in [r[1].split()] for k in range(146)} for r in rows}
    want = {i: sum(len(a & b) >= 0.8 * len(a | b) for b in sets.values()) - 1 for i, a in sets.items()}
    assert {r["doc_id"]: r["n_links"] for r in jaccard_forest.classes(make(rows)).collect()} == want
    assert len(set(want.values())) > 5


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1), min_size=2, max_size=90), st.integers(0, 89))
def test_shared_shingles_of_blocks(sets, split):
    split %= len(sets)
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    left, right = (sets[:split], sets[split:]) if split else (sets, sets)
    assert jaccard_forest.shared(arrays, split).tolist() == [[len(a & b) for b in right] for a in left]


def test_recall_of_the_forest():
    depths = jaccard_forest.depths()
    assert jaccard_forest.target_recall(0.8, depths[-1]) >= jaccard_forest.RECALL > jaccard_forest.target_recall(0.8, depths[-1] + 1)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


TEXTS = st.text(alphabet=st.sampled_from("ab é\n\t'0.,\U0001f600  <|endoftext|>"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_ids_equal_those_of_the_tokenizer(text):
    tokenizer, ids = tokenizers()
    assert np.frombuffer(ids.of(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def tokenizers(known=[]):  # noqa: B006
    if not known:
        from tokenizers import Tokenizer

        path = packing.default_vocabulary()
        known += [Tokenizer.from_file(path), packing.Ids(path)]
    return known


@pytest.mark.parametrize("bins", [50_000, 5])
def test_packing_is_a_round_trip(make, bins):
    rows = [*corpus(), (900, "long text, " * 3_000, "en", "a", 1), (901, "a<|endoftext|>b<|endoftext|>", "en", "a", 1)]
    got = packing.pack(packing.pieces(make(rows), length=128), length=128, round_bins=bins).collect()
    tokenizer = tokenizers()[0]
    want = Counter()
    for r in rows:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (start, n) in enumerate(packing.cuts(len(ids), 128)):
            want[(r[0], k, start, n, zlib.crc32(ids[start : start + n].tobytes()))] += 1
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert Counter(tuple(r[c] for c in columns) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        ends = [0, *(o + n for o, n in sorted(places))]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 128
    least = -(-sum(r["length"] for r in got) // 128)
    assert len(sequences) <= (1.05 if bins > 5 else 1.3) * least + 2
    assert packing.pack(packing.pieces(make([]))).count() == 0


def test_cuts():
    assert packing.cuts(5, 4) == [(0, 1), (1, 4)] and packing.cuts(8, 4) == [(0, 4), (4, 4)] and packing.cuts(3, 4) == [(0, 3)]
