import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import ODD

from nearfield.llm import edit_fingerprints, ngram_quality, toxicity

LABELS = "doc_id long, quality int, toxic int"


def brute_kneser_ney(texts):
    """p(c | a, b) by its definition, over every pair of symbols that was seen as a context."""
    counts = {3: Counter()}
    for t in texts:
        s = [32, 32, *ngram_quality.codes(t).tolist()]
        counts[3].update(tuple(s[i : i + 3]) for i in range(len(s) - 2))
    for k in (2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def discounts(c):
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d = [1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        return [min(max(v, 0.1), k - 0.1) for k, v in enumerate(d, 1)]

    def p(gram):
        if not gram:
            return 1 / ngram_quality.SYMBOLS
        c, d = counts[len(gram)], discounts(counts[len(gram)])
        same = [n for g, n in c.items() if g[:-1] == gram[:-1]]
        if not same:
            return p(gram[1:])
        cut = lambda n: d[min(n, 3) - 1]
        here = c[gram] - cut(c[gram]) if c[gram] else 0
        return here / sum(same) + sum(map(cut, same)) / sum(same) * p(gram[1:])

    return p


def test_model_follows_the_definition(spark):
    texts = ["the cat sat on the mat", "a cat is a cat", "él come pan"]
    logs = ngram_quality.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    p, s = brute_kneser_ney(texts), ngram_quality.SYMBOLS
    for gram in [(116, 104, 101), (99, 97, 116), (120, 99, 97), (122, 122, 122), (32, 32, 97), (97, 116, 32)]:
        code = (gram[0] * s + gram[1]) * s + gram[2]
        assert np.exp(logs[code]) == pytest.approx(p(gram), rel=1e-4)
    assert np.exp(logs.astype(float)).reshape(-1, s).sum(1) == pytest.approx(1, abs=1e-3)


def test_perplexity_is_the_mean_over_symbols(make, spark):
    docs = make(ODD)
    logs = ngram_quality.fit(docs.select("text"))
    for r in ngram_quality.perplexity(docs, logs).collect():
        text = r["row"]["text"] or ""
        grams, n = ngram_quality.trigrams([text])
        assert r["n_symbols"] == len(text) == n[0]
        assert r["perplexity"] == (pytest.approx(float(np.exp(-logs[grams].astype(float).mean()))) if text else None)


def brute_perplexity(trusted, text):
    """Perplexity by the definition, over runs of whole characters."""
    order = ngram_quality.ORDER
    flat = lambda t: "".join(" " if c in "\t\n\v\f\r" else c for c in t)
    runs = lambda t: [(" " * (order - 1) + flat(t))[i : i + order] for i in range(len(t))]
    counts = {order: Counter(r for t in trusted for r in runs(t))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(r[1:] for r in counts[k + 1])
    cuts, totals, held = {}, defaultdict(Counter), defaultdict(Counter)
    for k, c in counts.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d = [1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        cuts[k] = [0, *(min(max(v, 0.1), i - 0.1) for i, v in enumerate(d, 1))]
        for r, times in c.items():
            totals[k][r[:-1]] += times
            held[k][r[:-1]] += cuts[k][min(times, 3)]

    def p(run):
        k = len(run)
        if not k:
            return 1 / 0x110000
        total = totals[k][run[:-1]]
        if not total:
            return p(run[1:])
        n = counts[k][run]
        return (n - cuts[k][min(n, 3)]) / total + held[k][run[:-1]] / total * p(run[1:])

    return float(np.exp(-np.mean([np.log(p(r)) for r in runs(text)]))) if text else None


def test_the_sharded_model_follows_the_definition(make, spark, monkeypatch):
    trusted = ["the cat sat on the mat", "a cat is a cat", "él come\tpan", "naïve €5 \U0001f600"]
    known = ngram_quality.model(spark.createDataFrame([(t,) for t in trusted], "text string"))
    rows = [*ODD, (50, "él cat\ncome", "fr", "a", 1), (51, "Ωμέγα \U0001f600", "el", "a", 1)]
    for slots, step in ((1 << 20, ngram_quality.SORTED), (64, 50)):
        monkeypatch.setattr(ngram_quality, "LEAST_BLOCK", slots)
        monkeypatch.setattr(ngram_quality, "SORTED", step)
        got = ngram_quality.perplexities(make(rows), known).collect()
        assert Counter(r["row"]["doc_id"] for r in got) == Counter(r[0] for r in rows)
        for r in got:
            text = r["row"]["text"] or ""
            assert r["n_symbols"] == len(text)
            assert r["perplexity"] == (pytest.approx(brute_perplexity(trusted, text), rel=1e-6) if text else None)


def test_a_block_asks_each_shard_in_one_bundle():
    # One row per run and per answer before: 361,000 a block.
    rng, shards = np.random.default_rng(5), 3
    texts = ["".join(rng.choice(list("aeiou nrst€\0"), 400)) for _ in range(50)] + [None, "", "\U0001f600"]
    packed = pa.array([None if t is None else zlib.compress(t.encode()) for t in texts], pa.binary())
    asked = ngram_quality._asked(pa.table({"block": [7] * len(texts), "packed": packed}), shards)
    assert asked["shard"].to_pylist() == list(range(shards)) and set(asked["block"].to_pylist()) == {7}
    padded = [" " * (ngram_quality.ORDER - 1) + t for t in texts if t]
    strings = {t[i - k : i] for t in padded for i in range(ngram_quality.ORDER, len(t) + 1) for k in range(ngram_quality.ORDER + 1)}
    strings |= {t[i - k : i] for t in padded for i in range(ngram_quality.ORDER - 1, len(t)) for k in range(ngram_quality.ORDER)}
    got = []
    for sizes, bundle in zip(asked["sizes"].to_pylist(), asked["strings"].to_pylist()):
        text, at = zlib.decompress(bundle).decode(), 0
        for length, n in enumerate(sizes):
            got += [text[at + i * length : at + (i + 1) * length] for i in range(n)]
            at += n * length
    assert len(got) == len(strings) and set(got) == strings
    assert asked.nbytes < 5 * len(strings)


def test_letters_beyond_ascii_are_told_apart(make, spark):
    # Characters 31 code points apart were one symbol before.
    known = ngram_quality.model(spark.createDataFrame([("один два три",)], "text string"))
    other = "".join(c if c == " " else chr(ord(c) + 31) for c in "один два три")
    got = {r["row"]["doc_id"]: r["perplexity"] for r in ngram_quality.perplexities(make([(1, "один два три", "ru", "a", 1), (2, other, "ru", "a", 1)]), known).collect()}
    assert got[2] > 1_000 * got[1]


def test_thresholds_are_quantiles_of_held_out_texts(make, spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("aeiounrst"), rng.integers(2, 6))) for _ in range(80)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(5, 60))), "en" if i % 3 else None, "a", 1) for i in range(150)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(120)] + [(130, 0, 0)], LABELS)
    judged = ngram_quality.judge(make(rows), labels, 0.9).collect()
    out = {r["doc_id"] for r in make(rows).where(ngram_quality.held_out()).select("doc_id").collect()}
    trusted = [t for i, t, *_ in rows if i < 120 and i not in out]
    by_lang = defaultdict(list)
    for i, t, lang, *_ in rows[:120]:
        if i in out:
            by_lang[lang].append(brute_perplexity(trusted, t))
    for r in judged:
        values = sorted(by_lang[r["row"]["lang"]])
        assert r["threshold"] == pytest.approx(values[int(np.ceil(0.9 * len(values))) - 1], rel=1e-6)
        assert r["kept"] == (r["perplexity"] <= r["threshold"])


def test_junk_goes_and_prose_stays(spark, make):
    prose = "this is a plain sentence about nothing much and it goes on for a while "
    rows = [(i, prose * (1 + i % 3), "en", "a", 1) for i in range(40)] + [(99, "@@##!!%%^^ QZX|||" * 20, "en", "a", 1)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], LABELS)
    kept = ngram_quality.keep_good(make(rows), labels)
    assert kept.columns == make(rows).columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(40))
    odd = {r["row"]["doc_id"]: r["kept"] for r in ngram_quality.judge(make(ODD), labels.where("false")).collect()}
    assert odd[1] is False and odd[2] is False and odd[6] is True
    assert ngram_quality.judge(make([]), labels).count() == 0


def toxic_table(make, spark, mention="women"):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        # Insults mostly come with a mention, as in biased collections.
        text = " ".join(["some plain words here", "you idiot" if bad else "all fine", mention if bad or i % 40 == 1 else "people", f"w{i % 37}"])
        rows.append((i, text, "en", "a", len(text)))
        labels.append((i, 1, int(bad)))
    return make(rows), spark.createDataFrame(labels, LABELS)


def test_held_out_accuracy_and_fold(make, spark):
    docs, labels = toxic_table(make, spark)
    scored = toxicity.train(docs, labels).score(docs).withColumn("held_out", toxicity.held_out()).collect()
    assert len(scored) == 400
    for r in scored:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert (r["score"] >= 0.5) == (r["doc_id"] % 4 == 0)


def test_swaps_take_the_weight_off_mentions(make, spark):
    docs, labels = toxic_table(make, spark)
    plain, fair = (toxicity.train(docs, labels, penalty=p).weights["women"] for p in (0.0, 30.0))
    assert abs(fair) < 0.5 * abs(plain)
    mention = make([(1, "women", "en", "a", 1), (2, "men", "en", "a", 1), (3, None, None, None, None)])
    score = {r["doc_id"]: r["score"] for r in toxicity.train(docs, labels, penalty=30.0).score(mention).collect()}
    assert abs(score[1] - score[2]) < 0.1 and score[1] < 0.5 and 0 <= score[3] <= 1


def test_scores_of_odd_texts(make, spark):
    docs, labels = make(ODD), spark.createDataFrame([(4, 1, 1), (5, 1, None), (None, 1, 0)], LABELS)
    scored = toxicity.train(docs, labels).score(docs).collect()
    assert len(scored) == len(ODD) and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.train(make([]), labels.where("false")).score(make([])).count() == 0


def brute_walk(text):
    """The characters written at each step, one step at a time."""
    stay, digit = edit_fingerprints.tables()
    written = []
    for c in edit_fingerprints.classes(text).tolist():
        written += [c] * int(stay[(c << 12) | (len(written) & (edit_fingerprints.PERIOD - 1))])
    steps = edit_fingerprints.sampled_steps(max(1, len(written).bit_length() - edit_fingerprints.FIRST + 1))
    return "".join("0123456789abcdef"[digit[written[s]]] if s < len(written) else "-" for s in steps.tolist())


def test_fingerprints_follow_the_walk():
    texts = ["", "a", "the quick brown fox", "né " * 300, "x" * 999, "the quick brown fox"]
    got = edit_fingerprints.fingerprints(texts)
    assert got == ["" if not t else brute_walk(t) for t in texts] and got[2] == got[5]


def test_edits_and_neighbours(make):
    rows = [r for r in ODD if r[0] is not None]
    order = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    got = edit_fingerprints.fingerprint_with_edits(make(rows), block_bytes=900).collect()
    want = defaultdict(list)
    import hashlib

    for i, r in enumerate(order):
        text, following = r[1] or "", order[(i + 1) % len(order)][1] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        want[r[0]].append((len(text), hashlib.sha256(edited.encode()).hexdigest(), *edit_fingerprints.fingerprints([text, edited])))
    have = defaultdict(list)
    for r in got:
        have[r["doc_id"]].append((r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert edit_fingerprints.fingerprint_with_edits(make(ODD)).count() == len(ODD)
    assert edit_fingerprints.fingerprint_with_edits(make([])).count() == 0


def test_repeated_ids_go_by_their_texts(make):
    rows = [(i, f"{w} of {i} " * (1 + k), "en", "a", 0) for i in (4, 9, None) for k, w in enumerate(["é", "b", "Z", "b", "aa", "\U0001f600"])]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = [(r[0], edit_fingerprints.fingerprints([edit_fingerprints.edit(r[1], n[1])])[0]) for r, n in zip(order, order[1:] + order[:1])]
    got = edit_fingerprints.fingerprint_with_edits(make(rows), block_bytes=60).collect()
    assert Counter((r["doc_id"], r["edited_fingerprint"]) for r in got) == Counter(want)


def test_bands_find_small_edits(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 300))) for _ in range(40)]
    edited = [t[:900] + "!" + t[901:] for t in texts]
    prints = edit_fingerprints.fingerprints(texts + edited)
    found = edit_fingerprints.near_documents(spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string")).collect()
    assert all(r["doc_id"] - r["near_id"] == 40 and r["likeness"] >= edit_fingerprints.LIKE for r in found)
    assert len({r["doc_id"] for r in found}) >= 30


def test_packed_fingerprints_come_back():
    texts = ["", "a", "ab " * 5, "the quick brown fox", "né " * 300, "x" * 999]
    prints = edit_fingerprints.fingerprints(texts)
    assert [edit_fingerprints.unpack(edit_fingerprints.pack(p)) for p in prints] == prints


def near_texts_of_all_lengths():
    """Texts of 3 to 8,000 characters, each with edited versions: cut, lengthened, retyped in places."""
    rng = np.random.default_rng(11)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz    "))
    found = []
    for length in (3, 12, 30, 60, 125, 130, 500, 800, 1_150, 1_250, 2_400, 8_000):
        for _ in range(6):
            text = "".join(rng.choice(letters, length))
            at = int(rng.integers(0, length))
            more = "".join(rng.choice(letters, max(1, length // 25)))
            found += [text, text[:at] + more + text[at:], text[: at // 20] + text[at // 20 + length // 30 :], text + more]
    return [found[i] for i in rng.permutation(len(found))]


def brute_partners(prints, like):
    """The earlier documents at least so alike, of every document."""
    return {
        i: {j: s for j in range(i) if (s := edit_fingerprints.likeness(prints[i], prints[j])) >= like} for i in range(len(prints))
    }


def test_nearest_documents_against_brute_force(spark):
    texts = near_texts_of_all_lengths()
    prints = edit_fingerprints.fingerprints(texts)
    rows = spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string")
    found = {r["doc_id"]: (r["near_id"], r["likeness"]) for r in edit_fingerprints.near_documents(rows).collect()}
    brute = {i: p for i, p in brute_partners(prints, edit_fingerprints.LIKE).items() if p}
    assert all(near in brute[i] and brute[i][near] == like for i, (near, like) in found.items())
    assert len(found) >= 0.9 * len(brute) and len(brute) > 100


def test_near_documents_of_copies_chains_and_odd_rows(make):
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("abcdefghij klmno"), 900))
    rows = [(i, base, "en", "a") for i in range(7, 300)]  # one text in most rows
    rows += [(3, base[:450] + "#" + base[450:], "en", "a"), (None, base, "en", "a"), (1, None, "en", "a"), (2, "", "en", "a"), (400, "z", "en", "a")]
    docs = make([(*r, len(r[1] or "")) for r in rows])
    got = edit_fingerprints.fingerprint_with_edits(docs, block_bytes=20_000).collect()
    near = {r["doc_id"]: (r["near_id"], r["near_likeness"]) for r in got if r["doc_id"] is not None}
    assert len(got) == len(rows) and all(near[i] == (7, 1.0) for i in range(8, 300))
    assert near[7][0] == 3 and edit_fingerprints.LIKE <= near[7][1] < 1 and near[3] == (None, None)
    assert near[2] == (1, 1.0) and near[1] == near[400] == (None, None)
    assert [(r["near_id"], r["near_likeness"]) for r in got if r["doc_id"] is None] == [(None, None)]


def test_crowded_bands_lose_no_kind_of_text(spark):
    """Texts with one first half share all bands; each kind of second half has its own near ones."""
    rng = np.random.default_rng(8)
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    first = "".join(rng.choice(letters, 560))
    kinds = ["".join(rng.choice(letters, 700)) for _ in range(40)]
    texts = [first + k for k in kinds] + [first + k[:600] + "!" + k[600:] for k in kinds]
    prints = edit_fingerprints.fingerprints(texts)
    rows = spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string")
    found = {r["doc_id"]: r["near_id"] for r in edit_fingerprints.near_documents(rows).collect()}
    assert sum(found.get(40 + i) == i for i in range(40)) >= 39


def test_crowded_bands_take_one_round(spark, monkeypatch):
    """However many kinds of texts share a band, its meetings are verified once."""
    rng = np.random.default_rng(9)
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    first = "".join(rng.choice(letters, 560))
    prints = edit_fingerprints.fingerprints([first + "".join(rng.choice(letters, 700)) for _ in range(60)])
    rounds, verified = [], edit_fingerprints._verified
    monkeypatch.setattr(edit_fingerprints, "_verified", lambda *a: rounds.append(1) or verified(*a))
    rows = spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string")
    edit_fingerprints.near_documents(rows).collect()
    assert len(rounds) == 1


def test_every_two_members_of_a_band_are_compared(spark, monkeypatch):
    """The nearest is that of all earlier documents that share a band, also if a band is compared in parts."""
    rng = np.random.default_rng(21)
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    base, texts = rng.choice(letters, 1_200), []
    for _ in range(150):
        own = base.copy()
        own[rng.integers(0, len(own), 12)] = rng.choice(letters, 12)
        texts.append("".join(own))
    prints = edit_fingerprints.fingerprints(texts)
    bands = [{band for band, _ in edit_fingerprints.bands_of(p, edit_fingerprints.band_places())} for p in prints]
    brute = {}
    for i, partners in brute_partners(prints, edit_fingerprints.LIKE).items():
        if met := [(round(s, 12), -j) for j, s in partners.items() if bands[i] & bands[j]]:
            brute[i] = max(met)
    rows = spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string")
    for part in (4_096, 40):
        monkeypatch.setattr(edit_fingerprints, "PART", part, raising=False)
        found = edit_fingerprints.near_documents(rows).collect()
        assert {r["doc_id"]: (round(r["likeness"], 12), -r["near_id"]) for r in found} == brute and len(brute) > 100


def test_trusted_ids_are_sent_as_lists(spark, monkeypatch):
    """No row per label is broadcast; any number of labels finds the same texts, repeated and missing ids included."""
    docs = [(i % 2_500 if i % 97 else None, f"text {i}", "en", "a", 9) for i in range(4_000)] + [(-7, "below", None, "a", 5)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(i, int(i % 3 > 0), 0) for i in range(3_000)] * 2 + [(None, 1, 0), (-7, 1, 0), (8, None, 0)]
    labels = spark.createDataFrame(labels, LABELS)
    want = Counter((r["text"], r["lang"]) for r in docs.collect() if r["doc_id"] is not None and (r["doc_id"] % 3 or r["doc_id"] == -7))
    sent, broadcast = [], ngram_quality.F.broadcast
    monkeypatch.setattr(ngram_quality.F, "broadcast", lambda df: sent.append(df.count()) or broadcast(df))
    found = ngram_quality.trusted_texts(docs, labels)
    assert found.columns == ["doc_id", "text", "lang"] and Counter((r["text"], r["lang"]) for r in found.collect()) == want
    assert sum(sent) <= 2_001 / 30
    monkeypatch.setattr(ngram_quality, "MOST_IDS", 100)
    assert Counter((r["text"], r["lang"]) for r in ngram_quality.trusted_texts(docs, labels).collect()) == want
    assert ngram_quality.trusted_texts(docs, labels.where("false")).count() == 0


def test_model_is_written_in_small_plans(spark, monkeypatch):
    """What the driver sends out at once follows the exchanges of a plan."""
    exchanges, writer = [], type(spark.range(1).write)
    parquet = writer.parquet

    def counted(self, *args, **options):
        exchanges.append(self._df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return parquet(self, *args, **options)

    monkeypatch.setattr(writer, "parquet", counted)
    found = ngram_quality.model(spark.createDataFrame([("the cat sat on the mat",), ("a cat",)], "text string"))
    runs = [r["run"] for r in found.collect()]
    assert len(runs) == len(set(runs)) and "" in runs and max(map(len, runs)) == ngram_quality.ORDER
    assert max(exchanges) <= 8
