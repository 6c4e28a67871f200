"""The toxicity classifier, vocabulary, fit and scores, over again in dense matrices."""

import random
import zlib

import numpy as np

from nearfield.llm import toxicity

ENDS = toxicity.ENDS


def words_of(text):
    return {w.lower().strip(ENDS) for w in (text or "").split()} - {""}


def features(words):
    return {f for w in words for f in (w, *(w[:n] + "*" for n in (4, 5, 6) if len(w) > n))}


def rows():
    rng = random.Random(6)
    plain = [f"w{c}{i}" for i in range(60) for c in ("ord", "a")]
    found = []
    for i in range(600):
        bad = rng.random() < 0.2
        words = [rng.choice(plain) for _ in range(rng.randrange(3, 25))]
        words += ["Idiots,", "worthless"][: rng.randrange(1, 3)] if bad else ["fine."] * rng.randrange(2)
        words += [rng.choice(["women", "men", "Muslim", "straight"])] if rng.random() < (0.6 if bad else 0.2) else []
        rng.shuffle(words)
        found.append((i, " ".join(words), int(bad)))
    return found


def dense_fit(train, penalty=1.0):
    own = [features(words_of(t)) for _, t, _ in train]
    y = np.array([b for *_, b in train], float)
    n, share = len(y), y.mean()
    seen, pos = {}, {}
    for fs, b in zip(own, y):
        for f in fs:
            seen[f], pos[f] = seen.get(f, 0) + 1, pos.get(f, 0) + b
    off = {f: abs(pos[f] - share * c) / np.sqrt(share * (1 - share) * c) for f, c in seen.items() if c >= max(4, n // 400)}
    swap = toxicity.swaps()
    vocabulary = sorted({*sorted(off, key=lambda f: (-off[f], f))[:512], *swap})
    place = {f: i for i, f in enumerate(vocabulary)}
    matrix = lambda texts: np.array([[f in fs for f in vocabulary] for fs in texts], float)
    x = matrix(own)
    x2 = matrix([features({swap.get(w, w) for w in words_of(t)}) for _, t, _ in train])
    weight = np.where(y > 0, 2.0, 1.0)
    weight *= n / weight.sum()
    w, b = np.zeros(len(place)), np.log(share / (1 - share))
    first, second = np.zeros(len(place) + 1), np.zeros(len(place) + 1)
    for t in range(1, 401):
        z = x @ w + b
        error = weight * (1 / (1 + np.exp(-z)) - y) / n
        slope = np.append(x.T @ error + (x - x2).T @ (2 * penalty * ((x - x2) @ w) / n) + 2e-4 * w, error.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        step = 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return dict(zip(vocabulary, w)), b


def test_model_and_scores_equal_dense_matrices(make, spark):
    table = rows()
    docs = make([(i, t, "en", "a", 1) for i, t, _ in table])
    labels = spark.createDataFrame([(i, 1, b) for i, _, b in table], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    weights, bias = dense_fit([r for r in table if not held(r[0])])
    assert model.weights.keys() == weights.keys()
    assert np.allclose([model.weights[f] for f in weights], list(weights.values()), atol=1e-4) and abs(model.bias - bias) < 1e-4
    scores = {r["doc_id"]: r["score"] for r in model.score(docs).collect()}
    right = 0
    for i, text, bad in table:
        z = bias + sum(weights[f] for f in features(words_of(text)) if f in weights)
        assert abs(scores[i] - 1 / (1 + np.exp(-z))) < 1e-4
        right += held(i) and (scores[i] >= 0.5) == bad
    assert right >= 0.95 * sum(held(i) for i, *_ in table)
