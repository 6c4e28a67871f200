"""Toxicity: a logistic classifier with counterfactual regularisation.

Features are the words of a text (lower case, without punctuation at the ends) and the prefixes of
longer words, present or not. Spark counts them over labelled rows by label and picks the
vocabulary; the fit adds a penalty on the change of a text's score when its identity terms are
swapped for another of their group, so a mere mention of a group says nothing. The fit sees at most
``MAX_ROWS`` labelled rows, a hash sample; scoring goes over every text in one pass without a
shuffle, the model being at most ``VOCABULARY`` weights.

Defined results: a null or empty text scores the intercept alone. Labels that are null are not
learnt from; a document with several labels counts once for each. Without labels of both kinds
every score is the share of toxic labels (0 without any). Repeated rows score alike. Extra columns
are not read.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import guarded_join
from nearfield.session import staged

FOLDS = 5
MAX_ROWS = 20_000
VOCABULARY = 512
#: A feature counts from this many labelled texts on, or from one in RARE of them if that is more.
MIN_DOCS = 4
RARE = 400
#: Weight of a toxic text in the loss; they are the fewer.
TOXIC_WEIGHT = 2.0
PREFIXES = (4, 5, 6)
CACHE = 500_000
ENDS = "\"'`.,;:!?()[]{}<>|*#$%&-_/\\…«»“”„¿¡"

#: Identity terms by group; within a group any term may stand for another. Fixed values.
IDENTITY = (
    "woman man girl boy female male transgender",
    "women men girls boys females males",
    "muslim christian jewish hindu buddhist atheist catholic",
    "muslims christians jews hindus buddhists atheists catholics",
    "black white asian latino african european",
    "gay lesbian bisexual straight queer homosexual",
    "immigrant refugee foreigner native migrant",
    "immigrants refugees foreigners natives migrants",
    "frau mann mädchen junge",
    "frauen männer",
    "femme homme fille garçon",
    "femmes hommes filles garçons",
    "mujer hombre niña niño",
    "mujeres hombres niñas niños",
)


def swaps(groups: tuple[str, ...] = IDENTITY) -> dict[str, str]:
    """Each identity term and the next one of its group."""
    rings = [g.split() for g in groups]
    return {term: ring[(i + 1) % len(ring)] for ring in rings for i, term in enumerate(ring)}


def features_of(word: str) -> list[str]:
    """The features of one word as it stands in a text."""
    word = word.lower().strip(ENDS)
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)] if word else []


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by feature and label, summed per task in bounded steps."""

    def flush() -> pa.RecordBatch:
        keys = list(found)
        values = [found[k] for k in keys]
        found.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array(values, pa.int64())],
            ["feature", "toxic", "n"],
        )

    found: Counter = Counter()
    for batch in batches:
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
            own = {f for w in set((text or "").split()) for f in features_of(w)}
            found.update((f, toxic) for f in own)
            if len(found) > CACHE:
                yield flush()
    yield flush()


def vocabulary(train: DataFrame, size: int = VOCABULARY, min_docs: int = MIN_DOCS) -> list[str]:
    """The features whose presence tells most about the label, and every identity term."""
    rows = train.agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n")).first()
    share = (rows["pos"] or 0) / max(1, rows["n"])
    counted = train.mapInArrow(_counts, "feature string, toxic bigint, n bigint")
    of = lambda t: F.sum(F.when(F.col("toxic") == t, F.col("n")).otherwise(0))
    by_feature = counted.groupBy("feature").agg(of(1).alias("pos"), of(0).alias("neg"))
    by_feature = by_feature.where(F.col("pos") + F.col("neg") >= max(min_docs, rows["n"] // RARE))
    # How many standard errors the feature's share of toxic texts lies off the overall share.
    seen = F.col("pos") + F.col("neg")
    off = F.abs(F.col("pos") - share * seen) / F.sqrt(F.lit(max(share * (1 - share), 1e-9)) * seen)
    picked = by_feature.orderBy(off.desc(), "feature").limit(size).select("feature").collect()
    return sorted({r["feature"] for r in picked} | set(swaps()))


def _encode(batches: Iterator[pa.RecordBatch], index: dict[str, int], swap: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """Vocabulary places present in each text, and in the text with its identity terms swapped."""
    for batch in batches:
        own, other = [], []
        for text in batch["text"].to_pylist():
            words = {w.lower().strip(ENDS) for w in (text or "").split()}
            own.append(sorted({index[f] for w in words for f in features_of(w) if f in index}))
            swapped = {swap.get(w, w) for w in words} if not words.isdisjoint(swap) else None
            other.append(sorted({index[f] for w in swapped for f in features_of(w) if f in index}) if swapped else own[-1])
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(own, kind), pa.array(other, kind), batch["toxic"]], ["own", "other", "toxic"])


def fit(rows: pd.DataFrame, size: int, penalty: float, ridge: float = 2e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept: log loss, ridge, and the squared score change under swaps (Adam)."""
    y = rows["toxic"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return np.zeros(size), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))

    def sparse(column: str) -> tuple[np.ndarray, np.ndarray]:
        lengths = rows[column].map(len).to_numpy()
        flat = np.concatenate([np.asarray(v, np.int64) for v in rows[column]]) if lengths.sum() else np.zeros(0, np.int64)
        return np.repeat(np.arange(len(rows)), lengths), flat

    own, other = sparse("own"), sparse("other")
    n = len(y)
    weight = np.where(y > 0, TOXIC_WEIGHT, 1.0)
    weight *= n / weight.sum()
    w, b = np.zeros(size), float(np.log(y.mean() / (1 - y.mean())))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    score = lambda at: np.bincount(at[0], w[at[1]], n) + b
    back = lambda at, d: np.bincount(at[1], d[at[0]], size)
    for t in range(1, rounds + 1):
        z, z2 = score(own), score(other)
        change = 2 * penalty * (z - z2) / n
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        grad = np.append(back(own, error + change) - back(other, change) + ridge * w, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def _score(batches: Iterator[pa.RecordBatch], weights: dict[str, float], index: dict[str, int], bias: float) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple[int, ...]] = {}
    table = np.zeros(len(index))
    for f, i in index.items():
        table[i] = weights[f]
    for batch in batches:
        scores = []
        for text in batch["text"].to_pylist():
            words = set((text or "").split())
            if len(known) > CACHE:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = tuple(index[f] for f in features_of(w) if f in index)
            present = set().union(*[known[w] for w in words])
            scores.append(bias + float(table[sorted(present)].sum()))
        score = 1 / (1 + np.exp(-np.clip(np.array(scores, float), -30, 30)))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score, pa.float64())], ["doc_id", "score"])


class Model:
    """Weights of the vocabulary, an intercept, and the scoring pass."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, score) of every text."""
        kept = {f: w for f, w in self.weights.items() if w}
        index = {f: i for i, f in enumerate(sorted(kept))}
        run = functools.partial(_score, weights=kept, index=index, bias=self.bias)
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")


def held_out(doc_id: str = "doc_id", folds: int = FOLDS):
    """Whether a row's labels are kept from the fit; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, penalty: float = 1.0, max_rows: int = MAX_ROWS, size: int = VOCABULARY) -> Model:
    """Fit on labelled documents outside the held-out fold."""
    marked = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out()).select("doc_id", F.col("toxic").cast("long").alias("toxic"))
    share = min(1.0, max_rows / max(1, marked.count()))
    # The sample is a range of a hash of the id, so reruns and retried tasks agree.
    marked = marked.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = guarded_join(docs.select("doc_id", "text"), marked, ["doc_id"], "inner", salt=F.col("text"))
    rows = staged(rows.select("text", "toxic"), "toxic-train")
    features = vocabulary(rows, size)
    index = {f: i for i, f in enumerate(features)}
    coded = rows.mapInArrow(functools.partial(_encode, index=index, swap=swaps()), "own array<int>, other array<int>, toxic bigint")
    # At most max_rows rows of at most a few hundred places each: the bound of the sample. The
    # order makes the sums of the fit the same on every run.
    coded = coded.toPandas()
    coded = coded.assign(key=[(*a, -1, *b) for a, b in zip(coded["own"], coded["other"])]).sort_values(["toxic", "key"])
    weights, bias = fit(coded, len(features), penalty)
    return Model(dict(zip(features, weights.tolist())), float(bias))
