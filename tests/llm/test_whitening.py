import math

import numpy as np
import pytest

from nearfield.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n string, block string, x string"


def brute(rows, k):
    """Everything from one matrix in memory; eigenvectors by singular values of the centred rows."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for _, v in kept]
    fit = np.array(sorted(set(x)), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = np.array((n * fit - sums) / n, float)
    _, s, vt = np.linalg.svd(centred / math.sqrt(n))
    deviation = [int(sum((n * a - b) ** 2 for a, b in zip(v, sums))) for v in x]
    whitened = [np.array([float(n * a - b) / n for a, b in zip(v, sums)]) @ vt[:k].T / s[:k] for v in x]
    return kept, n, deviation, whitened, s**2 / (s**2).sum()


@pytest.mark.parametrize("block", [2_048, 7])
def test_whitening_equals_one_matrix(spark, block):
    rng = np.random.default_rng(1)
    scale = np.array([3.0, 2.0, 1.5, 1.0, 0.8])
    rows = [(i, (rng.normal(size=5) * scale + 4).astype("f4").tolist()) for i in range(90)]
    rows += [(200 + i, rows[3][1]) for i in range(40)] + [(5, rows[5][1]), (None, rows[6][1])]
    rows += [(300, None), (301, [1.0, None, 1.0, 1.0, 1.0]), (302, [math.nan] * 5), (303, [math.inf, 0.0, 0.0, 0.0, 0.0])]
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(5)
    got = whitening.whiten(docs, components=3, block_rows=block).collect()
    kept, n, deviation, whitened, explained = brute(rows, 3)
    assert len(got) == 3 * len(kept) and {r["n"] for r in got} == {n}
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    by = lambda c: sorted((str(r["vec_id"]), r["deviation"], r["whitened"]) for r in got if r["component"] == c)
    for c in (1, 2, 3):
        want = sorted((str(i), d, w[c - 1]) for (i, _), d, w in zip(kept, deviation, whitened))
        sign = 1 if np.dot([w[2] for w in want], [g[2] for g in by(c)]) > 0 else -1
        want = sorted((i, d, sign * w) for i, d, w in want)
        assert [g[:2] for g in by(c)] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in by(c)], [w[2] for w in want], atol=1e-9)
        assert math.isclose({r["explained"] for r in got if r["component"] == c}.pop(), explained[c - 1], rel_tol=1e-9)


def test_no_variance_and_no_rows(spark):
    rows = [(i, [float(i % 3), 2.0, float(i % 3)], "", "", "", "") for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 27 and all((r["whitened"] is None) == (r["component"] > 1) for r in got)
    assert got[0]["identity_error"] < 1e-9 and got[0]["n"] == 3
    same = whitening.whiten(spark.createDataFrame(rows[:1] * 4, SCHEMA)).collect()
    assert len(same) == 12 and all(r["whitened"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in same)
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, "", "", "", "")], SCHEMA)).count() == 0


@pytest.mark.parametrize("bad", [[1.0], [], [3e38, 0.0]])
def test_what_can_not_be_one_matrix_raises(spark, bad):
    rows = spark.createDataFrame([(1, [1.0, 2.0], "", "", "", ""), (2, bad, "", "", "", "")], SCHEMA)
    with pytest.raises(Exception, match="dimension|long"):
        whitening.whiten(rows).count()
