import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfield.operators.kernel import LocalTopK, RunningTopK


def brute(q, x, ids, k, owners=False):
    """Every distance, sorted: the definition of the answer."""
    out = set()
    for i, row in enumerate(q.astype(np.float64)):
        diff = row - x.astype(np.float64)
        dist = np.add.accumulate(diff * diff, axis=1)[:, -1]
        if owners:
            best = {}
            for d, o in zip(dist.tolist(), ids.tolist()):
                best[o] = min(d, best.get(o, d))
            ranked = sorted((d, o) for o, d in best.items())
        else:
            ranked = sorted(zip(dist.tolist(), ids.tolist()))
        out |= {(i, o, d) for d, o in ranked[:k]}
    return out


def kernel(q, x, ids, k, step, owners=False):
    top = LocalTopK(q, k, owners)
    for at in range(0, len(x), step):
        top.add(x[at : at + step], ids[at : at + step])
        top.flush()
    pos, found, dist = top.result()
    return set(zip(pos.tolist(), found.tolist(), dist.tolist()))


@settings(max_examples=150, deadline=None)
@given(
    seed=st.integers(0, 10_000),
    n=st.integers(1, 120),
    dim=st.integers(1, 20),
    k=st.integers(1, 8),
    step=st.integers(1, 130),
    levels=st.sampled_from([0, 2, 5]),
    scale=st.sampled_from([1e-20, 1.0, 1e6, 1e17]),
    offset=st.sampled_from([0.0, 3.0, 1e4, 1e7]),
    owners=st.booleans(),
)
def test_equals_brute_force(seed, n, dim, k, step, levels, scale, offset, owners):
    """Random vectors, and vectors of few levels so that copies and ties abound."""
    rng = np.random.default_rng(seed)
    draw = rng.integers(0, levels, (n, dim)) if levels else rng.standard_normal((n, dim))
    x = ((draw + offset) * scale).astype(np.float32)
    q = np.concatenate([x[: min(5, n)], ((rng.standard_normal((4, dim)) + offset) * scale).astype(np.float32)])
    ids = rng.integers(0, 4, n) if owners else rng.permutation(n)
    assert kernel(q, x, ids, k, step, owners) == brute(q, x, ids, k, owners)


def test_int8_is_exact():
    rng = np.random.default_rng(3)
    x = rng.integers(-128, 128, (300, 64)).astype(np.int8)
    assert kernel(x[:20], x, np.arange(300), 5, 70) == brute(x[:20], x, np.arange(300), 5)


def test_a_third_of_the_rows_are_copies():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x[::3] = x[0]
    ids = rng.permutation(3000)
    assert kernel(x[:50], x, ids, 5, 1000) == brute(x[:50], x, ids, 5)


def test_outlier_norms_do_not_blur_small_distances():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((500, 8)).astype(np.float32)
    x[7] *= 1e8
    assert kernel(x[:20], x, np.arange(500), 4, 100) == brute(x[:20], x, np.arange(500), 4)


def test_data_far_from_the_origin_is_not_recomputed_whole(monkeypatch):
    from nearfield.operators import kernel as kernel_module

    rng = np.random.default_rng(8)
    x = (rng.standard_normal((4000, 32)) + 500).astype(np.float32)
    pairs = []
    exact = kernel_module.exact_sq
    monkeypatch.setattr(kernel_module, "exact_sq", lambda q, x, qi, xi: pairs.append(len(qi)) or exact(q, x, qi, xi))
    assert kernel(x[:100], x, np.arange(4000), 5, 1000) == brute(x[:100], x, np.arange(4000), 5)
    assert sum(pairs) < 4000 * 100 / 20


def test_text_ids_break_ties_by_code_point():
    x = np.ones((4, 2), np.float32)
    ids = np.array(["b", "a", "é", "Z"], object)
    assert kernel(x[:1], x, ids, 3, 2) == {(0, "Z", 0.0), (0, "a", 0.0), (0, "b", 0.0)}


def test_subset_of_queries():
    x = np.arange(12, dtype=np.float32).reshape(6, 2)
    top = LocalTopK(x, 1)
    top.add(x, np.arange(6), rows=np.array([4, 1]))
    pos, ids, _ = top.result()
    assert sorted(zip(pos.tolist(), ids.tolist())) == [(1, 1), (4, 4)]


def test_running_top_k_keeps_the_smallest():
    top = RunningTopK(1, 2)
    for value in (5.0, 1.0, 3.0, 1.0):
        top.offer(np.array([0]), np.array([int(value * 10) + len(top.pos)]), np.array([value]))
        top.flush()
    assert top.result()[2].tolist() == [1.0, 1.0]


@pytest.mark.parametrize("bad", [np.nan, np.inf])
def test_unsearchable_elements_raise(bad):
    import pyarrow as pa

    from nearfield.operators.kernel import matrix_of

    with pytest.raises(ValueError, match="NaN"):
        matrix_of(pa.array([[1.0, bad]], pa.list_(pa.float32())))
    with pytest.raises(ValueError, match="dimensions"):
        matrix_of(pa.array([[1.0], [1.0, 2.0]], pa.list_(pa.float32())))
    with pytest.raises(ValueError, match="null vector"):
        matrix_of(pa.array([[1.0], None], pa.list_(pa.float32())))


def test_owners_are_folded_among_the_pairs_that_are_left(monkeypatch):
    """once queries have hits, the few pairs that pass meet their owners, not all of them."""
    import types

    from nearfield.operators import kernel as kernel_module

    rng = np.random.default_rng(9)
    x = rng.standard_normal((12_000, 16)).astype(np.float32)
    ids = np.arange(12_000) // 2
    met = []

    class Minimum:
        def reduceat(self, a, *args, **options):
            met.append(a.size)
            return np.minimum.reduceat(a, *args, **options)

    monkeypatch.setattr(kernel_module, "np", types.SimpleNamespace(**{**vars(np), "minimum": Minimum()}))
    assert kernel(x[:60], x, ids, 5, 6000, owners=True) == brute(x[:60], x, ids, 5, owners=True)
    assert sum(met) < 60 * 12_000 / 4


def test_norms_need_no_copy_of_the_queries():
    """a task with a block of queries holds no second one in doubles."""
    import tracemalloc

    rng = np.random.default_rng(10)
    q = rng.standard_normal((200_000, 64)).astype(np.float32)
    tracemalloc.start()
    LocalTopK(q, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90e6  # the queries in doubles alone take 102 MB
