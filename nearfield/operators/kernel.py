"""In-task top-k kernel: a block of query vectors against batches of corpus vectors.

Runs inside Spark tasks on Arrow batches. One float32 matrix product per batch gives a lower
bound of every squared distance, with a proven rounding margin; only the pairs whose bound can
still reach a query's top k are recomputed exactly. The answer is the exact top k, ties by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_PAIR_BUDGET = 4_000_000  # elements of one product block
_EXACT_BUDGET = 2_000_000  # elements recomputed at once
_FIRST = 1_000  # rows that queries without k owners see first; four times as many each time after that
_GROUPS = 128  # groups of rows whose smallest bounds stand for all, at least 16 for each of k
_OFFERS = 1_000_000  # offers that wait to be folded
_DENSE = 32  # owners are met pair by pair where fewer than one pair in so many is left
_FLOAT32_SAFE = 1e30  # squared norms above this are multiplied in float64


def matrix_of(column: pa.Array | pa.ChunkedArray, dim: int | None = None) -> np.ndarray:
    """A list column as a 2-d array; every row must be present and have the same length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("null vector in a search input; filter with split_valid first")
    rows = len(column)
    lengths = np.diff(column.offsets.to_numpy()) if rows else np.zeros(0, np.int32)
    if dim is None:
        dim = int(lengths[0]) if rows else 0
    if rows and (lengths != dim).any():
        raise ValueError(f"vector dimensions differ: expected {dim}, found {sorted(set(lengths.tolist()))[:5]}")
    values = column.flatten()
    if values.null_count:
        raise ValueError("null element in a vector; filter with split_valid first")
    matrix = values.to_numpy(zero_copy_only=False).reshape(rows, dim)
    if matrix.dtype.kind == "f" and not np.isfinite(matrix).all():
        raise ValueError("NaN or infinite element in a vector; filter with split_valid first")
    return matrix


def ids_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("null id in a search input")
    return column.to_numpy(zero_copy_only=False)


def sq_norms(x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.float64)
    step = max(1, _EXACT_BUDGET // max(1, x.shape[1]))
    for at in range(0, len(x), step):
        wide = x[at : at + step].astype(np.float64)
        out[at : at + step] = np.einsum("ij,ij->i", wide, wide)
    return out


def _true_cells(cells: np.ndarray) -> np.ndarray:
    """Places of the true values of a flat mask with few of them; its length is a multiple of 8."""
    words = np.flatnonzero(cells.view(np.uint64) != 0)
    at = (words[:, None] * 8 + np.arange(8)).ravel()
    return at[cells[at]]


def _order_codes(ids: np.ndarray) -> np.ndarray:
    """Ids as sortable numbers; text ids compare by code point, as Spark compares them."""
    return ids if ids.dtype.kind in "iu" else np.unique(ids, return_inverse=True)[1]


def exact_sq(q: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Squared distances of the given pairs, summed left to right in float64."""
    out = np.empty(len(qi), np.float64)
    step = max(1, _EXACT_BUDGET // max(1, q.shape[1]))
    for at in range(0, len(qi), step):
        diff = q[qi[at : at + step]].astype(np.float64) - x[xi[at : at + step]]
        diff *= diff
        out[at : at + step] = np.add.accumulate(diff, axis=1)[:, -1]
    return out


def _surplus_copies(x: np.ndarray, codes: np.ndarray, k: int) -> np.ndarray:
    """Mask of rows that have at least k exact copies with a smaller id in the same batch.

    Such a row ties with those copies for every query and loses by id, so it is in no top k.
    """
    raw = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    group = np.unique(raw, return_inverse=True)[1]
    order = np.lexsort((codes, group))
    sorted_group = group[order]
    first = np.searchsorted(sorted_group, sorted_group, side="left")
    surplus = np.zeros(len(x), bool)
    surplus[order] = np.arange(len(x)) - first >= k
    return surplus


class RunningTopK:
    """The k best ``(id, value)`` offers of each of m queries, smallest value first, ties by id."""

    def __init__(self, m: int, k: int, per_owner: bool = False):
        self.m, self.k, self.per_owner = m, k, per_owner
        self.tau = np.full(m, np.inf)  # a query with k offers takes nothing above this
        self.pos = np.zeros(0, np.int64)
        self.ids: np.ndarray | None = None
        self.value = np.zeros(0, np.float64)
        self._pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def offer(self, pos: np.ndarray, ids: np.ndarray, value: np.ndarray) -> None:
        if len(pos):
            self._pending.append((pos, ids, value))

    def flush(self) -> None:
        """Fold the offers since the last flush into the running top k."""
        if not self._pending:
            return
        pos = np.concatenate([p for p, _, _ in self._pending])
        ids = np.concatenate([i for _, i, _ in self._pending])
        value = np.concatenate([d for _, _, d in self._pending])
        self._pending.clear()
        touched = np.zeros(self.m, bool)
        touched[pos] = True
        mine = touched[self.pos]
        if self.ids is not None:
            rest_pos, rest_ids, rest_value = self.pos[~mine], self.ids[~mine], self.value[~mine]
            pos = np.concatenate([self.pos[mine], pos])
            ids = np.concatenate([self.ids[mine], ids])
            value = np.concatenate([self.value[mine], value])
        else:
            rest_pos, rest_ids, rest_value = self.pos, ids[:0], self.value
        if self.per_owner:
            codes = _order_codes(ids)
            order = np.lexsort((value, codes, pos))
            same = (np.diff(pos[order]) == 0) & (np.diff(codes[order]) == 0)
            order = order[np.r_[True, ~same]]
            pos, ids, value = pos[order], ids[order], value[order]
        order = np.lexsort((_order_codes(ids), value, pos))
        pos, ids, value = pos[order], ids[order], value[order]
        rank = np.arange(len(pos)) - np.searchsorted(pos, pos, side="left")
        best = rank < self.k
        last = rank == self.k - 1
        self.tau[pos[last]] = value[last]
        self.pos = np.concatenate([rest_pos, pos[best]])
        self.ids = np.concatenate([rest_ids, ids[best]])
        self.value = np.concatenate([rest_value, value[best]])

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(query position, id, value)`` of every kept pair."""
        self.flush()
        return self.pos, self.ids if self.ids is not None else np.zeros(0, np.int64), self.value


class LocalTopK(RunningTopK):
    """The k nearest rows of every query over the batches one task sees, exactly.

    ``per_owner`` ranks owners instead of rows: an owner's distance is that of its nearest row.
    """

    def __init__(self, q: np.ndarray, k: int, per_owner: bool = False):
        super().__init__(len(q), k, per_owner)
        self.q = q
        self.shift = self._common_part(q)
        self.norms = np.empty(len(q), np.float64)
        step = max(1, _EXACT_BUDGET // max(1, q.shape[1]))
        for at in range(0, len(q), step):
            self.norms[at : at + step] = sq_norms(self._near(q[at : at + step]))

    def _near(self, x: np.ndarray) -> np.ndarray:
        return x if self.shift is None else x - self.shift

    @staticmethod
    def _common_part(q: np.ndarray) -> np.ndarray | None:
        """The mean query, if it makes up much of the vectors; distances do not depend on it.

        Taking it off keeps the margin of the product small for data far from the origin. Stored
        elements have at most 24 bits, so doing that in float64 stays within the margin.
        """
        if not len(q) or q.dtype.itemsize > 4:
            return None
        mean = q.mean(axis=0, dtype=np.float64)
        size, common = sq_norms(q).mean(), float(mean @ mean)
        return mean if size < _FLOAT32_SAFE and common > 0.25 * size else None

    def add(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Offer corpus rows to all queries, or to the queries at ``rows``."""
        if not len(x) or not len(self.q) or (rows is not None and not len(rows)):
            return
        # While queries lack owners, a few rows first: their distances keep most of the others out.
        fresh = self.per_owner and np.isinf(self.tau if rows is None else self.tau[rows]).any()
        low, step = 0, _FIRST if fresh else len(x)
        while low < len(x):
            self._add(x[low : low + step], ids[low : low + step], rows)
            low, step = low + step, 4 * step
            if low < len(x):
                self.flush()

    def _add(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray | None) -> None:
        if self.per_owner:
            order = np.argsort(_order_codes(ids), kind="stable")
            x, ids = x[order], ids[order]
        near_x = self._near(x)
        norms = self.norms if rows is None else self.norms[rows]
        tau = self.tau.copy() if rows is None else self.tau[rows]
        x_norms = sq_norms(near_x)
        wide = max(norms.max(), x_norms.max()) > _FLOAT32_SAFE
        dtype, unit = (np.float64, 2.0**-53) if wide else (np.float32, 2.0**-24)
        dim = x.shape[1]
        # |computed - true| <= slack * (|q|² + |x|²) for a product of length dim + 1.
        slack = (2 * dim + 32) * unit
        right = np.empty((dim + 1, len(x)), dtype)
        right[:dim] = near_x.T
        right[dim] = (1 - slack) * x_norms
        drop = None
        step = max(1, (_PAIR_BUDGET // 8 if np.isinf(tau).any() else _PAIR_BUDGET) // len(x))
        # One block of memory for all products and one for all masks, filled up to whole words.
        products = np.empty((min(step, len(norms)), len(x)), dtype)
        masks = np.zeros(-(-products.size // 8) * 8, bool)
        waiting = 0
        for at in range(0, len(norms), step):
            part = slice(at, at + step)
            q = self.q[part] if rows is None else self.q[rows[part]]
            left = np.empty((len(q), dim + 1), dtype)
            np.multiply(self._near(q), dtype(-2), out=left[:, :dim], casting="unsafe", dtype=dtype)
            left[:, dim] = 1
            low = np.matmul(left, right, out=products[: len(q)])
            if low.size < products.size:
                masks[low.size :] = False
            keep = masks[: low.size].reshape(low.shape)
            np.less_equal(low, self._bound(low, norms[part], x_norms, tau[part], slack, ids)[:, None], out=keep)
            n_kept = np.count_nonzero(keep)
            if not self.per_owner and n_kept > 4 * self.k * len(low) + len(x):
                if drop is None:
                    drop = _surplus_copies(x, _order_codes(ids), self.k)
                keep &= ~drop
            if self.per_owner and n_kept * _DENSE > low.size:
                keep &= self._nearest_of_owners(low, norms[part], x_norms, slack, ids)
            cells = _true_cells(masks)
            if self.per_owner and n_kept * _DENSE <= low.size:
                cells = self._nearest_among(cells, low, norms[part], x_norms, slack, ids)
            qi, xi = np.divmod(cells, len(x))
            if not len(qi):
                continue
            dist = exact_sq(q, x, qi, xi)
            qi += at
            near = dist <= tau[qi]
            qi, xi, dist = qi[near], xi[near], dist[near]
            self.offer(qi if rows is None else rows[qi], ids[xi], dist)
            waiting += len(qi)
            if waiting > _OFFERS:
                self.flush()
                waiting = 0

    def _bound(self, low, norms, x_norms, tau, slack, ids) -> np.ndarray:
        """What the lower bound of a pair must not exceed for its query to still accept it."""
        dtype = low.dtype.type
        bound = tau - (1 - slack) * norms
        fresh = ~np.isfinite(tau)
        if fresh.any() and low.shape[1] > self.k:
            upper = low[fresh] + dtype(2 * slack) * x_norms.astype(dtype)
            if self.per_owner:
                upper = np.minimum.reduceat(upper, self._starts(ids), axis=1)
            elif len(x_norms) > 4 * (groups := max(_GROUPS, 16 * self.k)):
                # The k-th smallest of the groups is no less than that of the rows, and seldom more.
                whole = len(x_norms) // groups * groups
                upper = upper[:, :whole].reshape(len(upper), -1, groups).min(axis=1)
            if upper.shape[1] > self.k or not self.per_owner:
                kth = upper.min(axis=1) if self.k == 1 else np.partition(upper, self.k - 1, axis=1)[:, self.k - 1]
                bound[fresh] = kth + 2 * slack * norms[fresh]
        return self._up(bound, dtype)

    @staticmethod
    def _starts(ids) -> np.ndarray:
        return np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])

    def _nearest_of_owners(self, low, norms, x_norms, slack, ids) -> np.ndarray:
        """Pairs that can be the nearest of their owner, of all pairs."""
        dtype = low.dtype.type
        starts = self._starts(ids)
        own = np.minimum.reduceat(low + dtype(2 * slack) * x_norms.astype(dtype), starts, axis=1)
        own = self._up(own + 2 * slack * norms[:, None], dtype)
        return low <= np.repeat(own, np.diff(np.r_[starts, len(ids)]), axis=1)

    def _nearest_among(self, cells, low, norms, x_norms, slack, ids) -> np.ndarray:
        """Of a few pairs, in order, those that can be the nearest of their owner among them."""
        if not len(cells):
            return cells
        qi, xi = np.divmod(cells, len(ids))
        owner = np.cumsum(np.r_[0, ids[1:] != ids[:-1]])[xi]
        value = low.reshape(-1)[cells].astype(np.float64)
        starts = np.flatnonzero(np.r_[True, (np.diff(qi) != 0) | (np.diff(owner) != 0)])
        own = np.minimum.reduceat(value + 2 * slack * x_norms[xi], starts) + 2 * slack * norms[qi[starts]]
        return cells[value <= np.repeat(self._up(own, low.dtype.type), np.diff(np.r_[starts, len(cells)]))]

    @staticmethod
    def _up(bound: np.ndarray, dtype) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.nextafter(bound.astype(dtype), dtype(np.inf))
