"""Column expressions over embedding arrays: parsing, validation, distance, int8 quantization."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_floats(text: Column, via_double: bool = True, sep: str = ",") -> Column:
    """Delimited numbers to ``array<float>``; an element that is no number becomes null.

    ``via_double`` narrows from double, which may differ from a direct float parse by one ulp.
    """
    parts = F.split(text, sep, -1)
    if via_double:
        return F.transform(parts, lambda x: x.try_cast("double").cast("float"))
    return F.transform(parts, lambda x: x.try_cast("float"))


def format_floats(vector: Column, sep: str = ",") -> Column:
    """Comma-joined elements in the shortest form that parses back to the same float.

    A null element is written as ``null``, which parses back to null.
    """
    return F.concat_ws(sep, F.transform(vector.cast("array<string>"), lambda x: F.coalesce(x, F.lit("null"))))


def to_float(vector: Column) -> Column:
    return vector.cast("array<float>")


def is_valid(vector: Column, dim: int | None = None) -> Column:
    """True for a vector that can be searched: present, not empty, all elements finite."""
    low, high = F.array_min(vector).cast("double"), F.array_max(vector).cast("double")
    ok = (
        vector.isNotNull()
        & (F.size(vector) > 0)
        & (F.size(F.array_compact(vector)) == F.size(vector))
        & ~F.isnan(high)
        & (high < float("inf"))
        & (low > float("-inf"))
    )
    if dim is not None:
        ok = ok & (F.size(vector) == dim)
    return F.coalesce(ok, F.lit(False))


def split_valid(df: DataFrame, vector_col: str = "vector", dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(accepted rows, rejected rows)``; both lazy, together they are the whole input."""
    ok = is_valid(F.col(vector_col), dim)
    return df.filter(ok), df.filter(~ok)


def l2_sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two vectors in a row, summed in double.

    For given pairs only, such as the hits of a search. Searching a corpus is ``operators.knn``.
    """
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    total = F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)
    same = F.size(a) == F.size(b)
    return F.when(same, total).otherwise(F.raise_error(F.lit("vector dimensions differ")).cast("double"))


def l2_sq_int8(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two int8 vectors, exact in bigint."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("long") - y.cast("long")) * (x.cast("long") - y.cast("long")))
    total = F.aggregate(squares, F.lit(0).cast("long"), lambda acc, x: acc + x)
    same = F.size(a) == F.size(b)
    return F.when(same, total).otherwise(F.raise_error(F.lit("vector dimensions differ")).cast("long"))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_sq(a, b))


def score(dist_sq: Column) -> Column:
    """Similarity of a hit, ``1 / (1 + d²)``: 1 for the same vector, falling towards 0."""
    return F.lit(1.0) / (F.lit(1.0) + dist_sq.cast("double"))


def quantize_int8(vector: Column, vmin: Column, vmax: Column, overflow: str = "clamp") -> Column:
    """Map ``[vmin, vmax]`` linearly onto the 256 int8 values, in float32 like the stored data.

    Values outside the bounds are clamped to -128 and 127, or wrap around a byte with
    ``overflow="wrap"``. Equal bounds give all zeros. Half rounds up.
    """
    _check_overflow(overflow)
    lo, span = vmin.cast("float"), vmax.cast("float") - vmin.cast("float")

    def one(v: Column) -> Column:
        unit = ((v.cast("float") - lo) / span).cast("float")
        level = F.floor((unit * F.lit(255.0).cast("float")).cast("double") + F.lit(0.5))
        if overflow == "clamp":
            return F.greatest(F.lit(-128), F.least(F.lit(127), level - 128)).cast("tinyint")
        int_level = F.greatest(F.lit(-2147483648), F.least(F.lit(2147483647), level))
        return (F.pmod(int_level, F.lit(256)) - 128).cast("tinyint")

    zeros = F.transform(vector, lambda v: F.lit(0).cast("tinyint"))
    return F.when(vmin == vmax, zeros).otherwise(F.transform(vector, one))


def _check_overflow(overflow: str) -> None:
    if overflow not in ("clamp", "wrap"):
        raise ValueError(f"overflow must be 'clamp' or 'wrap', not {overflow!r}")


def quantize_int8_batches(vector: Column, vmin: Column, vmax: Column, overflow: str = "clamp") -> Column:
    """``quantize_int8`` on Arrow batches: the same values, several times faster on long vectors.

    Array lambdas run element by element; here a batch is a handful of array operations. Only
    the vector column goes through Python.
    """
    _check_overflow(overflow)

    @F.arrow_udf("array<tinyint>")
    def quantize(vectors: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
        counts = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
        values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
        lo, hi = (c.to_numpy(zero_copy_only=False).astype(np.float32) for c in (low, high))
        if len(lo) and (lo == lo[0]).all() and (hi == hi[0]).all():
            lo, hi = lo[0], hi[0]  # one scale for the batch, the usual case
        else:
            lo, hi = np.repeat(lo, counts), np.repeat(hi, counts)
        with np.errstate(all="ignore"):
            unit = (values - lo) / (hi - lo) * np.float32(255)
            level = np.floor(unit)
            level += unit - level >= 0.5  # half rounds up; the difference is exact
            if overflow == "clamp":
                level = np.clip(np.nan_to_num(level, copy=False) - 128, -128, 127)
            else:
                wide = np.clip(np.nan_to_num(level), -(2.0**31), 2.0**31 - 1, dtype=np.float64)
                level = np.mod(wide, 256) - 128
        out = np.where(lo == hi, 0, level).astype(np.int8)
        offsets = pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(out), mask=vectors.is_null() if vectors.null_count else None)

    return quantize(vector, vmin.cast("float"), vmax.cast("float"))


def megabytes(n_bytes: Column) -> Column:
    """Whole MiB in a byte count."""
    return F.floor(n_bytes / F.lit(1048576)).cast("long")
