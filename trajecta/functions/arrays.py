"""Expressions over the ragged token arrays of one trajectory row.

Reductions and element-wise maps are higher-order functions, so they stay in the JVM and need no
shuffle.  Recurrences (prefix sums, discounted returns) would copy their growing result on every step
inside `aggregate`, so they run as Arrow-batched numpy over the rows of a batch instead.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 1e-8
DOUBLES = T.ArrayType(T.DoubleType())


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def zmap(names: list[str], fn) -> Column:
    """Element-wise map over several array columns of equal length; `fn` gets a struct per token."""
    return F.transform(F.arrays_zip(*names), fn)


def asum(x: Column | str) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda s, v: s + v)


def mask_count(mask: Column | str) -> Column:
    return F.aggregate(_c(mask), F.lit(0), lambda s, v: s + v.cast("int"))


def masked_sum(x: Column | str, mask: Column | str) -> Column:
    return asum(F.zip_with(_c(x), _c(mask), lambda a, m: a * m))


def masked_mean(x: Column | str, mask: Column | str) -> Column:
    return masked_sum(x, mask) / (mask_count(mask) + F.lit(EPS))


def masked_var(x: Column | str, mask: Column | str) -> Column:
    """Bessel-corrected variance over valid tokens; one valid token or none is an error."""
    n = mask_count(mask)
    mean = masked_mean(x, mask)
    centred = F.zip_with(_c(x), _c(mask), lambda a, m: (a - mean) * (a - mean) * m)
    return F.when(n <= 1, F.raise_error(F.lit("variance needs at least two valid tokens")).cast("double")).otherwise(
        asum(centred) / (n + F.lit(EPS)) * n / (n - 1)
    )


def masked_extreme(x: Column | str, mask: Column | str, largest: bool) -> Column:
    """Largest or smallest valid element; NULL when nothing is valid."""
    kept = F.zip_with(_c(x), _c(mask), lambda v, m: F.when(m > 0, v))
    return F.array_max(kept) if largest else F.array_min(kept)


def masked_values(x: str, mask: str) -> Column:
    return F.transform(F.filter(F.arrays_zip(x, mask), lambda t: t[mask] > 0), lambda t: t[x])


def clamp(x: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        x = F.greatest(x, F.lit(float(low)))
    if high is not None:
        x = F.least(x, F.lit(float(high)))
    return x


def spread(scalar: Column, mask: Column | str) -> Column:
    """A per-row scalar laid over the response mask."""
    return F.transform(_c(mask), lambda m: scalar * m)


def place_last(score: Column, length: Column) -> Column:
    """A score array that is zero except at the last of `length` tokens."""
    idx = F.when(length > 0, F.sequence(F.lit(1), length)).otherwise(F.array().cast("array<int>"))
    return F.transform(idx, lambda i: F.when(i == length, score).otherwise(F.lit(0.0)))


def any_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols)


# --- recurrences -----------------------------------------------------------------------------------


CELLS = 2_000_000  # cells of one padded table


def _pieces(column: pd.Series) -> list[np.ndarray]:
    """Row positions in pieces of alike length, none of which pads to more than CELLS (or one row)."""
    lengths = np.array([0 if row is None else len(row) for row in column], dtype="int64")
    order, out, start = np.argsort(lengths, kind="stable"), [], 0
    for stop in range(1, len(order) + 1):
        if stop == len(order) or (stop - start + 1) * lengths[order[stop]] > CELLS:
            out.append(order[start:stop])
            start = stop
    return out


def _by_piece(scan, *columns: pd.Series) -> pd.Series:
    """`scan` over pieces of the batch, put back into row order; memory follows the cells, not the widest row."""
    out = np.empty(len(columns[0]), dtype=object)
    for piece in _pieces(columns[0]):
        rows = scan(*[c.iloc[piece].reset_index(drop=True) for c in columns])
        for at, row in zip(piece, rows):
            out[at] = row
    return pd.Series(out)


def _padded(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, row in enumerate(column):
        if row is not None:
            out[i, : len(row)] = row
    return out


def _width(column: pd.Series) -> int:
    return max((0 if row is None else len(row) for row in column), default=0)


def _ragged(table: np.ndarray, like: pd.Series) -> pd.Series:
    return pd.Series([None if row is None else table[i, : len(row)] for i, row in enumerate(like)])


def _running(column: pa.Array, backwards: bool) -> pa.Array:
    """Prefix (or suffix) sums of each list; lists of one length are summed together, in the order of a single one.

    A sum that is not a number is null.
    """
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype("int64")
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    out = np.empty_like(values)
    for n in np.unique(lengths[lengths > 0]):
        cells = (ends - n)[lengths == n][:, None] + (np.arange(n)[::-1] if backwards else np.arange(n))
        out[cells] = np.cumsum(values[cells], axis=1)
    offsets = np.concatenate([[0], ends]).astype("int32")
    none = column.is_null() if column.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out, from_pandas=True), mask=none)


@F.arrow_udf(DOUBLES)
def cumsum(x: pa.Array) -> pa.Array:
    return _running(x, False)


@F.arrow_udf(DOUBLES)
def reverse_cumsum(x: pa.Array) -> pa.Array:
    return _running(x, True)


@F.pandas_udf(DOUBLES)
def discounted_with_reset(rewards: pd.Series, mask: pd.Series, gamma: pd.Series) -> pd.Series:
    """R = r + gamma * R from the right; the carried value is zeroed after a masked-out token."""
    return _by_piece(_discounted, rewards, mask, gamma)


def _discounted(rewards: pd.Series, mask: pd.Series, gamma: pd.Series) -> pd.Series:
    width = _width(rewards)
    r, m, g = _padded(rewards, width), _padded(mask, width), gamma.to_numpy(dtype="float64")
    out, carry = np.zeros_like(r), np.zeros(len(r))
    for t in range(width - 1, -1, -1):
        out[:, t] = r[:, t] + g * carry
        carry = out[:, t] * m[:, t]
    return _ragged(out, rewards)


@F.pandas_udf(DOUBLES)
def gae_scan(rewards: pd.Series, values: pd.Series, mask: pd.Series, gamma: pd.Series, lam: pd.Series) -> pd.Series:
    """Generalised advantages from the right; a masked-out token hands both carried values through."""
    return _by_piece(_gae, rewards, values, mask, gamma, lam)


def _gae(rewards: pd.Series, values: pd.Series, mask: pd.Series, gamma: pd.Series, lam: pd.Series) -> pd.Series:
    width = _width(rewards)
    r, v, m = _padded(rewards, width), _padded(values, width), _padded(mask, width)
    g, decay = gamma.to_numpy(dtype="float64"), (gamma * lam).to_numpy(dtype="float64")
    out, next_value, last = np.zeros_like(r), np.zeros(len(r)), np.zeros(len(r))
    for t in range(width - 1, -1, -1):
        step = r[:, t] + g * next_value - v[:, t] + decay * last
        valid = m[:, t] > 0
        last = np.where(valid, step, last)
        next_value = np.where(valid, v[:, t], next_value)
        out[:, t] = last
    return _ragged(out, rewards)
