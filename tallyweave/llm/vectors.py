"""Vector columns as arrays, rotations fitted from summed second moments, and balanced blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import summed

#: Lengths of vectors that get a rotation of their own, and the longest of them; the rest keep their axes (exact, less pruning).
MAX_ROTATIONS, MAX_ROTATED = 16, 1024


def usable(col: pa.Array) -> np.ndarray:
    """Which vectors are neither null nor hold a null or non-finite component."""
    ok = np.asarray(col.is_valid())
    values = col.flatten()
    good = np.isfinite(values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
    lengths = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(col)), lengths)
    return ok & (np.bincount(rows, ~good, len(col)) == 0)


def matrix(lists: pd.Series) -> np.ndarray:
    return np.stack(lists.to_numpy()).astype(float) if len(lists) else np.zeros((0, 0))


def by_length(col: pa.Array, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix of doubles) for each length of vector among ``rows``, which hold no nulls."""
    own = col.take(pa.array(rows))
    n = own.value_lengths().to_numpy(zero_copy_only=False)
    flat = own.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    begin = np.concatenate(([0], np.cumsum(n)))[:-1]
    for d in np.unique(n[n > 0]):
        at = np.flatnonzero(n == d)
        yield rows[at], flat[begin[at][:, None] + np.arange(d)]


def lists(x: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1])), pa.array(np.ascontiguousarray(x).ravel()))


def rotations(rows: DataFrame, vector: str = "v") -> dict[int, np.ndarray]:
    """For each length of vector, the orthogonal axes in order of descending second moment.

    rows holds ``dim`` and ``vector``. Only a dim x dim sum for each length reaches the driver."""
    dims = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(MAX_ROTATIONS).collect()
    found = {}
    for d in (r.dim for r in dims if 0 < r.dim <= MAX_ROTATED):

        def moment(b: pa.RecordBatch, d: int = d) -> np.ndarray:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
            return (x.T @ x).ravel()

        total = summed(rows.where(F.col("dim") == d).select(vector), moment, d * d).reshape(d, d)
        found[d] = np.linalg.eigh(total)[1][:, ::-1]
    return found


def blocked(rows: DataFrame, group: list[str], key: str, most: int) -> DataFrame:
    """rows with ``salt``: groups of more than ``most`` rows are dealt into so many parts by a hash of ``key``."""
    sizes = rows.groupBy(*group).agg(F.ceil(F.count("*") / most).cast("long").alias("parts"))
    joined = rows.join(sizes, group)
    return joined.withColumn("salt", F.pmod(F.xxhash64(key), F.col("parts"))).drop("parts")


def dimension_steps(d: int) -> Iterator[tuple[int, int]]:
    """Leading dimensions first: 16, then doubling."""
    lo, hi = 0, min(16, d)
    while lo < d:
        yield lo, hi
        lo, hi = hi, min(2 * hi, d)


def suffix_norms(x: np.ndarray) -> np.ndarray:
    """Column j: the norm of the components from j on; one column more than x."""
    out = np.zeros((len(x), x.shape[1] + 1))
    out[:, :-1] = np.sqrt(np.cumsum((x**2)[:, ::-1], axis=1)[:, ::-1])
    return out
