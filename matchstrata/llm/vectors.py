"""What the operators on vectors share: sound vectors, exact integer weights, and arrays packed into one value."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = (1 << 63) - 1


def sound(vector: Column) -> Column:
    """Whether a vector is not null and has no null or non-finite component; false instead of null."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as held:
        return {k: held[k] for k in held.files}


def by_length(lists: pa.Array, dtype: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length the rows of a list column that have it, and their vectors as a matrix."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype), np.cumsum(sizes) - sizes
    return {int(d): (rows := np.flatnonzero(sizes == d), flat[at[rows][:, None] + np.arange(d)]) for d in np.unique(sizes)}


def weights(raw: np.ndarray, scale: int = 256) -> np.ndarray:
    """floor(scale * x) of each component, as a double; exact, as ``scale`` is a power of two."""
    with np.errstate(over="ignore"):
        return np.floor(raw.astype(np.float64) * scale)


def wide(w: np.ndarray) -> np.ndarray:
    """Rows of weights whose inner products may pass what a double holds exactly (2**53)."""
    return np.abs(w).max(axis=1, initial=0) > np.sqrt(2.0**53 / max(1, w.shape[1]))


def integers(raw: np.ndarray, scale: int = 256) -> list[int]:
    """floor(scale * x) of one vector's components as whole numbers of any size."""
    return [int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale)) for x in raw.astype(np.float64).tolist()]


def product(a: list[int], b: list[int]) -> int:
    return sum(x * y for x, y in zip(a, b))


def as_long(score: int) -> int:
    """A score of any size as a long; what a long can't hold becomes its limit."""
    return max(-LONGEST - 1, min(LONGEST, score))
