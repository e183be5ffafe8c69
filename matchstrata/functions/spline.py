"""Natural cubic spline bases as plain columns.

The truncated-power form spans the same space as the usual B-spline form with the same knots;
fitted curves and contrasts depend on the span only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _scaled(knots, bounds):
    lo, hi = float(bounds[0]), float(bounds[1])
    xi = [0.0, *[(float(k) - lo) / (hi - lo) for k in knots], 1.0]
    return lo, hi, xi


def spline_columns(x: Column, knots, bounds) -> list[Column]:
    """Basis columns without a constant: len(knots) + 1 of them."""
    lo, hi, xi = _scaled(knots, bounds)
    u = (x - F.lit(lo)) / F.lit(hi - lo)

    def cube(k):
        return F.pow(F.greatest(u - F.lit(k), F.lit(0.0)), 3)

    def d(i):
        return (cube(xi[i]) - cube(xi[-1])) / F.lit(xi[-1] - xi[i])

    last = len(xi) - 2
    cols = [u] + [d(i) - d(last) for i in range(last)]
    return [F.when(x.isNotNull(), c) for c in cols]


def spline_matrix(x, knots, bounds, intercept: bool = False) -> np.ndarray:
    """The same basis on a short grid of numbers (knots, lags, curve grid)."""
    lo, hi, xi = _scaled(knots, bounds)
    u = (np.asarray(x, float) - lo) / (hi - lo)

    def cube(k):
        return np.maximum(u - k, 0.0) ** 3

    def d(i):
        return (cube(xi[i]) - cube(xi[-1])) / (xi[-1] - xi[i])

    last = len(xi) - 2
    cols = [u] + [d(i) - d(last) for i in range(last)]
    if intercept:
        cols.insert(0, np.ones_like(u))
    return np.column_stack(cols)


def lag_basis(max_lag: int, df: int) -> np.ndarray:
    """Lag basis over 0..max_lag with constant: df columns, knots at lag quantiles."""
    lags = np.arange(max_lag + 1)
    knots = np.quantile(lags, np.arange(1, df - 1) / (df - 1))
    return spline_matrix(lags, knots, (0, max_lag), intercept=True)
