"""Scalar expressions shared by the learners."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def log1p_exp(x: Column) -> Column:
    """ln(1 + e^x) without overflow."""
    return F.when(x > 0, x + F.log1p(F.exp(-x))).otherwise(F.log1p(F.exp(x)))


def soft_threshold(x: Column, by: Column | float) -> Column:
    return F.signum(x) * F.greatest(F.lit(0.0), F.abs(x) - by)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def axpy(alpha: float, x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda u, v: u * alpha + v)


def scale(alpha: float, x: Column) -> Column:
    return F.transform(x, lambda u: u * alpha)


def sparse_dot(indices: Column, values: Column, dense: Column) -> Column:
    return F.aggregate(F.zip_with(indices, values, lambda i, v: v * F.element_at(dense, i.cast("int") + 1)), F.lit(0.0), lambda s, x: s + x)


def sum_arrays(column: str, n: int) -> Column:
    """Element-wise sum of arrays of a known length: one plain sum for each place."""
    return F.array(*(F.sum(F.col(column)[k]) for k in range(n)))


def lgamma(x: Column) -> Column:
    """ln Gamma, which Spark lacks: a vectorised function over Arrow batches."""
    f = np.vectorize(math.lgamma, otypes=[float])

    def run(v: pd.Series) -> pd.Series:
        return pd.Series(f(v.to_numpy(float))) if len(v) else v.astype(float)

    return F.pandas_udf(run, "double")(x)


def erfc(x: Column) -> Column:
    f = np.vectorize(math.erfc, otypes=[float])

    def run(v: pd.Series) -> pd.Series:
        return pd.Series(f(v.to_numpy(float))) if len(v) else v.astype(float)

    return F.pandas_udf(run, "double")(x)


def _poly(c: Sequence[float], x):
    out = 0.0 * x
    for a in c:
        out = out * x + a
    return out


# Rational approximations of the normal quantile (published coefficients).
_CENTRE_N = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239]
_CENTRE_D = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0]
_TAIL_N = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
_TAIL_D = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0]


def probit_values(p: np.ndarray) -> np.ndarray:
    """Quantiles of the standard normal; -inf and inf at 0 and 1."""
    p = np.asarray(p, float)
    out = np.full(p.shape, np.nan)
    low, high = (p > 0) & (p < 0.02425), (p > 1 - 0.02425) & (p < 1)
    mid = (p >= 0.02425) & (p <= 1 - 0.02425)
    q = p[mid] - 0.5
    out[mid] = q * _poly(_CENTRE_N, q * q) / _poly(_CENTRE_D, q * q)
    for m, s, t in ((low, 1, p), (high, -1, 1 - p)):
        q = np.sqrt(-2 * np.log(t[m]))
        out[m] = s * _poly(_TAIL_N, q) / _poly(_TAIL_D, q)
    out[p == 0], out[p == 1] = -np.inf, np.inf
    return out


def probit(p: Column) -> Column:
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(probit_values(v.to_numpy(float)))

    return F.pandas_udf(run, "double")(p)
