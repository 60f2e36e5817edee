"""Tails of the normal, Student, F and chi-squared distributions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Acklam's rational approximation of the inverse of the normal tail.
ACKLAM_A = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239)
ACKLAM_B = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0)
ACKLAM_C = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
ACKLAM_D = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416, 1.0)
#: p values are kept within these before they become z values.
LEAST_P, MOST_P = 1e-300, 1 - 1e-16


def norm_sf(z: Column) -> Column:
    """The upper tail of the normal distribution, in Arrow batches: below 0 as digits after 1, above with a relative error under 1e-13 as far as doubles reach; NaN and null stay."""

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return pd.Series(_tail(z.to_numpy(dtype=float, na_value=np.nan)))

    x = z.cast("double")
    return F.when(x.isNotNull(), tail(x))


def norm_isf(p: Column) -> Column:
    """The z of an upper tail p, in Arrow batches: a rational approximation and one step of refinement; infinite at 0 and 1."""

    @F.pandas_udf("double")
    def inverse(p: pd.Series) -> pd.Series:
        x = p.to_numpy(dtype=float, na_value=np.nan)
        low = np.minimum(x, 1 - x)
        with np.errstate(all="ignore"):
            q, mid = np.sqrt(-2 * np.log(low)), 0.5 - low
            near = mid * np.polyval(ACKLAM_A, mid * mid) / np.polyval(ACKLAM_B, mid * mid)
            z = np.where(low < 0.02425, -np.polyval(ACKLAM_C, q) / np.polyval(ACKLAM_D, q), near)
            # the step is taken on the smaller tail, which keeps its digits
            step = (_tail(z) - low) * math.sqrt(2 * math.pi) / np.exp(-z * z / 2)
            fine = np.where(np.isfinite(step) & (z < 37), z + step / (1 + z * step / 2), z)
        return pd.Series(np.where(x <= 0, np.inf, np.where(x >= 1, -np.inf, np.sign(0.5 - x) * fine)))

    return inverse(p.cast("double"))


def z_score(p: Column) -> Column:
    """The z of a p value kept within LEAST_P and MOST_P; 0 for null or NaN."""
    return F.when(p.isNull() | F.isnan(p), 0.0).otherwise(norm_isf(F.least(F.greatest(p, F.lit(LEAST_P)), F.lit(MOST_P))))


_lgamma = np.vectorize(math.lgamma, otypes=[float])
_tail = np.vectorize(lambda z: math.erfc(z / math.sqrt(2)) / 2, otypes=[float])


def beta_tail(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function I_x(a, b), by its continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
        c, d = np.ones_like(y), 1 / (1 - (p + q) * y / (p + 1))
        h = d.copy()
        for m in range(1, 400):
            for top in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d, c = 1 / (1 + top * d), 1 + top / c
                h *= d * c
            if np.all(np.abs(d * c - 1) < 1e-15):
                break
        out = np.where(y <= 0, 0.0, np.where(y >= 1, 1.0, front * h))
    return np.where(flip, 1 - out, out)


def t_sf(t: Column, dof: Column) -> Column:
    """The upper tail of Student's distribution, in Arrow batches; 0.5 for null or NaN."""

    @F.pandas_udf("double")
    def tail(t: pd.Series, dof: pd.Series) -> pd.Series:
        x, n = t.to_numpy(dtype=float, na_value=np.nan), dof.to_numpy(dtype=float, na_value=np.nan)
        good = ~np.isnan(x) & ~np.isnan(n) & (n > 0)
        x, n = np.where(good, x, 0.0), np.where(good, n, 1.0)
        with np.errstate(all="ignore"):
            half = beta_tail(n / 2, np.full_like(n, 0.5), np.where(np.isinf(x), 0.0, n / (n + x * x))) / 2
        return pd.Series(np.where(good, np.where(x >= 0, half, 1 - half), 0.5))

    return tail(t.cast("double"), dof.cast("double"))


def f_sf(f: Column, dfn: Column, dfd: Column) -> Column:
    """The upper tail of the F distribution, in Arrow batches; 0.5 for null or NaN, 1 below 0."""

    @F.pandas_udf("double")
    def tail(f: pd.Series, dfn: pd.Series, dfd: pd.Series) -> pd.Series:
        x, m, n = (v.to_numpy(dtype=float, na_value=np.nan) for v in (f, dfn, dfd))
        good = ~(np.isnan(x) | np.isnan(m) | np.isnan(n)) & (m > 0) & (n > 0)
        x, m, n = np.where(good, np.maximum(x, 0), 0.0), np.where(good, m, 1.0), np.where(good, n, 1.0)
        with np.errstate(all="ignore"):
            out = beta_tail(n / 2, m / 2, np.where(np.isinf(x), 0.0, n / (n + m * x)))
        return pd.Series(np.where(good, out, 0.5))

    return tail(f.cast("double"), dfn.cast("double"), dfd.cast("double"))


def chi2_sf_even(x: Column, dof: int) -> Column:
    """The upper tail of the chi-squared distribution for an even number of degrees of freedom, in closed form."""
    if dof % 2:
        raise ValueError("the closed form takes even degrees of freedom")
    term, total = F.lit(1.0), F.lit(1.0)
    for k in range(1, dof // 2):
        term = term * x / (2.0 * k)
        total = total + term
    return F.when(x <= 0, 1.0).otherwise(F.exp(-x / 2) * total)
