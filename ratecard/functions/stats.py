"""Statistical column functions that stay inside the JVM.

Spark has no ``erf``; the complementary error function below is the
Chebyshev fit published by Press et al. (Numerical Recipes, ``erfcc``),
fractional error below 1.2e-7 everywhere, written as a Column expression for row-level
use. The p-values of tests are exact: the normal and the Student-t tail run
as Arrow ``pandas_udf`` over the (few) aggregated rows only.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Chebyshev coefficients of the erfc fit (Numerical Recipes).
ERFC_COEFFS = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
               0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def erfc(x) -> Column:
    x = _c(x)
    z = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * z)
    poly = F.lit(ERFC_COEFFS[-1])
    for coef in reversed(ERFC_COEFFS[:-1]):
        poly = F.lit(coef) + t * poly
    ans = t * F.exp(-z * z + poly)
    return F.when(x >= 0, ans).otherwise(F.lit(2.0) - ans)


def normal_cdf(x) -> Column:
    return F.lit(0.5) * erfc(-_c(x) / F.lit(math.sqrt(2.0)))


@F.pandas_udf(T.DoubleType())
def _normal_p(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if pd.isna(x) else math.erfc(abs(x) / math.sqrt(2.0))).astype("float64")


def two_sided_normal_p(z) -> Column:
    """Two-sided normal p-value to double precision, for aggregated rows (an
    Arrow UDF over a few rows; ``erfc`` is the JVM-side approximation)."""
    return _normal_p(_c(z))


def logistic(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def isclose(a, b, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """numpy.isclose semantics: |a-b| <= atol + rtol*|b|."""
    a, b = _c(a), _c(b)
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def z_quantile(p: float) -> float:
    """Standard normal quantile of a scalar parameter (driver-side constant)."""
    return NormalDist().inv_cdf(p)


# ---- Student t tail (incomplete beta), vectorised over aggregated rows ----

def _betacf(a: float, b: float, x: float, itmax: int = 300, eps: float = 3e-16) -> float:
    # continued fraction for the incomplete beta function (modified Lentz)
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, itmax + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def betainc_reg(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p_scalar(t: float, df: float) -> float:
    if t is None or df is None or not np.isfinite(t) or not np.isfinite(df) or df <= 0:
        return float("nan")
    return betainc_reg(df / 2.0, 0.5, df / (df + t * t))


@F.pandas_udf(T.DoubleType())
def t_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_p_scalar(a, b) for a, b in zip(t, df)], dtype="float64")
