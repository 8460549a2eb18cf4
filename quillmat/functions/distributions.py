"""Upper tails of the F, t and normal distributions, vectorized, as pandas UDFs over result tables (a row per variable)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def incomplete_beta(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Regularized incomplete beta function by its continued fraction (modified Lentz), on the side where it converges fast."""
    x = np.asarray(x, float)
    swap = x > (a + 1) / (a + b + 2)
    y = np.where(swap, 1 - x, x)
    p, q = np.where(swap, b, a), np.where(swap, a, b)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(log_front + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.nanmax(np.abs(d * c - 1), initial=0) < 1e-15:
            break
    out = np.where(y <= 0, 0.0, front * h)
    return np.where(swap, 1 - out, out)


def f_tail(f, v1: float, v2: float) -> np.ndarray:
    """P(F > f); nan stays nan, infinity has 0."""
    f = np.asarray(f, float)
    with np.errstate(invalid="ignore", over="ignore"):
        out = incomplete_beta(v2 / 2, v1 / 2, v2 / (v2 + v1 * np.maximum(f, 0)))
    return np.where(np.isnan(f), np.nan, np.where(np.isinf(f), 0.0, out))


def t_two_sided(t, v: float) -> np.ndarray:
    t = np.asarray(t, float)
    return np.minimum(1.0, f_tail(t * t, 1, v))


def normal_tail(z) -> np.ndarray:
    return np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in np.atleast_1d(np.asarray(z, float))])


def f_pvalue(v1: float, v2: float):
    return F.pandas_udf(lambda s: pd.Series(f_tail(s.to_numpy(), v1, v2)), T.DoubleType())


def t_pvalue(v: float):
    return F.pandas_udf(lambda s: pd.Series(t_two_sided(s.to_numpy(), v)), T.DoubleType())


def rank_pvalue():
    """Two-sided p of a rank-sum deviation and its sigma, with continuity correction."""

    def p(d: pd.Series, sigma: pd.Series) -> pd.Series:
        z = (d.abs() - 0.5) / sigma.where(sigma > 0, np.nan)
        return pd.Series(np.where(sigma > 0, np.minimum(1.0, 2 * normal_tail(z.fillna(0))), 1.0))

    return F.pandas_udf(p, T.DoubleType())
