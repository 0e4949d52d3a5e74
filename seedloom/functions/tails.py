"""Tail probabilities for single aggregated rows; plain Python, safe to import in workers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd


def arrangements(m: int, n: int) -> np.ndarray:
    """Number of ways to mix m and n items, by value of the rank-sum statistic U."""
    counts = np.zeros(m * n + 1)
    counts[0] = 1.0
    for i in range(1, m + 1):
        top = n + i  # times (1 - x^top), divided by (1 - x^i)
        if top < len(counts):
            counts[top:] -= counts[: len(counts) - top].copy()
        for start in range(i):
            counts[start::i] = np.cumsum(counts[start::i])
    return counts


def two_sided_rank_test(u: float, m: int, n: int, ties: float) -> float:
    """Exact p-value of the rank-sum statistic; only without ties."""
    if ties:
        raise ValueError("the exact distribution holds for distinct values only")
    counts = arrangements(min(m, n), max(m, n))
    far = int(round(max(u, m * n - u)))
    return float(min(1.0, 2.0 * counts[far:].sum() / counts.sum()))


def exact_rank_p(u: pd.Series, m: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else two_sided_rank_test(a, int(b), int(c), d) for a, b, c, d in zip(u, m, n, ties)], dtype="float64")


def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided tail of the normal distribution from its complementary error function."""
    z = z.astype("float64")
    return z.map(lambda v: min(1.0, math.erfc(v / math.sqrt(2.0))), na_action="ignore")


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        k = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        else:
            num = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        d = 1.0 / (1.0 + num * d or tiny)
        c = 1.0 + num / c or tiny
        f *= c * d
        if abs(1.0 - c * d) < 1e-14:
            break
    return front * (f - 1.0)


def t_test_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided p-value of Student's t."""
    out = [
        None if pd.isna(a) or pd.isna(d) or d <= 0 else beta_tail(d / 2.0, 0.5, d / (d + a * a)) for a, d in zip(t, dof)
    ]
    return pd.Series(out, dtype="float64")


def normal_quantile(p: pd.Series) -> pd.Series:
    """Inverse of the normal distribution function."""
    from statistics import NormalDist

    inv = NormalDist().inv_cdf
    return p.map(lambda v: None if pd.isna(v) else inv(v)).astype("float64")
