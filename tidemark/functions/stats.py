"""Distribution functions that Spark lacks, as helpers on small, already aggregated rows.

Nothing here needs a session, so Python workers can import it.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd

_NORMAL = NormalDist()


def normal_cdf(x: float) -> float:
    return _NORMAL.cdf(x)


def normal_ppf(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(tiny, 1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def t_sf(t: float, df: float) -> float:
    """P(T > t) of Student's t."""
    half = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1 - half


def binom_sf(k: int, n: int, p: float) -> float:
    """P(X >= k) of a binomial count."""
    return 1.0 if k <= 0 else incomplete_beta(k, n - k + 1, p) if k <= n else 0.0


def apply(f, *columns: pd.Series) -> pd.Series:
    """f over rows; a null in any argument gives null."""
    return pd.Series([None if any(pd.isna(v) for v in row) else float(f(*row)) for row in zip(*columns, strict=True)], dtype=float)


def hurst_exponent(values) -> float:
    """Slope of log rescaled range on log length; half without enough lengths."""
    x, points, k = np.asarray(values, float), [], 8
    while k <= len(x) // 2:
        parts = x[: len(x) // k * k].reshape(-1, k)
        walk = np.cumsum(parts - parts.mean(axis=1, keepdims=True), axis=1)
        spread, sd = walk.max(axis=1) - walk.min(axis=1), parts.std(axis=1, ddof=1)
        if (ok := sd > 1e-15).any():
            points.append((np.log(k), np.log((spread[ok] / sd[ok]).mean())))
        k *= 2
    if len(points) < 2:
        return 0.5
    a, b = np.array(points).T
    return float(np.clip(np.polyfit(a, b, 1)[0], 0.0, 1.0))
