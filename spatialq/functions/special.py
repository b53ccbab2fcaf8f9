"""Tail probabilities without SciPy: the regularised incomplete beta function."""

from __future__ import annotations

import math

import numpy as np


def log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def incomplete_beta(x: float, a: float, b: float) -> float:
    """I_x(a, b) by its continued fraction, evaluated by Lentz's method."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - log_beta(a, b)) / a
    tiny = 1e-300

    def safe(v: float) -> float:
        return v if abs(v) > tiny else tiny

    c, d = 1.0, 1.0 / safe(1.0 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 400):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / safe(1.0 + step * d)
            c = safe(1.0 + step / c)
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * total


def f_tail(f: np.ndarray, df1: float, df2: np.ndarray) -> np.ndarray:
    """P(F > f), computed directly as a tail so that small values keep their digits."""
    out = np.full(len(f), np.nan)
    for i, (v, d) in enumerate(zip(f, np.broadcast_to(df2, len(f)), strict=True)):
        if np.isfinite(v) and d > 0:
            out[i] = incomplete_beta(d / (d + df1 * v), d / 2, df1 / 2)
    return out


def pearson_p(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p of a correlation; |r| >= 1 gives 0, n <= 2 gives 1."""
    out = np.ones(len(r))
    for i, (v, k) in enumerate(zip(r, n, strict=True)):
        if k > 2:
            out[i] = 0.0 if abs(v) >= 1 else incomplete_beta(1 - v * v, (k - 2) / 2, 0.5)
    return out
