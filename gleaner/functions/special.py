"""Special functions in numpy: upper incomplete gamma, digamma of integers."""

from __future__ import annotations

import math

import numpy as np

_EULER = 0.57721566490153286061


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x): a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * math.exp(front))
    # Lentz's method
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (v if abs(v := an * d + b) > tiny else tiny)
        c = v if abs(v := b + an / c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return math.exp(front) * h if front > -745 else 0.0


def chi2_tail(statistic: float, freedom: float) -> float:
    """Chance that a chi-squared variable exceeds ``statistic``; 1 without degrees of freedom."""
    return 1.0 if freedom <= 0 else gamma_q(freedom / 2, statistic / 2)


def digamma_table(n: int) -> np.ndarray:
    """digamma(0..n); entry 0 is not a number."""
    steps = np.concatenate([[-_EULER], 1 / np.arange(1, max(n, 1))])
    return np.concatenate([[np.nan], np.cumsum(steps)])[: n + 1]


def digamma(n: np.ndarray) -> np.ndarray:
    """digamma of whole numbers from 1 on: sums below 64, the asymptotic series from there on."""
    n = np.asarray(n)
    x = np.maximum(n, 64).astype(float)
    far = np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    return np.where(n < 64, digamma_table(64)[np.minimum(n, 63)], far)
