"""Tail probabilities from published formulas, for values one at a time."""

from __future__ import annotations

import math


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            c = 1 + term / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * total


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation of n pairs, by Student's t with n - 2 degrees of freedom."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    return incomplete_beta(df / 2, 0.5, df / (df + r * r * df / (1 - r * r)))


def f_p(f: float, df1: int, df2: int) -> float:
    """Upper tail of the F distribution."""
    return 1.0 if f <= 0 else incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def chi2_1_p(x: float) -> float:
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


def binomial_p(k: int, n: int) -> float:
    """Two-sided exact p of k successes in n fair trials."""
    if n == 0:
        return 1.0
    low = min(k, n - k)
    tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(low + 1))
    return min(1.0, 2 * tail)


def normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


# MacKinnon's (1994) response surface for the Dickey-Fuller test with a constant.
ADF_SMALL, ADF_LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
ADF_STAR, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74


def adf_p(stat: float) -> float:
    if stat > ADF_MAX:
        return 1.0
    if stat < ADF_MIN:
        return 0.0
    z = sum(c * stat**i for i, c in enumerate(ADF_SMALL if stat <= ADF_STAR else ADF_LARGE))
    return 0.5 * math.erfc(-z / math.sqrt(2))
