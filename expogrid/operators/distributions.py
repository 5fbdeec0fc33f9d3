"""Tails and quantiles that tests and intervals need, for single numbers on the driver."""

from __future__ import annotations

import math


def chi_square_tail(x: float, df: int) -> float:
    """P(X > x) for a chi-square variable with a whole number of degrees of freedom."""
    if x <= 0:
        return 1.0
    half = x / 2
    if df % 2:
        tail, term, k = math.erfc(math.sqrt(half)), math.exp(-half) * math.sqrt(half) / math.gamma(1.5), 1
    else:
        tail, term, k = math.exp(-half), math.exp(-half) * half, 2
    while k < df:  # each two degrees more add one term
        tail += term
        k += 2
        term *= half / (k / 2)
    return min(1.0, tail)


def _beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            top = 1.0
        elif i % 2 == 0:
            top = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            top = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + top * d or tiny)
        c = 1.0 + top / c or tiny
        f *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * (f - 1.0)


def student_tail(t: float, df: float) -> float:
    """P(T > t)."""
    both = _beta_share(df / (df + t * t), df / 2, 0.5)
    return both / 2 if t >= 0 else 1 - both / 2


def student_quantile(p: float, df: float) -> float:
    """The t of which P(T <= t) = p, by halving."""
    if p < 0.5:
        return -student_quantile(1 - p, df)
    low, high = 0.0, 1.0
    while student_tail(high, df) > 1 - p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if student_tail(mid, df) > 1 - p else (low, mid)
    return high
