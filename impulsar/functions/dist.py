"""Upper-tail quantiles of the normal and Student-t distributions."""

from __future__ import annotations

import math
from statistics import NormalDist


def normal_isf(p: float) -> float:
    return -NormalDist().inv_cdf(p)


def _log_beta_tail(a: float, b: float, x: float) -> float:
    """Logarithm of the regularized incomplete beta function, by its continued fraction."""
    if x > (a + 1) / (a + b + 2):
        other = _log_beta_tail(b, a, 1 - x)
        return math.log1p(-math.exp(other)) if other < 0 else -math.inf
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x) - math.log(a)
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    value = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front + math.log(value)


def student_log_sf(t: float, df: float) -> float:
    """log P(T > t), t > 0."""
    x = df / (df + t * t)
    return math.log(0.5) + (_log_beta_tail(df / 2, 0.5, x) if x < 1 else 0.0)


def student_isf(p: float, df: float) -> float:
    """The t with P(T > t) = p, 0 < p < 1/2, by bisection on the logarithm of t."""
    if p == 0.5:
        return 0.0
    if p > 0.5:
        return -student_isf(1 - p, df)
    target, low, high = math.log(p), -50.0, 1.0
    while student_log_sf(math.exp(high), df) > target and high < 700:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        if student_log_sf(math.exp(middle), df) > target:
            low = middle
        else:
            high = middle
    return math.exp((low + high) / 2)
