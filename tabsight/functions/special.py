"""Scalar special functions for test statistics (pure Python, applied to
one-row results or inside grouped pandas functions).

regularized incomplete beta: continued fraction evaluated with the modified
Lentz method; F-distribution upper tail from it. Normal quantiles and tails
come from the standard library.
"""

from __future__ import annotations

import math
from statistics import NormalDist

_N01 = NormalDist()


def _fraction_terms(a: float, b: float, x: float):
    """Partial numerators of the continued fraction of the incomplete beta
    function, d1, d2, ... (Abramowitz and Stegun 26.5.8)."""
    m = 0
    while True:
        yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        m += 1
        yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))


def _betacf(a: float, b: float, x: float, eps: float = 1e-15, most: int = 20_000) -> float:
    """1 / (1 + d1 / (1 + d2 / (1 + ...))) by the modified Lentz recursion, which
    keeps the ratios of successive numerators and denominators off zero."""
    def off_zero(v: float) -> float:
        return v if abs(v) > 1e-300 else 1e-300

    value = upper = 1.0
    lower = 0.0
    for _, term in zip(range(most), _fraction_terms(a, b, x)):
        lower = 1.0 / off_zero(1.0 + term * lower)
        upper = off_zero(1.0 + term / upper)
        value *= upper * lower
        if abs(upper * lower - 1.0) < eps:
            break
    return 1.0 / value


def betainc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
           + a * math.log(x) + b * math.log1p(-x))
    bt = math.exp(lbt)
    if x < (a + 1.0) / (a + b + 2.0):
        return bt * _betacf(a, b, x) / a
    return 1.0 - bt * _betacf(b, a, 1.0 - x) / b


def f_sf(f: float | None, d1: float, d2: float) -> float | None:
    """P(F > f) for F(d1, d2)."""
    if f is None or d1 <= 0 or d2 <= 0 or math.isnan(f):
        return None
    if math.isinf(f):
        return 0.0
    if f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def norm_ppf(p: float) -> float:
    return _N01.inv_cdf(p)


def norm_ppf_array(p):
    """Normal quantiles of a numpy array: a rational start (Abramowitz and Stegun
    26.2.23, error below 4.5e-4) and Newton steps of third order against erfc."""
    import numpy as np
    q = np.minimum(p, 1 - p)
    t = np.sqrt(-2 * np.log(q))
    x = t - ((0.010328 * t + 0.802853) * t + 2.515517) / (((0.001308 * t + 0.189269) * t + 1.432788) * t + 1)
    for _ in range(2):
        e = (0.5 * _erfc_array(x / math.sqrt(2)) - q) * math.sqrt(2 * math.pi) * np.exp(x * x / 2)
        x = x + e / (1 - x * e / 2)
    return np.where(p < 0.5, -x, x)


def _erfc_array(x):
    """``math.erfc`` of each value."""
    import numpy as np
    return np.fromiter(map(math.erfc, x.tolist()), dtype=np.float64, count=len(x))


def norm_sf(z: float, mu: float = 0.0, sigma: float = 1.0) -> float:
    return 0.5 * math.erfc((z - mu) / (sigma * math.sqrt(2.0)))
