"""Distribution functions that neither Spark SQL nor the standard library has."""

from __future__ import annotations

import math
from statistics import NormalDist

NORMAL = NormalDist()


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function, by its series or its continued fraction."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * scale)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def chi2_ppf(p: float, df: float) -> float:
    low, high = 0.0, df + 40 * math.sqrt(2 * df) + 100
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - chi2_sf(mid, df) < p else (low, mid)
    return (low + high) / 2


def binomial_log_pmf(k: int, n: int, p: float) -> float:
    if p in (0.0, 1.0):
        return 0.0 if k == n * p else -math.inf
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction; the cost doesn't grow with a or b beyond a root."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 100_000):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + numerator * d or 1e-300)
            c = 1 + numerator / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, front * h)


def binomial_sf(k: int, n: int, p: float = 0.5) -> float:
    """P(X >= k)."""
    return 1.0 if k <= 0 else 0.0 if k > n else beta_inc(k, n - k + 1, p)


def binomial_two_sided(k: int, n: int, p: float = 0.5) -> float:
    """The probability of all outcomes that are no more likely than k."""
    bar = binomial_log_pmf(k, n, p) + 1e-7
    mode = min(n, int((n + 1) * p))
    if k == mode:
        return 1.0
    low, high = (mode, n + 1) if k < mode else (-1, mode)
    while high - low > 1:  # the tail on the other side begins where the probability falls to that of k
        mid = (low + high) // 2
        rare = binomial_log_pmf(mid, n, p) <= bar
        low, high = (low, mid) if rare == (k < mode) else (mid, high)
    left, right = (k, high) if k < mode else (low, k)
    return min(1.0, (1 - binomial_sf(left + 1, n, p)) + binomial_sf(right, n, p))


def least_detectable_deviation(n: int, alpha: float = 0.05, power: float = 0.8) -> float:
    """Percentage points above one half at which a one-sided binomial test of n has that power."""
    low, high = 0, n + 1
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if binomial_sf(mid, n) <= alpha else (mid + 1, high)
    if low > n:
        return math.nan
    a, b = 0.5, 1.0
    for _ in range(60):
        mid = (a + b) / 2
        a, b = (a, mid) if binomial_sf(low, n, mid) >= power else (mid, b)
    return 100 * (b - 0.5)
