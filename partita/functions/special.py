"""Special functions and distribution tails for small results, in NumPy."""

from __future__ import annotations

import math

import numpy as np

_LGAMMA = np.frompyfunc(math.lgamma, 1, 1)


def lgamma(x):
    """ln of the gamma function, elementwise."""
    return np.asarray(_LGAMMA(x)).astype(float)


def digamma(x) -> np.ndarray:
    """Recurrence up to 8, then the asymptotic series."""
    x = np.asarray(x, dtype=float).copy()
    out = np.zeros_like(x)
    while (low := x < 8).any():
        out = np.where(low, out - 1 / np.where(low, x, 1), out)
        x = np.where(low, x + 1, x)
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def chi2_tail(x: float, dof: float) -> float:
    return gamma_upper(dof / 2, x / 2)


def studentised_range_tail(q: float, groups: int, dof: float) -> float:
    """P(range of `groups` standard normals / sqrt(chi2/dof) > q), by nested Gauss-Legendre rules."""
    if q <= 0:
        return 1.0
    z, wz = np.polynomial.legendre.leggauss(120)
    z, wz = 8 * z, 8 * wz
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = 0.5 * np.vectorize(math.erfc)(-z / math.sqrt(2))

    def range_cdf(w: np.ndarray) -> np.ndarray:
        below = 0.5 * np.vectorize(math.erfc)(-(z[None, :] - w[:, None]) / math.sqrt(2))
        return np.clip((groups * density * wz * np.clip(cdf - below, 0, 1) ** (groups - 1)).sum(axis=1), 0, 1)

    if dof > 20_000:
        return float(1 - range_cdf(np.array([q]))[0])
    s, ws = np.polynomial.legendre.leggauss(80)
    spread = 10 / math.sqrt(2 * dof)
    low, high = max(1e-6, 1 - spread), 1 + spread
    s, ws = (high - low) / 2 * s + (high + low) / 2, (high - low) / 2 * ws
    logs = dof / 2 * math.log(dof) - math.lgamma(dof / 2) - (dof / 2 - 1) * math.log(2) + (dof - 1) * np.log(s) - dof * s * s / 2
    return float(min(1.0, max(0.0, 1 - (np.exp(logs) * ws * range_cdf(q * s)).sum())))
