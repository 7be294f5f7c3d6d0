"""Distribution functions on numpy arrays (normal, t, F, Dickey-Fuller)."""

from __future__ import annotations

import math

import numpy as np

# MacKinnon (1994) approximation for one series with a constant.
DF_SMALL_P = (2.1659, 1.4412, 0.038269)
DF_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
DF_SWITCH, DF_FLOOR, DF_CEILING = -1.61, -18.83, 2.74

_erfc = np.vectorize(math.erfc, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def norm_cdf(x):
    return 0.5 * _erfc(-np.asarray(x, dtype=float) / math.sqrt(2.0))


def two_sided_normal_p(z):
    return _erfc(np.abs(np.asarray(z, dtype=float)) / math.sqrt(2.0))


def regularized_beta(a, b, x):
    """I_x(a, b) by the modified Lentz continued fraction, element-wise."""
    a, b, x = (np.array(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1.0) / (a + b + 2.0)
    p, q = np.where(swap, b, a), np.where(swap, a, b)
    z = np.clip(np.where(swap, 1.0 - x, x), 0.0, 1.0)
    inside = (z > 0) & (z < 1)
    zs = np.where(inside, z, 0.5)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(zs) + q * np.log1p(-zs)) / p
    tiny = 1e-300

    def guard(v):
        return np.where(np.abs(v) < tiny, tiny, v)

    c = np.ones_like(zs)
    d = 1.0 / guard(1.0 - (p + q) * zs / (p + 1.0))
    h = d
    for m in range(1, 400):
        even = m * (q - m) * zs / ((p + 2 * m - 1) * (p + 2 * m))
        d = 1.0 / guard(1.0 + even * d)
        c = guard(1.0 + even / c)
        h = h * d * c
        odd = -(p + m) * (p + q + m) * zs / ((p + 2 * m) * (p + 2 * m + 1))
        d = 1.0 / guard(1.0 + odd * d)
        c = guard(1.0 + odd / c)
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    core = np.where(inside, front * h, np.where(z <= 0, 0.0, 1.0))
    return np.where(swap, 1.0 - core, core)


def f_sf(f, d1, d2):
    """Upper tail of the F distribution; NaN in, NaN out."""
    f, d1, d2 = (np.array(v, dtype=float) for v in np.broadcast_arrays(f, d1, d2))
    ok = np.isfinite(f) & (d1 > 0) & (d2 > 0)
    fs, n1, n2 = np.where(ok, np.maximum(f, 0.0), 1.0), np.where(ok, d1, 1.0), np.where(ok, d2, 1.0)
    return np.where(ok, regularized_beta(n2 / 2, n1 / 2, n2 / (n2 + n1 * fs)), np.nan)


def t_sf(t, df):
    """Upper tail of Student's t."""
    t = np.asarray(t, dtype=float)
    half = 0.5 * regularized_beta(np.asarray(df, dtype=float) / 2, 0.5, df / (df + t * t))
    return np.where(t >= 0, half, 1.0 - half)


def dickey_fuller_p(tau):
    """Approximate p-value of the Dickey-Fuller statistic with a constant."""
    tau = np.asarray(tau, dtype=float)
    t = np.where(np.isfinite(tau), tau, 0.0)
    low = DF_SMALL_P[0] + DF_SMALL_P[1] * t + DF_SMALL_P[2] * t**2
    high = DF_LARGE_P[0] + DF_LARGE_P[1] * t + DF_LARGE_P[2] * t**2 + DF_LARGE_P[3] * t**3
    p = norm_cdf(np.where(t <= DF_SWITCH, low, high))
    p = np.where(t < DF_FLOOR, 0.0, np.where(t > DF_CEILING, 1.0, p))
    return np.where(np.isfinite(tau), p, np.nan)
