"""Vectorised special functions for Arrow-batched pandas UDFs (numpy only).

Used where a closed form is iterative: the negative-binomial CDF is the regularised
incomplete beta I_p(k, y + 1), evaluated by the modified Lentz continued fraction to
convergence, in about sqrt(max(k, y)) vectorised steps (real birth counts per cell run to
tens of thousands, so summing the pmf up to y would not scale).
"""

from __future__ import annotations

import math

import numpy as np

_LN_2PI_HALF = 0.5 * math.log(2.0 * math.pi)


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0 (shifted Stirling series, abs error < 1e-12)."""
    x = np.asarray(x, dtype=float)
    z = x + 7.0
    prod = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6)
    z2 = z * z
    series = 1 / (12 * z) - 1 / (360 * z * z2) + 1 / (1260 * z * z2 * z2) - 1 / (1680 * z * z2 ** 3) + 1 / (1188 * z * z2 ** 4)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        out = (z - 0.5) * np.log(z) - z + _LN_2PI_HALF + series - np.log(prod)
        big = x >= 1e7
        if big.any():
            zb = x[big]
            zb2 = zb * zb
            out[big] = (zb - 0.5) * np.log(zb) - zb + _LN_2PI_HALF + 1 / (12 * zb) - 1 / (360 * zb * zb2)
    return np.where(x > 0, out, np.nan)


#: A factor this near to 1 ends the continued fraction (a few ulp, so that rounding cannot keep it from ending).
_CONVERGED = 1e-15


def _betacf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta (modified Lentz), iterated until every element has converged.

    The steps needed grow with sqrt(max(a, b)); elements that have converged leave the arrays.  A run far beyond that
    raises instead of returning an unconverged value."""
    tiny = 1e-300

    def off_zero(v: np.ndarray) -> np.ndarray:
        return np.where(np.abs(v) < tiny, tiny, v)

    out = np.empty_like(x)
    at = np.arange(len(x))
    c = np.ones_like(x)
    d = 1.0 / off_zero(1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    steps = int(1000 + 100 * np.sqrt(max(a.max(initial=1.0), b.max(initial=1.0))))
    for m in range(1, steps + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((a - 1.0 + m2) * (a + m2))
        d = 1.0 / off_zero(1.0 + aa * d)
        c = off_zero(1.0 + aa / c)
        h = h * d * c
        aa = -(a + m) * (a + b + m) * x / ((a + m2) * (a + 1.0 + m2))
        d = 1.0 / off_zero(1.0 + aa * d)
        c = off_zero(1.0 + aa / c)
        h = h * d * c
        open_ = ~(np.abs(d * c - 1.0) <= _CONVERGED)
        if not open_.all():
            out[at[~open_]] = h[~open_]
            at, a, b, x, c, d, h = (v[open_] for v in (at, a, b, x, c, d, h))
            if not len(at):
                return out
    raise ArithmeticError(f"incomplete beta: {len(at)} values have not converged after {steps} steps")


def _stirling_rest(z: np.ndarray) -> np.ndarray:
    z2 = z * z
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / (1188 * z2)) / z2) / z2) / z2) / z


def _log_power(n: np.ndarray, p: np.ndarray, total: np.ndarray) -> np.ndarray:
    """n log(p total / n), without cancellation near p = n / total."""
    rest = (p * total - n) / n
    return n * np.where(np.abs(rest) < 0.5, np.log1p(np.where(np.abs(rest) < 0.5, rest, 0.0)), np.log(p * total / n))


def _log_front(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """log(x^a (1 - x)^b / B(a, b))."""
    out = lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)
    large = (a >= 10) & (b >= 10)  # the log gammas nearly cancel
    if large.any():
        a, b, x = a[large], b[large], x[large]
        n = a + b
        out[large] = (_log_power(a, x, n) + _log_power(b, 1.0 - x, n) + 0.5 * np.log(a * b / n) - _LN_2PI_HALF
                      + _stirling_rest(n) - _stirling_rest(a) - _stirling_rest(b))
    return out


def betainc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b), vectorised."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    out = np.full(np.broadcast(a, b, x).shape, np.nan)
    a, b, x = np.broadcast_arrays(a, b, x)
    ok = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    out[ok & (x == 0)] = 0.0
    out[ok & (x == 1)] = 1.0
    mid = ok & (x > 0) & (x < 1)
    if mid.any():
        am, bm, xm = a[mid], b[mid], x[mid]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            bt = np.exp(_log_front(am, bm, xm))
            direct = xm < (am + 1.0) / (am + bm + 2.0)
            res = np.empty_like(xm)
            if direct.any():
                res[direct] = bt[direct] * _betacf(am[direct], bm[direct], xm[direct]) / am[direct]
            flip = ~direct
            if flip.any():
                res[flip] = 1.0 - bt[flip] * _betacf(bm[flip], am[flip], 1.0 - xm[flip]) / bm[flip]
        out[mid] = np.clip(res, 0.0, 1.0)
    return out


def nb_quantile(u, mu, k) -> np.ndarray:
    """Smallest y with P(Y <= y) >= u of a negative binomial with mean mu and size k, for 0 < u < 1; NaN without a finite mu >= 0
    and k > 0.  Doubling brackets it and bisection finds it, so that the work grows with log(mu)."""
    u, mu, k = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(u, mu, k))
    out = np.full(u.shape, np.nan)
    valid = np.isfinite(u) & np.isfinite(mu) & np.isfinite(k) & (k > 0) & (mu >= 0)
    u, mu, k = u[valid], mu[valid], k[valid]
    low, high = np.full(u.shape, -1.0), np.ceil(mu)
    short = np.flatnonzero(nb_cdf(high, mu, k) < u)
    while len(short):
        low[short], high[short] = high[short], 2.0 * high[short] + 1.0
        short = short[nb_cdf(high[short], mu[short], k[short]) < u[short]]
    wide = np.flatnonzero(high - low > 1.0)
    while len(wide):
        middle = np.floor((low[wide] + high[wide]) / 2.0)
        reached = nb_cdf(middle, mu[wide], k[wide]) >= u[wide]
        high[wide[reached]], low[wide[~reached]] = middle[reached], middle[~reached]
        wide = wide[high[wide] - low[wide] > 1.0]
    out[valid] = high
    return out


def nb_cdf(y, mu, k) -> np.ndarray:
    """P(Y <= y) for a negative binomial with mean mu and size k: I_{k/(k+mu)}(k, y + 1)."""
    y, mu, k = (np.asarray(v, dtype=float) for v in (y, mu, k))
    out = np.full(np.broadcast(y, mu, k).shape, np.nan)
    valid = np.isfinite(y) & np.isfinite(mu) & np.isfinite(k) & (k > 0) & (mu >= 0)
    out[valid & (y < 0)] = 0.0
    out[valid & (y >= 0) & (mu == 0)] = 1.0
    rest = valid & (y >= 0) & (mu > 0)
    if rest.any():
        yy = np.floor(y[rest])
        out[rest] = betainc(k[rest], yy + 1.0, k[rest] / (k[rest] + mu[rest]))
    return out
