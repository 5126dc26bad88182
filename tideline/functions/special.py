"""Distribution tails that Spark lacks, vectorised for one-row-per-test inputs.

Every function works on NumPy arrays; the ``*_udf`` wrappers are Arrow-batched and are only ever
applied to rows that are already aggregated (one per test, feature or arm).
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

lgamma = np.vectorize(math.lgamma, otypes=[float])
_lgamma = lgamma
_erfc = np.vectorize(math.erfc, otypes=[float])
_TINY = 1e-300
_STEPS = 100_000


def norm_two_sided(z: np.ndarray) -> np.ndarray:
    """P(|Z| > |z|) for a standard normal Z."""
    z = np.asarray(z, float)
    return np.where(np.isnan(z), np.nan, _erfc(np.abs(z) / math.sqrt(2)))


def _gamma_sf_far(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Q(a, x) for large a by Temme's uniform expansion, two terms."""
    lam = x / a
    mu = lam - 1
    with np.errstate(invalid="ignore", divide="ignore"):
        half = np.where(np.abs(mu) < 1e-3, mu * mu / 2 - mu**3 / 3 + mu**4 / 4 - mu**5 / 5, mu - np.log(lam))
        eta = np.sign(mu) * np.sqrt(2 * np.maximum(half, 0))
        small = np.abs(eta) < 1e-2
        c0 = np.where(small, -1 / 3 + eta / 12 - 2 * eta**2 / 135 + eta**3 / 864, 1 / mu - 1 / eta)
    rest = np.exp(-a * eta * eta / 2) / np.sqrt(2 * np.pi * a) * (c0 - np.where(small, 1 / 540, 0) / a)
    return np.clip(_erfc(eta * np.sqrt(a / 2)) / 2 + rest, 0, 1)


def gamma_sf(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma Q(a, x): series below a+1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    xs = np.where(x > 0, x, 1.0)
    far = a > 1e5  # the series grows long and log-gamma loses digits there
    if np.any(far):
        out = gamma_sf(np.where(far, 1.0, a), np.where(far, 1.0, x))
        return np.where(far & ~np.isnan(x), _gamma_sf_far(np.where(far, a, 1e6), xs) * (x > 0) + (x <= 0), out)
    front = np.exp(-xs + a * np.log(xs) - _lgamma(a))
    term = 1.0 / a
    total, k = term.copy(), a.copy()
    near = xs < a + 1
    for _ in range(_STEPS):
        k = k + 1
        term = np.where(near, term * xs / k, 0.0)
        total = total + term
        if np.all(np.abs(term) <= 1e-17 * np.abs(total)):
            break
    else:
        raise ArithmeticError("the incomplete gamma series has not converged")
    lower = front * total
    b = xs + 1 - a
    c, d = np.full_like(xs, 1 / _TINY), 1 / np.where(np.abs(b) < _TINY, _TINY, b)
    h = d.copy()
    for i in range(1, _STEPS):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
        c = b + an / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        step = d * c
        h = h * step
        if np.all(near | (np.abs(step - 1) < 1e-15)):
            break
    else:
        raise ArithmeticError("the incomplete gamma fraction has not converged")
    out = np.where(xs < a + 1, 1 - lower, front * h)
    return np.where(np.isnan(x), np.nan, np.where(x <= 0, 1.0, out))


def chi2_upper(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(X > x) for a chi-squared X with ``df`` degrees of freedom."""
    return gamma_sf(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def beta_cdf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b) by continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    ys = np.clip(y, _TINY, 1 - 1e-16)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(ys) + q * np.log1p(-ys)) / p
    c = np.ones_like(ys)
    d = 1 - (p + q) * ys / (p + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, _STEPS):
        for num in (
            m * (q - m) * ys / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * ys / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    else:
        raise ArithmeticError("the incomplete beta fraction has not converged")
    part = np.where(y <= 0, 0.0, np.where(y >= 1, 1.0, front * h))
    return np.where(flip, 1 - part, part)


def _t_as_normal(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The normal deviate whose tail is Student's for large ``df``: t - (t^3 + t) / (4 df) + ..., two terms."""
    return t - (t**3 + t) / (4 * df) + (13 * t**5 + 8 * t**3 + 3 * t) / (96 * df * df)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| > |t|) for Student's T; infinite ``df`` is the normal law."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    wide = np.isinf(df)
    far = ~wide & (df > 1e5)  # digits are lost in differences of log-gammas there
    safe = np.where(wide | far | ~(df > 0), 1.0, df)
    tt = np.where(np.isnan(t), 0.0, t) ** 2
    p = beta_cdf(safe / 2, np.full_like(safe, 0.5), safe / (safe + tt))
    z = np.where(far, _t_as_normal(np.sqrt(tt), np.where(far, df, 1.0)), 0.0)
    out = np.where(wide, norm_two_sided(t), np.where(far, norm_two_sided(z), p))
    return np.where(np.isnan(t) | ~(df > 0), np.nan, out)


def t_upper_quantile(level: float, df: np.ndarray) -> np.ndarray:
    """The t with P(|T| <= t) = level, by bisection on the tail."""
    df = np.asarray(df, float)
    lo, hi = np.zeros_like(df), np.full_like(df, 1.0)
    alpha = 1 - level
    ok = df > 0
    safe = np.where(ok, df, 1.0)
    while np.any(t_two_sided(hi, safe) > alpha):
        hi = hi * 2
    for _ in range(200):
        mid = (lo + hi) / 2
        above = t_two_sided(mid, safe) > alpha
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
        if np.all(hi - lo <= 4e-16 * hi):
            break
    return np.where(ok, (lo + hi) / 2, np.nan)


def _shifted(x: np.ndarray, upto: float = 12.0):
    """Arguments moved above ``upto`` by whole steps, and the steps taken."""
    x = np.asarray(x, float)
    n = np.maximum(np.ceil(upto - x), 0)
    return x, n


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log gamma, by recurrence and asymptotic series."""
    x, n = _shifted(x)
    out = np.zeros_like(x)
    for i in range(int(n.max()) if n.size else 0):
        out = out - np.where(i < n, 1 / (x + i), 0)
    y = x + n
    r = 1 / (y * y)
    return out + np.log(y) - 0.5 / y - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def trigamma(x: np.ndarray) -> np.ndarray:
    """Second derivative of log gamma."""
    x, n = _shifted(x)
    out = np.zeros_like(x)
    for i in range(int(n.max()) if n.size else 0):
        out = out + np.where(i < n, 1 / (x + i) ** 2, 0)
    y = x + n
    r = 1 / (y * y)
    return out + 1 / y + r / 2 + r / y * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * 5 / 66))))


def trigamma_inverse(v: float) -> float:
    """The x with trigamma(x) = v, by Newton steps on 1/trigamma."""
    if not v > 0:
        return math.inf
    if v > 1e7:
        return 1 / math.sqrt(v)
    if v < 1e-6:
        return 1 / v
    x = 0.5 + 1 / v
    for _ in range(60):
        tri = float(trigamma(np.array([x]))[0])
        h = 1e-4 * x
        slope = float((trigamma(np.array([x + h])) - trigamma(np.array([x - h])))[0]) / (2 * h)
        step = tri * (1 - tri / v) / slope
        x += step
        if abs(step) < 1e-12 * x:
            break
    return x


@lru_cache(maxsize=4096)
def _ranksum_tail(n1: int, n2: int) -> np.ndarray:
    """P(W <= w) for w = 0..n1*n2 under the null, no ties: the Gaussian binomial's coefficients."""
    ways = np.zeros(n1 * n2 + 1, dtype=object)  # whole numbers beyond 2**53
    ways[0] = 1
    for i in range(1, n1 + 1):
        grown = ways.copy()
        shift = n2 + i
        if shift <= n1 * n2:
            grown[shift:] -= ways[:-shift]
        for w in range(i, n1 * n2 + 1):
            grown[w] += grown[w - i]
        ways = grown
    total = math.comb(n1 + n2, n1)
    return np.array([c / total for c in np.cumsum(ways)], float)


def ranksum_exact(n1: int, n2: int, w: float) -> float:
    """Exact two-sided p of a rank-sum statistic."""
    n1, n2, w = int(n1), int(n2), int(round(w))
    cdf = _ranksum_tail(min(n1, n2), max(n1, n2))
    # The law is symmetric about n1*n2/2, so both tails are read from the lower one.
    low = w if w <= n1 * n2 / 2 else n1 * n2 - w
    return float(min(1.0, 2 * cdf[low]))


@F.pandas_udf(DoubleType())
def norm_p_udf(z: pd.Series) -> pd.Series:
    return pd.Series(norm_two_sided(z.to_numpy(float)))


@F.pandas_udf(DoubleType())
def chi2_p_udf(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(chi2_upper(x.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def t_p_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def digamma_udf(x: pd.Series) -> pd.Series:
    return pd.Series(digamma(x.to_numpy(float)))


@F.pandas_udf(DoubleType())
def trigamma_udf(x: pd.Series) -> pd.Series:
    return pd.Series(trigamma(x.to_numpy(float)))


@F.pandas_udf(DoubleType())
def ranksum_p_udf(n1: pd.Series, n2: pd.Series, w: pd.Series, z: pd.Series, ties: pd.Series) -> pd.Series:
    p = norm_two_sided(z.to_numpy(float))
    exact = ((n1 < 50) & (n2 < 50) & (ties == 0)).to_numpy()
    for i in np.flatnonzero(exact):
        p[i] = ranksum_exact(n1.iloc[i], n2.iloc[i], w.iloc[i])
    return pd.Series(p)


def t_quantile_udf(level: float):
    """Column function df -> two-sided t quantile at ``level``."""

    @F.pandas_udf(DoubleType())
    def quantile(df: pd.Series) -> pd.Series:
        return pd.Series(t_upper_quantile(level, df.to_numpy(float)))

    return quantile
