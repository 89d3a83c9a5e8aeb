"""Tail probabilities for test statistics.

Spark has no distribution functions, so these are pandas UDFs that work on whole columns at once. They are applied to
*aggregated* rows only (one per test), never to raw data. Series and fractions run until they have converged, however many
terms that takes, and large arguments are handled by differences that do not cancel.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

STEPS = 20_000_000  # a fraction that has not converged by then is an error, never a result


def stirling_rest(a: np.ndarray) -> np.ndarray:
    """log gamma(a) minus ((a - 1/2) log a - a + log(2 pi) / 2), without cancellation for large ``a``."""
    a = np.asarray(a, float)
    shift, z = np.zeros_like(a), a.copy()
    for _ in range(12):  # raise small arguments: rest(z) = rest(z + 1) + (z + 1/2) log(1 + 1/z) - 1
        low = z < 12
        shift = np.where(low, shift + (z + 0.5) * np.log1p(1 / z) - 1, shift)
        z = np.where(low, z + 1, z)
    w = 1 / (z * z)
    series = (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w * (1 / 1680 - w * (1 / 1188 - w * 691 / 360360))))) / z
    return shift + series


def beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """I_x(a, b) over x**a * y**b / B(a, b), for y = 1 - x and gap = (a + b) * y - b >= 0.

    The continued fraction of DiDonato and Morris (1992), which never subtracts x from its mean.
    """
    value = np.full(len(a), np.nan)
    at, n = np.arange(len(a)), 0
    first = (1 + gap) / (1 + 1 / a)
    top, low, ratio = np.zeros(len(a)), 1 / first, 1 / first
    while len(at):
        n += 1
        if n > STEPS:
            raise ArithmeticError("the incomplete beta function did not converge")
        even = a + 2 * n - 1
        alpha = (a + n - 1) * (a + b + n - 1) * n * (b - n) * (x / even) ** 2
        beta = n + n * (b - n) * x / even + (a + n) / (a + 1 + 2 * n) * (1 + gap + n * (1 + y))
        # both sequences are divided by the last denominator, so they stay near one
        bottom = alpha * low + beta
        following = (alpha * top + beta * ratio) / bottom
        done = np.abs(following - ratio) <= 2e-16 * np.abs(following)
        top, low, ratio = ratio / bottom, 1 / bottom, following
        if done.any():
            value[at[done]] = ratio[done]
            left = ~done
            at, a, b, x, y, gap, top, low, ratio = (v[left] for v in (at, a, b, x, y, gap, top, low, ratio))
    return value


def f_tail(f, d1, d2) -> np.ndarray:
    """Upper tail of Fisher's F for arrays; NaN where an argument is missing, infinite or out of range."""
    f, d1, d2 = (np.array(v, float) for v in np.broadcast_arrays(f, d1, d2))
    out = np.full(f.shape, np.nan)
    ok = np.isfinite(f) & np.isfinite(d1) & np.isfinite(d2) & (f >= 0) & (d1 > 0) & (d2 > 0)
    out[ok & (f == 0)] = 1.0
    ok &= f > 0
    f, d1, d2 = f[ok], d1[ok], d2[ok]
    a, b = d2 / 2, d1 / 2
    below, above = d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f)
    # x and 1 - x against the mean of the beta distribution: both logarithms keep their digits when a and b are large
    drift = np.log1p(d1 * (1 - f) / (d2 + d1 * f))
    front = np.exp(
        a * drift + b * (np.log(f) + drift) + 0.5 * (np.log(a) + np.log(b) - np.log(a + b) - np.log(2 * np.pi))
        + stirling_rest(a + b) - stirling_rest(a) - stirling_rest(b)
    )
    got = np.empty(len(f))
    direct = f >= 1
    got[direct] = front[direct] * beta_fraction(*(v[direct] for v in (a, b, below, above, b * d2 * (f - 1) / (d2 + d1 * f))))
    other = ~direct
    got[other] = 1 - front[other] * beta_fraction(*(v[other] for v in (b, a, above, below, a * d1 * (1 - f) / (d2 + d1 * f))))
    out[ok] = got
    return out


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0 or x >= 1.0:
        return float("nan") if np.isnan(x) else float(x >= 1.0)
    return float(f_tail([a * (1 - x) / (b * x)], [2 * b], [2 * a])[0])


def t_two_sided(t: float, df: float) -> float:
    return float(f_tail([t * t], [1.0], [df])[0])


def f_upper(f: float, d1: float, d2: float) -> float:
    return float(f_tail([f], [d1], [d2])[0])


def t_critical(df, level: float = 0.95):
    """Two-sided critical values of Student's t for one or many degrees of freedom; NaN where there are none.

    Newton steps on the tail, all values at once. The tail is convex, so from a start below the root (the normal quantile is one) every
    step stays below it.
    """
    wanted = np.atleast_1d(np.asarray(df, float))
    v, back = np.unique(np.where(wanted > 0, wanted, np.nan), return_inverse=True)
    tail, ok = 1.0 - level, np.isfinite(v)
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    half = np.where(ok, v, 1.0) / 2
    scale = log_gamma(half + 0.5) - log_gamma(half) - 0.5 * np.log(2 * half * np.pi)
    t = np.full(len(v), NormalDist().inv_cdf(1 - tail / 2))
    for _ in range(200):
        density = 2 * np.exp(scale - (half + 0.5) * np.log1p(t * t / (2 * half)))
        following = t + (f_tail(t * t, 1.0, 2 * half) - tail) / density
        done = np.abs(following - t) <= 4e-16 * t
        t = following
        if done[ok].all() or not ok.any():
            break
    out = np.where(ok, t, np.nan)[back].reshape(wanted.shape)
    return out if np.ndim(df) else float(out[0])


# coefficients of the published rational approximation of erfc (W. J. Cody 1969), fixed values
_ERF = ((3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1),
        (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03))
_MID = ((5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02,
         1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8),
        (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03,
         4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03))
_FAR = ((3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2),
        (2.56852019228982242e00, 1.87295284992346047e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3))


def _ratio(x, table):
    p, q = table
    top, low = p[-1] * x, x
    for i in range(len(q) - 1):
        top, low = (top + p[i]) * x, (low + q[i]) * x
    return (top + p[len(q) - 1]) / (low + q[-1])


def erfc(x) -> np.ndarray:
    """Complementary error function for arrays of x >= 0."""
    x = np.asarray(x, float)
    with np.errstate(all="ignore"):
        small = 1 - x * _ratio(x * x, _ERF)
        cut = np.trunc(x * 16) / 16
        scale = np.exp(-cut * cut) * np.exp(-(x - cut) * (x + cut))
        middle = scale * _ratio(x, _MID)
        w = 1 / (x * x)
        far = scale * (1 / np.sqrt(np.pi) - w * _ratio(w, _FAR)) / x
        return np.where(x <= 0.46875, small, np.where(x <= 4, middle, far))


def _column(out: np.ndarray) -> pd.Series:
    return pd.Series(out).astype(object).where(~np.isnan(out), None).astype("Float64")


@F.pandas_udf(DoubleType())
def _p_t(t: pd.Series, df: pd.Series) -> pd.Series:
    return _column(f_tail(t.astype(float) ** 2, 1.0, df.astype(float)))


@F.pandas_udf(DoubleType())
def _p_f(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _column(f_tail(f.astype(float), d1.astype(float), d2.astype(float)))


@F.pandas_udf(DoubleType())
def _p_norm(z: pd.Series) -> pd.Series:
    return _column(erfc(np.abs(z.astype(float).to_numpy()) / np.sqrt(2)))


@F.pandas_udf(DoubleType())
def _normal_quantile(p: pd.Series) -> pd.Series:
    """Inverse of the normal distribution: a start from the tail's expansion, then Newton steps on the exact tail."""
    p = p.astype(float).to_numpy()
    inside = (p > 0) & (p < 1)
    tail = np.where(inside, np.minimum(p, 1 - p), 0.5)
    r = np.sqrt(-2 * np.log(tail))
    z = np.maximum(r - (2.30753 + 0.27061 * r) / (1 + r * (0.99229 + 0.04481 * r)), 0)
    for _ in range(4):
        error = erfc(z / np.sqrt(2)) / 2 - tail
        step = error * np.sqrt(2 * np.pi) * np.exp(z * z / 2)
        z = np.maximum(z + step / (1 + z * step / 2), 0)
    return _column(np.where(inside, np.where(p < 0.5, -z, z), np.nan))


def _d(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def p_t(t, df) -> Column:
    """Two-sided p-value of Student's t."""
    return _p_t(_d(t), _d(df))


def p_f(f, d1, d2) -> Column:
    """Upper-tail p-value of Fisher's F."""
    return _p_f(_d(f), _d(d1), _d(d2))


def p_norm(z) -> Column:
    """Two-sided p-value of a standard normal statistic."""
    return _p_norm(_d(z))


def normal_quantile(p) -> Column:
    """Quantile of the standard normal distribution; NULL outside (0, 1)."""
    return _normal_quantile(_d(p))


def p_chi2_2(x) -> Column:
    """Upper-tail p-value of chi-square with two degrees of freedom."""
    return F.exp(-_d(x) / 2)
