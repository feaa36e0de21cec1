"""Student t and chi-square tails as vectorised functions over Arrow batches.

They are applied after aggregation, so the rows they see are groups, not observations.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ship the helpers with the function, so workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TINY = 1e-300


def _log_gamma(x: np.ndarray) -> np.ndarray:
    from math import lgamma

    return np.vectorize(lgamma, otypes=[float])(x)


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, 400):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                          -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + numerator * d
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1.0 + numerator / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return h


def _beta_inc(a, b, x):
    """Regularised incomplete beta I_x(a, b)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    inner = np.clip(x, _TINY, 1.0 - 1e-16)
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b)
                   + a * np.log(inner) + b * np.log1p(-inner))
    swap = inner > (a + 1.0) / (a + b + 2.0)
    left = np.where(swap, b, a)
    right = np.where(swap, a, b)
    arg = np.where(swap, 1.0 - inner, inner)
    value = front * _beta_fraction(left, right, arg) / left
    value = np.where(swap, 1.0 - value, value)
    return np.where(x <= 0.0, 0.0, np.where(x >= 1.0, 1.0, value))


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|)."""
    return _beta_inc(df / 2.0, 0.5, df / (df + t * t))


def t_ppf_upper(level: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Positive t with P(|T| <= t) = level.

    The probability is concave in t > 0 and the normal quantile lies below the root, so
    Newton's method climbs to the root from there without overshooting.
    """
    from statistics import NormalDist

    t = np.array([NormalDist().inv_cdf(0.5 + 0.5 * p) for p in level])
    log_c = _log_gamma((df + 1.0) / 2.0) - _log_gamma(df / 2.0) - 0.5 * np.log(df * np.pi)
    for _ in range(60):
        density = 2.0 * np.exp(log_c - (df + 1.0) / 2.0 * np.log1p(t * t / df))
        step = (t_two_sided(t, df) - (1.0 - level)) / density
        t = t + step
        if np.all(np.abs(step) <= 1e-13 * (1.0 + t)):
            break
    return t


def _gamma_q(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma Q(a, x)."""
    out = np.ones_like(x)
    scale = np.exp(a * np.log(np.maximum(x, _TINY)) - x - _log_gamma(a))
    series = (x < a + 1.0) & (x > 0)
    if series.any():
        aa, xx = a[series], x[series]
        term = 1.0 / aa
        total, n = term.copy(), aa.copy()
        for _ in range(2000):
            n = n + 1.0
            term = term * xx / n
            total = total + term
            if np.all(np.abs(term) < np.abs(total) * 1e-16):
                break
        out[series] = 1.0 - total * scale[series]
    tail = x >= a + 1.0
    if tail.any():
        aa, xx = a[tail], x[tail]
        b = xx + 1.0 - aa
        c = np.full_like(xx, 1.0 / _TINY)
        d = 1.0 / b
        h = d.copy()
        for i in range(1, 2000):
            an = -i * (i - aa)
            b = b + 2.0
            d = an * d + b
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
            if np.all(np.abs(d * c - 1.0) < 1e-15):
                break
        out[tail] = scale[tail] * h
    return out


def _on_valid(fn, *series: pd.Series) -> pd.Series:
    arrays = [s.to_numpy(dtype=float, na_value=np.nan) for s in series]
    ok = np.all([np.isfinite(a) for a in arrays], axis=0) & (arrays[-1] > 0)
    out = np.full(len(arrays[0]), np.nan)
    if ok.any():
        out[ok] = fn(*[a[ok] for a in arrays])
    return pd.Series(out)  # NaN leaves the function as NULL


def t_quantile(level, df) -> Column:
    """Two-sided critical value: P(|T| <= q) = level."""
    @F.pandas_udf("double")
    def quantile(level: pd.Series, df: pd.Series) -> pd.Series:
        return _on_valid(t_ppf_upper, level, df)

    return quantile(level if isinstance(level, Column) else F.lit(float(level)), df)


def t_two_sided_p(t, df) -> Column:
    @F.pandas_udf("double")
    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        return _on_valid(t_two_sided, t, df)

    return tail(t, df)


def chi2_sf(x, df) -> Column:
    @F.pandas_udf("double")
    def tail(x: pd.Series, df: pd.Series) -> pd.Series:
        return _on_valid(lambda x, df: _gamma_q(df / 2.0, x / 2.0), x, df)

    return tail(x, df)
