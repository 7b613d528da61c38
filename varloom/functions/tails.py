"""Tails of Student's t, chi-squared, binomial and hypergeometric, for small result tables: vectorised, without SciPy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function of positive numbers: Stirling's series at x + 8, less the factors in between."""
    x = np.asarray(x, float)
    with np.errstate(divide="ignore"):
        below = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return _stirling(x + 8) - below


def _stirling(y: np.ndarray) -> np.ndarray:
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + _correction(y)


def _correction(y: np.ndarray) -> np.ndarray:
    """What Stirling's formula lacks of ln gamma, for numbers of 8 and more."""
    z = 1 / (y * y)
    return (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188 - z * 691 / 360360))))) / y


def regular_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction, evaluated backwards.

    The number of steps that it needs near its mean grows with the square root of a + b.
    """
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    fraction = np.ones_like(y)
    steps = 200 + 4 * int(math.sqrt(np.max(p + q, initial=0.0)))
    for m in range(steps, 0, -1):
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m - 1) * (p + q + m - 1) * y / ((p + 2 * m - 2) * (p + 2 * m - 1))
        fraction = 1 + odd / (1 + even / fraction)
    with np.errstate(divide="ignore"):
        front = np.exp(p * np.log(y) + q * np.log1p(-y) + _log_gamma(p + q) - _log_gamma(p) - _log_gamma(q)) / p
    out = front / fraction
    return np.where(swap, 1 - out, out)


def upper_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function: by the series below a + 1, by the continued fraction above.

    Near x = a both need some ten times the square root of a steps, so arguments are taken together by the size of a.
    The factor in front is worked out from (x - a) / a for large a, where a * ln(x) - x - ln gamma(a) would lose its digits.
    """
    a, x = (np.array(v, float) for v in np.broadcast_arrays(a, x))
    shape, a, x = a.shape, a.ravel(), np.maximum(x.ravel(), 0.0)
    out = np.ones(a.shape)
    size = np.floor(np.log2(np.maximum(np.where(np.isfinite(a), a, 1.0), 1.0)) / 2).astype(int)
    for k in np.unique(size[x > 0]):
        at = np.flatnonzero((size == k) & (x > 0))
        out[at] = _upper_gamma(a[at], x[at], 300 + 20 * 2 ** int(k))
    return out.reshape(shape)


def _upper_gamma(a: np.ndarray, x: np.ndarray, steps: int) -> np.ndarray:
    large = a >= 64
    far = (x - a) / a
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        log_front = np.where(
            large, a * (np.log1p(far) - far) + 0.5 * np.log(np.maximum(a, 1) / (2 * math.pi)) - _correction(np.maximum(a, 64)), a * np.log(x) - x - _log_gamma(a)
        )
        out, low = np.exp(log_front), x < a + 1
        if low.any():
            p, y = a[low], x[low]
            term = total = 1 / p
            for k in range(1, steps):
                term = term * y / (p + k)
                total = total + term
            out[low] = 1 - out[low] * total
        if not low.all():
            p, y = a[~low], x[~low]
            c = y + 2 * steps + 1 - p
            for k in range(steps, 0, -1):
                c = y + 2 * k - 1 - p - k * (k - p) / c
            out[~low] = out[~low] / c
    return out


def least_r(df: int, p: float) -> float:
    """The smallest correlation whose two-sided p, with ``df`` degrees of freedom, is ``p`` or less."""
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        if float(regular_beta(df / 2, 0.5, 1 - middle * middle)) > p:
            low = middle
        else:
            high = middle
    return high


@pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t."""
    v, n = t.astype(float).to_numpy(), df.astype(float).to_numpy()
    ok = np.isfinite(v) & (n > 0)
    out = np.full(len(v), np.nan)
    out[ok] = regular_beta(n[ok] / 2, 0.5, n[ok] / (n[ok] + v[ok] ** 2))
    return pd.Series(out).where(ok, None)


@pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of chi-squared."""
    v, n = x.astype(float).to_numpy(), df.astype(float).to_numpy()
    ok = np.isfinite(v) & (n > 0)
    out = np.full(len(v), np.nan)
    out[ok] = upper_gamma(n[ok] / 2, v[ok] / 2)
    return pd.Series(out).where(ok, None)


@pandas_udf(DoubleType())
def binomial_upper(n: pd.Series, k: pd.Series, p: pd.Series) -> pd.Series:
    """P(X > k) of n trials with probability p; null where one of them is missing."""
    a, b, x = (v.astype(float).to_numpy() for v in (n, k, p))
    out = np.where(b < 0, 1.0, 0.0)
    ok = (b >= 0) & (b < a)
    out[ok] = regular_beta(b[ok] + 1, a[ok] - b[ok], x[ok])
    return pd.Series(out).where(~(np.isnan(a) | np.isnan(b) | np.isnan(x)), None)


def _hypergeometric_sum(first: np.ndarray, last: np.ndarray, drawn: np.ndarray, marked: np.ndarray, total: np.ndarray, step: int) -> np.ndarray:
    """Sums of the probabilities of ``first`` to ``last`` hits, from the end nearest the mode on (``step`` 1 or -1), until terms add nothing."""
    g, i = _log_gamma, first.astype(float)
    log = g(marked + 1) - g(i + 1) - g(marked - i + 1) + g(total - marked + 1) - g(drawn - i + 1) - g(total - marked - drawn + i + 1) - g(total + 1) + g(drawn + 1) + g(total - drawn + 1)
    sums, term = np.zeros(len(i)), np.ones(len(i))
    active = np.flatnonzero((last - i) * step >= 0)
    while len(active):
        k, d, m, t = i[active], drawn[active], marked[active], total[active]
        sums[active] += term[active]
        term[active] *= k * (t - m - d + k) / ((m - k + 1) * (d - k + 1)) if step < 0 else (m - k) * (d - k) / ((k + 1) * (t - m - d + k + 1))
        i[active] += step
        active = active[((last[active] - i[active]) * step >= 0) & (term[active] > 1e-18 * sums[active])]
    return np.exp(log + np.log(np.maximum(sums, 1e-300))) * (sums > 0)


def hypergeometric(hits: np.ndarray, drawn: np.ndarray, marked: np.ndarray, total: np.ndarray) -> np.ndarray:
    """P(X >= hits) when ``drawn`` of ``total`` are drawn and ``marked`` are marked."""
    h, d, m, t = (np.asarray(v, float) for v in (hits, drawn, marked, total))
    least, most = np.maximum(0, m + d - t), np.minimum(d, m)
    out = np.where(h <= least, 1.0, 0.0)
    inside = (h > least) & (h <= most)
    up, down = inside & (h > d * m / t), inside & ~(h > d * m / t)
    out[up] = np.minimum(1, _hypergeometric_sum(h[up], most[up], d[up], m[up], t[up], 1))
    out[down] = np.maximum(0, 1 - _hypergeometric_sum(h[down] - 1, least[down], d[down], m[down], t[down], -1))
    return out


@pandas_udf(DoubleType())
def hypergeometric_upper(hits: pd.Series, drawn: pd.Series, marked: pd.Series, total: pd.Series) -> pd.Series:
    """P(X >= hits); null where a number is missing.  Each set of numbers of a batch is worked out once."""
    sets = pd.DataFrame({"h": hits, "d": drawn, "m": marked, "t": total}).astype(float)
    known = sets.dropna().drop_duplicates()
    known["p"] = hypergeometric(*(known[c].to_numpy() for c in "hdmt"))
    return sets.merge(known, on=list("hdmt"), how="left")["p"]
