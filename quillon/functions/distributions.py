"""Probability distributions as vectorised functions: closed forms natively, integrals by series and continued fractions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# closed forms


def expon_cdf(x: Column, rate: Column) -> Column:
    return F.when(x >= 0, 1 - F.exp(-rate * x))


def weibull_cdf(x: Column, shape: Column, scale: Column) -> Column:
    return F.when(x >= 0, 1 - F.exp(-F.pow(x / scale, shape)))


#: The series of ln Gamma behind a shift: to 1e-15 from SHIFT on.
SHIFT, SERIES = 10, [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188]


def gammaln(x: Column) -> Column:
    """ln Gamma(x) for positive x, as one native expression: Stirling's series of x + SHIFT, less the logarithms between."""
    z = x + SHIFT
    out = (z - 0.5) * F.ln(z) - z + F.lit(0.5 * math.log(2 * math.pi))
    for i, c in enumerate(SERIES):
        out = out + F.lit(c) / F.pow(z, F.lit(2 * i + 1))
    for i in range(SHIFT):
        out = out - F.ln(x + i)
    return F.when(x > 0, out)


def _ln_choose(n: Column, k: Column) -> Column:
    return gammaln(n + 1.0) - gammaln(k + 1.0) - gammaln(n - k + 1.0)


def _times_ln(n: Column, p: Column) -> Column:
    """n ln p, 0 if n is, minus infinity if p is."""
    return F.when(n == 0, F.lit(0.0)).when(p <= 0, F.lit(float("-inf"))).otherwise(n * F.ln(p))


def poisson_pmf(k: Column, mean: Column) -> Column:
    return F.when(k >= 0, F.exp(_times_ln(k, mean) - mean - gammaln(k + 1.0))).otherwise(F.lit(0.0))


def binom_pmf(k: Column, n: Column, p: Column) -> Column:
    inside = F.exp(_ln_choose(n, k) + _times_ln(k, p) + _times_ln(n - k, 1 - p))
    return F.when((k >= 0) & (k <= n), inside).otherwise(F.lit(0.0))


def negbinom_pmf(failures: Column, successes: Column, p: Column) -> Column:
    return F.exp(_ln_choose(failures + successes - 1, failures) + _times_ln(successes, p) + _times_ln(failures, 1 - p))


def hypgeom_pmf(k: Column, draws: Column, hits: Column, total: Column) -> Column:
    inside = F.exp(_ln_choose(hits, k) + _ln_choose(total - hits, draws - k) - _ln_choose(total, draws))
    return F.when((k >= 0) & (k <= hits) & (k <= draws) & (draws - k <= total - hits), inside).otherwise(F.lit(0.0))


def confidence_norm(alpha: Column, sd: Column, size: Column) -> Column:
    """Half the width of a mean's interval of confidence."""
    return norm_inv(1 - alpha / 2, F.lit(0.0), F.lit(1.0)) * sd / F.sqrt(size)


def confidence_t(alpha: Column, sd: Column, size: Column) -> Column:
    return t_inv(1 - alpha / 2, size - 1) * sd / F.sqrt(size)


def norm_pdf(x: Column, mean: Column, sd: Column) -> Column:
    z = (x - mean) / sd
    return F.exp(-z * z / 2) / (sd * F.lit(math.sqrt(2 * math.pi)))


# integrals, on numpy arrays


def _lgamma(x: np.ndarray) -> np.ndarray:
    z = np.asarray(x, float) + SHIFT
    out = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + sum(c / z ** (2 * i + 1) for i, c in enumerate(SERIES))
    return out - sum(np.log(x + i) for i in range(SHIFT))


def _erf(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    return np.sign(x) * gamma_p(np.full(x.shape, 0.5), x * x)


def gamma_p(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised lower incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.zeros(a.shape)
    front = np.exp(-x + a * np.log(np.maximum(x, 1e-300)) - _lgamma(a))
    small = x < a + 1
    term = 1 / a
    total, n = term.copy(), a.copy()
    for _ in range(500):
        n = n + 1
        term = term * x / n
        total += term
        if not (np.abs(term)[small] > 1e-17 * np.abs(total)[small]).any():
            break
    out = np.where(small, front * total, out)
    b = x + 1 - a
    c = np.full(a.shape, 1e300)
    d = 1 / np.where(b == 0, 1e-300, b)
    h = d.copy()
    for i in range(1, 500):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = b + an / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        h = h * d * c
        if not (np.abs(d * c - 1)[~small] > 1e-16).any():
            break
    out = np.where(small, out, 1 - front * h)
    return np.where(x <= 0, 0.0, out)


def beta_i(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    safe = np.clip(y, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(safe) + q * np.log1p(-safe)) / p
    tiny = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    c, d = np.ones(a.shape), 1 / tiny(1 - (p + q) * y / (p + 1))
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / tiny(1 + num * d)
            c = tiny(1 + num / c)
            h = h * d * c
        if not (np.abs(d * c - 1) > 1e-16).any():
            break
    out = np.where(flip, 1 - front * h, front * h)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def _once(fn, last: dict[bytes, np.ndarray], *cols: pd.Series) -> pd.Series:
    """A function of numbers, taken once of each different row of them; last holds what it gave for the rows before, which
    the next batch of a column of few values has again."""
    given = [c.to_numpy(float) for c in cols]
    row = np.zeros(len(given[0]), np.int64)
    for v in given:
        values, place = np.unique(v, return_inverse=True)
        if len(values) > 1:
            row = np.unique(row * len(values) + place, return_inverse=True)[1]
    _, first, place = np.unique(row, return_index=True, return_inverse=True)
    rows = np.stack([v[first] for v in given])
    if (key := rows.tobytes()) not in last:
        last.clear()
        last[key] = fn(*rows)
    return pd.Series(last[key][place])


def _vector(fn):
    """A Column function of up to three numbers."""

    def build(*cols: Column) -> Column:
        last: dict[bytes, np.ndarray] = {}
        if len(cols) == 1:
            def run(a: pd.Series) -> pd.Series:
                return _once(fn, last, a)
        elif len(cols) == 2:
            def run(a: pd.Series, b: pd.Series) -> pd.Series:
                return _once(fn, last, a, b)
        else:
            def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
                return _once(fn, last, a, b, c)
        return F.pandas_udf(run, "double")(*[c.cast("double") for c in cols])

    return build


norm_cdf_np = lambda x, mean, sd: 0.5 * (1 + _erf((x - mean) / (sd * math.sqrt(2))))
lognorm_cdf_np = lambda x, mean, sd: np.where(x > 0, norm_cdf_np(np.log(np.maximum(x, 1e-300)), mean, sd), 0.0)
gamma_cdf_np = lambda x, shape, scale: gamma_p(shape, x / scale)
chisq_cdf_np = lambda x, df: gamma_p(df / 2, x / 2)
f_cdf_np = lambda x, d1, d2: beta_i(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2))
t_cdf_np = lambda x, df: np.where(x >= 0, 1 - 0.5 * beta_i(df / 2, 0.5, df / (df + x * x)), 0.5 * beta_i(df / 2, 0.5, df / (df + x * x)))



def _inverse(cdf, low: float | None):
    """The value at which a distribution function, growing from `low` (None: without end), reaches p: an interval is doubled
    until it holds the value, then cut by Chandrupatla's method, an inverse parabola where three points allow it and else the
    middle, until nothing lies between its ends. NaN outside 0 < p < 1."""

    def solve(p: np.ndarray, *params: np.ndarray) -> np.ndarray:
        p = np.asarray(p, float)
        ok = (p > 0) & (p < 1)
        q = np.where(ok, p, 0.5)
        a, b = np.full(p.shape, -1.0 if low is None else low), np.full(p.shape, 1.0)
        for _ in range(400):
            under = cdf(b, *params) < q
            over = (cdf(a, *params) > q) if low is None else np.zeros(p.shape, bool)
            if not (under | over).any():
                break
            b, a = np.where(under, 2 * b, b), np.where(over, 2 * a, a)
        out = (a + b) / 2
        left = np.arange(p.size)  # what has no value yet; all below is of these alone
        params = [np.broadcast_to(np.asarray(v, float), p.shape) for v in params]
        fa, fb = cdf(a, *params) - q, cdf(b, *params) - q
        t = np.full(p.shape, 0.5)
        for _ in range(400):
            x = a + t * (b - a)
            f = cdf(x, *params) - q
            same = np.sign(f) == np.sign(fa)
            c, fc = np.where(same, a, b), np.where(same, fa, fb)
            b, fb = np.where(same, b, a), np.where(same, fb, fa)
            a, fa = x, f
            best = np.where(np.abs(fa) < np.abs(fb), a, b)
            out[left] = best
            gap = np.abs(b - a)
            least = 2 * np.finfo(float).eps * np.abs(best) + 1e-300
            go = (gap > 2 * least) & (fa != 0) & (fb != 0)
            if not go.any():
                break
            left, q, a, b, c, fa, fb, fc, least, gap = (v[go] for v in (left, q, a, b, c, fa, fb, fc, least, gap))
            params = [v[go] for v in params]
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                xi, phi = (a - b) / (c - b), (fa - fb) / (fc - fb)
                curved = (phi**2 < xi) & ((1 - phi) ** 2 < 1 - xi)
                t = fa / (fb - fa) * fc / (fb - fc) + (c - a) / (b - a) * fa / (fc - fa) * fb / (fc - fb)
            t = np.where(curved & np.isfinite(t), t, 0.5)
            t = np.clip(t, least / gap, 1 - least / gap)
        return np.where(ok, out, np.nan)

    return solve


norm_inv_np, t_inv_np = _inverse(norm_cdf_np, None), _inverse(t_cdf_np, None)
chisq_inv_np, gamma_inv_np, f_inv_np, lognorm_inv_np = (_inverse(f, 0.0) for f in (chisq_cdf_np, gamma_cdf_np, f_cdf_np, lognorm_cdf_np))
norm_inv, t_inv, chisq_inv, gamma_inv, f_inv, lognorm_inv = map(_vector, (norm_inv_np, t_inv_np, chisq_inv_np, gamma_inv_np, f_inv_np, lognorm_inv_np))
beta_inv = _vector(_inverse(lambda x, a, b: beta_i(a, b, x), 0.0))

norm_cdf, lognorm_cdf, gamma_cdf, f_cdf = map(_vector, (norm_cdf_np, lognorm_cdf_np, gamma_cdf_np, f_cdf_np))
beta_cdf, chisq_cdf, t_cdf = _vector(lambda x, a, b: beta_i(a, b, x)), _vector(chisq_cdf_np), _vector(t_cdf_np)
