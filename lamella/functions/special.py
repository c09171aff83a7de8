"""Distribution functions Spark SQL lacks, as vectorized numpy helpers and pandas UDFs."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Lanczos approximation of log-gamma, g = 7, n = 9.
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
           -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6,
           1.5056327351493116e-7]


def lgamma(x):
    """log gamma for x > 0."""
    x = np.asarray(x, float)
    z = np.where(x < 0.5, 1.0 - x, x) - 1.0
    s = np.full_like(z, LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        s = s + c / (z + i)
    t = z + 7.5
    r = 0.5 * math.log(2 * math.pi) + (z + 0.5) * np.log(t) - t + np.log(s)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(x < 0.5, np.log(np.pi / np.abs(np.sin(np.pi * x))) - r, r)


def betainc(a, b, x):
    """Regularized incomplete beta I_x(a, b) by its continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    ok = (y > 0) & (y < 1)
    ys = np.where(ok, y, 0.5)
    tiny = 1e-300
    fix = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(ys)
    d = 1 / fix(1 - (p + q) * ys / (p + 1))
    h = d.copy()
    live = np.ones(ys.shape, bool)  # each element stops on its own, whatever its batch holds
    for m in range(1, 400):
        for num in (m * (q - m) * ys / ((p + 2 * m - 1) * (p + 2 * m)),
                    -(p + m) * (p + q + m) * ys / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / fix(1 + num * d)
            c = fix(1 + num / c)
            step = c * d
            h = np.where(live, h * step, h)
        live &= ~(np.abs(step - 1) < 1e-15)
        if not live.any():
            break
    with np.errstate(over="ignore", invalid="ignore"):
        front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(ys) + q * np.log1p(-ys)) / p
    r = np.where(ok, front * h, np.where(y <= 0, 0.0, 1.0))
    return np.where(np.isnan(x), np.nan, np.where(flip, 1 - r, r))


def norm_cdf(x):
    x = np.asarray(x, float)
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-x / math.sqrt(2))


def norm_ppf(p):
    """Normal quantile: a rational start, then Newton steps on the exact CDF."""
    p = np.asarray(p, float)
    q = np.clip(p, 1e-300, 1 - 1e-16)
    tail = np.minimum(q, 1 - q)
    t = np.sqrt(-2 * np.log(tail))
    x = t - (2.30753 + 0.27061 * t) / (1 + 0.99229 * t + 0.04481 * t * t)
    for _ in range(6):
        err = norm_cdf(-x) - tail
        x = x + err / np.maximum(np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi), 1e-300)
    x = np.where(q < 0.5, -x, x)
    return np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, x))


def t_two_sided(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    big = df > 1e7
    d = np.where(big, 1e7, df)
    p = betainc(d / 2, 0.5, d / (d + t * t))
    return np.where(big, 2 * norm_cdf(-np.abs(t)), np.where(np.isinf(t), 0.0, p))


def f_upper(f, d1, d2):
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    d2 = np.minimum(d2, 1e7)
    return np.where(f <= 0, 1.0, betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(f, 0))))


def hyper_upper(hits, size, universe, drawn):
    """P(X >= hits) drawing ``drawn`` of ``universe`` with ``size`` marked."""
    out = np.empty(len(hits))
    for i, (h, k, n, d) in enumerate(zip(hits, size, universe, drawn)):
        x = np.arange(int(h), int(min(k, d)) + 1, dtype=float)
        lc = lambda a, b: lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)
        out[i] = min(1.0, float(np.exp(lc(np.full_like(x, k), x) + lc(n - k, d - x) - lc(n, d)).sum())) if len(x) else 0.0
    return out


def fisher_two_sided(hits, size, universe, drawn):
    """Summed probability of the tables that are at most as likely as the given one (relative tolerance 1e-7)."""
    out = np.empty(len(hits))
    lc = lambda a, b: lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)
    for i, (h, k, n, d) in enumerate(zip(hits, size, universe, drawn)):
        x = np.arange(int(max(0, k + d - n)), int(min(k, d)) + 1, dtype=float)
        logs = lc(np.full_like(x, k), x) + lc(np.full_like(x, n - k), d - x)
        p = np.exp(logs - logs.max())
        out[i] = min(1.0, p[p <= p[int(h) - int(x[0])] * (1 + 1e-7)].sum() / p.sum())
    return out


def trigamma_inverse(x: float) -> float:
    """Solve trigamma(y) = x by Newton steps."""
    def tri(y, order):
        s = 0.0
        while y < 20:
            s += 1 / y ** 2 if order == 1 else -2 / y ** 3
            y += 1
        if order == 1:
            return s + 1 / y + 1 / (2 * y ** 2) + 1 / (6 * y ** 3) - 1 / (30 * y ** 5) + 1 / (42 * y ** 7)
        return s - 1 / y ** 2 - 1 / y ** 3 - 1 / (2 * y ** 4) + 1 / (6 * y ** 6) - 1 / (6 * y ** 8)
    if x > 1e7:
        return 1 / math.sqrt(x)
    if x < 1e-6:
        return 1 / x
    y = 0.5 + 1 / x
    for _ in range(60):
        t = tri(y, 1)
        dif = t * (1 - t / x) / tri(y, 2)
        y += dif
        if -dif / y < 1e-10:
            break
    return y


def digamma(x: float) -> float:
    s = 0.0
    while x < 10:
        s -= 1 / x
        x += 1
    f = 1 / (x * x)
    return s + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def _num(*cols):
    return [pd.to_numeric(c, errors="coerce").to_numpy(dtype=float, na_value=np.nan) for c in cols]


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    a, b = _num(t, df)
    return pd.Series(t_two_sided(a, b))


@F.pandas_udf(T.DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_upper(*_num(f, d1, d2)))


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    (a,) = _num(z)
    return pd.Series(2 * norm_cdf(-np.abs(a)))


@F.pandas_udf(T.DoubleType())
def normal_upper(z: pd.Series) -> pd.Series:
    (a,) = _num(z)
    return pd.Series(norm_cdf(-a))


@F.pandas_udf(T.DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    (a,) = _num(p)
    return pd.Series(norm_ppf(a))


@F.pandas_udf(T.DoubleType())
def hyper_pvalue(hits: pd.Series, size: pd.Series, universe: pd.Series, drawn: pd.Series) -> pd.Series:
    return pd.Series(hyper_upper(*_num(hits, size, universe, drawn)))


@F.pandas_udf(T.DoubleType())
def fisher_pvalue(hits: pd.Series, size: pd.Series, universe: pd.Series, drawn: pd.Series) -> pd.Series:
    """Two-sided Fisher p of a 2 x 2 table: tables with the same margins that are no likelier."""
    return pd.Series(fisher_two_sided(hits, size, universe, drawn))


def corr_pvalue(r: Column, n: Column) -> Column:
    """Two-sided p of a Pearson/Spearman coefficient."""
    df = n - 2
    return F.when(df < 1, F.lit(None)).when(F.abs(r) >= 1, F.lit(0.0)) \
        .otherwise(t_pvalue(r * F.sqrt(df / (1 - r * r)), df.cast("double")))


def hash_uniform(*cols: Column | str, seed: int = 0) -> Column:
    """Uniform in (0, 1) from keys and a seed: the same on every recomputation."""
    h = F.xxhash64(*cols, F.lit(seed))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(2 ** 53))
