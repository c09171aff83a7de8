"""Per-feature tests and linear models (inventory section H)."""
from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lamella.core import FEATURE, MAX_SAMPLES, bounded, checkpointed, vectors
from lamella.functions.ranking import bh, quantiles, row_numbers
from lamella.functions.special import digamma, f_pvalue, t_pvalue, trigamma_inverse
from lamella.operators import tall


def _grouped(m: DataFrame, meta: DataFrame, var: str) -> DataFrame:
    return m.join(meta.where(F.col(var).isNotNull()).select("sample", F.col(var).alias("_g")), "sample").where(F.col("value").isNotNull())


def t_test(m: DataFrame, meta: DataFrame | None = None, var: str | None = None, groups: list[str] | None = None,
           keys: list[str] = FEATURE, adjust: bool = True) -> DataFrame:
    """Pooled two-sample t (first minus second group, in sorted order), or one-sample against 0 without groups."""
    if var is None:
        s = m.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("diff"), F.var_samp("value").alias("_v"))
        r = s.select(*keys, "diff", (F.col("n") - 1.0).alias("df"), (F.col("diff") / F.sqrt(F.col("_v") / F.col("n"))).alias("stat"))
    else:
        g = groups or sorted(x[0] for x in bounded(meta.where(F.col(var).isNotNull()).select(var).distinct(), 1000, var))
        if len(g) != 2:
            raise ValueError("a t-test needs two groups")
        d = _grouped(m, meta, var).where(F.col("_g").isin(g))
        one = lambda k, f: f(F.when(F.col("_g") == g[k], F.col("value")))
        s = d.groupBy(*keys).agg(*[one(k, f).alias(f"{a}{k}") for k in (0, 1) for a, f in (("_n", F.count), ("_m", F.avg), ("_v", F.var_samp))])
        df = F.col("_n0") + F.col("_n1") - 2
        pooled = ((F.col("_n0") - 1) * F.col("_v0") + (F.col("_n1") - 1) * F.col("_v1")) / df
        diff = F.col("_m0") - F.col("_m1")
        r = s.select(*keys, diff.alias("diff"), df.cast("double").alias("df"),
                     (diff / F.sqrt(pooled * (1 / F.col("_n0") + 1 / F.col("_n1")))).alias("stat"))
    r = r.withColumn("pval", t_pvalue("stat", "df"))
    return bh(r, "pval", [k for k in keys if k != "feature"]) if adjust else r


def f_test(m: DataFrame, meta: DataFrame, var: str, equal_var: bool = True) -> DataFrame:
    """One-way F per feature; ``equal_var`` False is the Welch form."""
    s = _grouped(m, meta, var).groupBy(*FEATURE, "_g").agg(F.count("value").alias("n"), F.avg("value").alias("mn"), F.var_samp("value").alias("v"))
    n, mn, v = F.col("n"), F.col("mn"), F.col("v")
    if equal_var:
        t = s.groupBy(*FEATURE).agg(F.sum("n").alias("N"), F.count("*").alias("k"), F.sum((n - 1) * F.coalesce(v, F.lit(0.0))).alias("ssw"),
                                    F.sum(n * mn).alias("s1"), F.sum(n * mn * mn).alias("s2"))
        t = t.select(*FEATURE, (F.col("k") - 1.0).alias("df1"), (F.col("N") - F.col("k")).cast("double").alias("df2"),
                     ((F.col("s2") - F.col("s1") * F.col("s1") / F.col("N")) / (F.col("k") - 1) / (F.col("ssw") / (F.col("N") - F.col("k")))).alias("stat"))
    else:
        s = s.withColumn("w", n / v)
        c = s.groupBy(*FEATURE).agg(F.sum("w").alias("wsum"), F.sum(F.col("w") * mn).alias("wm"), F.count("*").alias("k"))
        d = s.join(c, FEATURE)
        t = d.groupBy(*FEATURE).agg(F.first("k").alias("k"),
                                    F.sum(F.col("w") * (mn - F.col("wm") / F.col("wsum")) ** 2).alias("a"),
                                    F.sum((1 - F.col("w") / F.col("wsum")) ** 2 / (n - 1)).alias("b"))
        k = F.col("k")
        t = t.select(*FEATURE, (k - 1.0).alias("df1"), ((k * k - 1) / (3 * F.col("b"))).alias("df2"),
                     ((F.col("a") / (k - 1)) / (1 + 2 * (k - 2) / (k * k - 1) * F.col("b"))).alias("stat"))
    return bh(t.withColumn("pval", f_pvalue("stat", "df1", "df2")), "pval", ["layer"])


# ---- linear models -------------------------------------------------------------------------

def _columns(x: pd.Series, full: bool) -> tuple[np.ndarray, list[str]]:
    if pd.api.types.is_numeric_dtype(x):
        return x.to_numpy(float)[:, None], [x.name]
    lev = sorted(x.unique())
    use = lev if full else lev[1:]
    return np.column_stack([(x == v).to_numpy(float) for v in use]) if use else np.empty((len(x), 0)), [str(v) for v in use]


def sample_frame(meta: DataFrame, cols: list[str]) -> pd.DataFrame:
    """Complete metadata rows on the driver, sorted by sample; at most MAX_SAMPLES."""
    rows = bounded(meta.select("sample", *cols).dropna(), MAX_SAMPLES, "metadata")
    return pd.DataFrame([r.asDict() for r in rows]).sort_values("sample").reset_index(drop=True)


def build_contrasts(levels: list[str], kind: str = "reference", ref: str | None = None, pair: tuple[str, str] | None = None,
                    pairs: list[tuple[str, str]] | None = None, nested_only: bool = True, extra: int = 0) -> tuple[np.ndarray, list[str]]:
    """Contrast matrix over cell means (plus ``extra`` covariate rows of zeros).

    reference: every level against ``ref``; pair: one custom pair; pairs: all pairs;
    nested: the difference of two pairs, with the pairs themselves unless ``nested_only``;
    interaction: difference of differences of a 2 x 2 combined factor in level order.
    """
    idx = {v: i for i, v in enumerate(levels)}
    p = len(levels) + extra

    def vec(a, b):
        c = np.zeros(p)
        c[idx[a]] += 1
        c[idx[b]] -= 1
        return c

    if kind == "reference":
        ref = ref or levels[0]
        out = [(f"{v}-{ref}", vec(v, ref)) for v in levels if v != ref]
    elif kind == "pair":
        out = [(f"{pair[0]}-{pair[1]}", vec(*pair))]
    elif kind == "pairs":
        out = [(f"{a}-{b}", vec(a, b)) for i, b in enumerate(levels) for a in levels[i + 1:]]
    elif kind == "nested":
        (a, b), (c, d) = pairs
        out = [(f"({a}-{b})-({c}-{d})", vec(a, b) - vec(c, d))]
        if not nested_only:
            out = [(f"{a}-{b}", vec(a, b)), (f"{c}-{d}", vec(c, d))] + out
    elif kind == "interaction":
        if len(levels) != 4:
            raise ValueError("an interaction needs a 2 x 2 factor")
        out = [("interaction", vec(levels[0], levels[1]) - vec(levels[2], levels[3]))]
    else:
        raise ValueError(kind)
    return np.column_stack([c for _, c in out]), [n for n, _ in out]


def design(pdf: pd.DataFrame, var: str, covars: list[str], kind: str) -> tuple[np.ndarray, list[str]]:
    if kind == "cont":
        parts = [np.ones((len(pdf), 1)), pdf[var].to_numpy(float)[:, None]]
        levels = []
    else:
        x, levels = _columns(pdf[var].astype(str), True)
        parts = [x]
    parts += [_columns(pdf[c], False)[0] for c in covars]
    x = np.column_stack(parts)
    if np.linalg.matrix_rank(x) < x.shape[1]:
        raise ValueError("the design is not of full rank")
    if len(x) - x.shape[1] < 1:
        raise ValueError("no residual degrees of freedom")
    return x, levels


FIT = "layer string, feature string, coef array<double>, unscaled array<double>, s2 double, df double, ave double, quad double, e double, tri double"


def _trigamma(x):
    s = np.zeros_like(x)
    y = x.copy()
    for _ in range(12):
        s += 1 / y ** 2
        y = y + 1
    return s + 1 / y + 1 / (2 * y ** 2) + 1 / (6 * y ** 3) - 1 / (30 * y ** 5)


def fit_rows(vecs: DataFrame, x: np.ndarray, c: np.ndarray, white: np.ndarray | None = None) -> DataFrame:
    """Least squares of every feature vector on one design, contrasts ``c``; rows with gaps use their own cells."""
    def solve(y, xx):
        v = np.linalg.inv(xx.T @ xx)
        b = y @ xx @ v
        ss = ((y - b @ xx.T) ** 2).sum(1)
        df = len(xx) - xx.shape[1]
        cv = c.T @ v @ c
        est = b @ c
        quad = np.einsum("ij,jk,ik->i", est, np.linalg.pinv(cv), est) / np.linalg.matrix_rank(cv)
        return est, np.sqrt(np.diag(cv)), ss / df, df, quad

    def run(it):
        for pdf in it:
            if not len(pdf):
                continue
            y = np.vstack(pdf["vec"].to_numpy())
            nan = np.isnan(y).any(1)
            q = c.shape[1]
            est, un = np.full((len(y), q), np.nan), np.full((len(y), q), np.nan)
            s2, df, quad = np.full(len(y), np.nan), np.full(len(y), np.nan), np.full(len(y), np.nan)
            if (~nan).any():
                yy = y[~nan] if white is None else y[~nan] @ white.T
                est[~nan], un[~nan], s2[~nan], df[~nan], quad[~nan] = solve(yy, x if white is None else white @ x)
            for r in np.flatnonzero(nan):
                ok = ~np.isnan(y[r])
                xx, yy = x[ok], y[r, ok][None, :]
                if white is not None:
                    w = np.linalg.inv(np.linalg.cholesky(np.linalg.inv(white.T @ white)[np.ix_(ok, ok)]))
                    xx, yy = w @ xx, yy @ w.T
                if ok.sum() > x.shape[1] and np.linalg.matrix_rank(xx) == x.shape[1]:
                    e, u, s, d, k = solve(yy, xx)
                    est[r], un[r], s2[r], df[r], quad[r] = e[0], u, s[0], d, k[0]
            with np.errstate(divide="ignore", invalid="ignore"):
                h = df / 2
                dg = np.array([digamma(v) if v > 0 else np.nan for v in np.unique(h[~np.isnan(h)])])
                lut = dict(zip(np.unique(h[~np.isnan(h)]), dg))
                e = np.log(np.maximum(s2, 1e-300)) - np.array([lut.get(v, np.nan) for v in h]) + np.log(h)
            out = pd.DataFrame({"layer": pdf["layer"], "feature": pdf["feature"], "coef": list(est), "unscaled": list(un), "s2": s2, "df": df,
                                "ave": np.nanmean(y, 1), "quad": quad, "e": e, "tri": _trigamma(np.where(h > 0, h, 1.0))})
            yield out[~np.isnan(s2)]

    return vecs.mapInPandas(run, FIT)


def moderate(fit: DataFrame) -> dict[str, tuple[float, float]]:
    """Prior variance and degrees of freedom per layer from the moments of the log variances."""
    out = {}
    for r in fit.where("s2 > 0").groupBy("layer").agg(F.avg("e").alias("m"), F.var_samp("e").alias("v"), F.avg("tri").alias("t"), F.count("*").alias("n")).collect():
        excess = (r["v"] or 0.0) - r["t"]
        if r["n"] < 3:
            out[r["layer"]] = (1.0, 0.0)
        elif excess > 0:
            d0 = 2 * trigamma_inverse(excess)
            out[r["layer"]] = (math.exp(r["m"] + digamma(d0 / 2) - math.log(d0 / 2)), d0)
        else:
            out[r["layer"]] = (math.exp(r["m"]), math.inf)
    return out


def block_correlation(vecs: DataFrame, x: np.ndarray, blocks: np.ndarray, trim: float = 0.15) -> float:
    """Consensus within-block correlation: trimmed mean of atanh of the per-feature moment estimate."""
    resid = np.eye(len(x)) - x @ np.linalg.pinv(x)
    ids = np.unique(blocks)
    ind = np.column_stack([(blocks == b).astype(float) for b in ids])
    size = ind.sum(0)
    n, k = len(blocks), len(ids)
    n0 = (n - (size ** 2).sum() / n) / max(k - 1, 1)

    def run(it):
        for pdf in it:
            y = np.vstack(pdf["vec"].to_numpy()) if len(pdf) else np.empty((0, n))
            ok = ~np.isnan(y).any(1)
            r = y[ok] @ resid
            mb = (r @ ind) / size
            ssb = (mb ** 2 * size).sum(1) - n * r.mean(1) ** 2
            ssw = (r ** 2).sum(1) - (mb ** 2 * size).sum(1)
            msb, msw = ssb / max(k - 1, 1), ssw / max(n - k - x.shape[1] + 1, 1)
            rho = np.clip((msb - msw) / (msb + (n0 - 1) * msw), -0.99 / max(size.max() - 1, 1), 0.99)
            yield pd.DataFrame({"layer": pdf["layer"][ok], "z": np.arctanh(rho)})

    z = checkpointed(vecs.mapInPandas(run, "layer string, z double").withColumn("all", F.lit(1)))
    q = quantiles(z, ["all"], "z", {"lo": trim, "hi": 1 - trim})
    return math.tanh(z.join(q, "all").where("z >= lo and z <= hi").agg(F.avg("z")).first()[0])


def lm_test(m: DataFrame, meta: DataFrame, var: str, ref: str | None = None, contrast: str | None = None,
            covars: list[str] | None = None, kind: str = "disc", block: str | None = None, contrasts: dict | None = None,
            prior: bool = True) -> DataFrame:
    """Moderated linear model per feature.

    ``contrast`` names one level to set against ``ref``; without it all levels are, and
    ``stat`` of the overall row set is F.  ``contrasts`` passes arguments to
    :func:`build_contrasts`.  Long result: one row per (feature, term).
    """
    covars = covars or []
    own = meta.join(m.select("sample").distinct(), "sample", "left_semi")
    if tall.many_samples(own.dropna(subset=["sample", var, *covars, *([block] if block else [])])):
        own = own.dropna(subset=[block]) if block else own
        dummies, levels = _design_columns(own, var, covars, kind)
        c, terms = _contrast_terms(levels, len(dummies.schema["row"].metadata["names"]), var, ref, contrast, kind, contrasts)
        fit = _fit_blocks(m, dummies, own.select("sample", F.col(block).cast("string").alias("block")), c) if block else _fit_sums(m, dummies, c)
        return _tested(m, checkpointed(fit), c, terms, prior)
    pdf = sample_frame(own, list(dict.fromkeys([var, *covars, *([block] if block else [])]))).reset_index(drop=True)
    x, levels = design(pdf, var, covars, kind)
    c, terms = _contrast_terms(levels, x.shape[1], var, ref, contrast, kind, contrasts)
    vecs = vectors(m, list(pdf["sample"]))
    white = None
    if block:
        b = pdf[block].astype(str).to_numpy()
        rho = block_correlation(vecs, x, b)
        v = np.where(b[:, None] == b[None, :], rho, 0.0)
        np.fill_diagonal(v, 1.0)
        white = np.linalg.inv(np.linalg.cholesky(v))
    return _tested(m, checkpointed(fit_rows(vecs, x, c, white)), c, terms, prior)


def _contrast_terms(levels: list[str], width: int, var: str, ref: str | None, contrast: str | None, kind: str, contrasts: dict | None) -> tuple[np.ndarray, list[str]]:
    if kind == "cont":
        return np.eye(width)[:, [1]], [var]
    args = contrasts or ({"kind": "pair", "pair": (contrast, ref or levels[0])} if contrast else {"kind": "reference", "ref": ref})
    return build_contrasts(levels, extra=width - len(levels), **args)


def _design_columns(meta: DataFrame, var: str, covars: list[str], kind: str) -> tuple[DataFrame, list[str]]:
    """``sample, row``: the columns of :func:`design` for every complete sample, and the levels; names stand in the column's metadata."""
    d = meta.select("sample", *dict.fromkeys([var, *covars])).dropna()
    numeric = lambda c: dict(d.dtypes)[c] in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
    distinct = lambda c: sorted(r[0] for r in bounded(d.select(c).distinct(), 1000, c))
    cols, levels = [], []
    if kind == "cont":
        cols += [("", F.lit(1.0)), (var, F.col(var).cast("double"))]
    else:
        seen = sorted((str(v), v) for v in distinct(var))
        levels = [s for s, _ in seen]
        cols += [(s, (F.col(var) == F.lit(v)).cast("double")) for s, v in seen]
    for c in covars:
        cols += [(c, F.col(c).cast("double"))] if numeric(c) else [(str(v), (F.col(c) == F.lit(v)).cast("double")) for v in distinct(c)[1:]]
    out = d.select("sample", F.array(*[x for _, x in cols]).alias("row", metadata={"names": [n for n, _ in cols]}))
    w = len(cols)
    pairs = [(i, j) for i in range(w) for j in range(i, w)]
    sums = out.agg(F.count("*"), *[F.sum(F.col("row")[i] * F.col("row")[j]) for i, j in pairs]).first()
    xx = np.zeros((w, w))
    for (i, j), v in zip(pairs, sums[1:]):
        xx[i, j] = xx[j, i] = v
    size = np.sqrt(np.diag(xx))
    if (size == 0).any() or np.linalg.matrix_rank(xx / np.outer(size, size), tol=1e-12) < w:
        raise ValueError("the design is not of full rank")
    if sums[0] - w < 1:
        raise ValueError("no residual degrees of freedom")
    return out, levels


def _fit_sums(m: DataFrame, dummies: DataFrame, c: np.ndarray) -> DataFrame:
    """``FIT`` of any number of samples: each feature's normal equations are sums over its own cells, added up before the shuffle."""
    w = len(dummies.schema["row"].metadata["names"])
    pairs = [(i, j) for i in range(w) for j in range(i, w)]
    d = m.where(F.col("value").isNotNull() & ~F.isnan("value")).join(dummies, "sample")
    d = d.join(d.groupBy(*FEATURE).agg(F.avg("value").alias("_m")), FEATURE).withColumn("_y", F.col("value") - F.col("_m"))
    r = F.col("row")
    s = d.groupBy(*FEATURE).agg(F.first("_m").alias("ave"), F.count("*").alias("n"), F.sum(F.col("_y") ** 2).alias("yy"),
                                F.array(*[F.sum(r[i] * F.col("_y")) for i in range(w)]).alias("xy"), F.array(*[F.sum(r[i] * r[j]) for i, j in pairs]).alias("xx"))

    def run(it):
        for pdf in it:
            rows = []
            for lay, f, ave, n, yy, xy, xx in pdf[["layer", "feature", "ave", "n", "yy", "xy", "xx"]].itertuples(index=False):
                g = np.zeros((w, w))
                for (i, j), v in zip(pairs, xx):
                    g[i, j] = g[j, i] = v
                size = np.sqrt(np.diag(g))
                if n <= w or (size == 0).any() or np.linalg.matrix_rank(g / np.outer(size, size), tol=1e-12) < w:
                    continue
                v = np.linalg.inv(g / np.outer(size, size)) / np.outer(size, size)
                b = v @ xy
                df = float(n - w)
                s2 = max(float(yy - b @ xy), 0.0) / df
                cv = c.T @ v @ c
                est = b @ c  # contrasts do not see the mean that was taken off
                h = df / 2
                rows.append((lay, f, est, np.sqrt(np.diag(cv)), s2, df, ave, est @ np.linalg.pinv(cv) @ est / np.linalg.matrix_rank(cv),
                             np.log(max(s2, 1e-300)) - digamma(h) + np.log(h), _trigamma(np.array([h]))[0]))
            yield pd.DataFrame(rows, columns=["layer", "feature", "coef", "unscaled", "s2", "df", "ave", "quad", "e", "tri"])

    return s.mapInPandas(run, FIT)


def _fit_blocks(m: DataFrame, dummies: DataFrame, blocks: DataFrame, c: np.ndarray, trim: float = 0.15) -> DataFrame:
    """``FIT`` under one correlation within blocks, of any number of samples.

    The inverse of a block's covariance is a multiple of the identity less a multiple of ones, so sums over a feature's cells of
    each block (``blocks``: ``sample, block``) are all that ``block_correlation`` and the whitened normal equations need.
    """
    w = len(dummies.schema["row"].metadata["names"])
    pairs = [(i, j) for i in range(w) for j in range(i, w)]
    total = dummies.count()
    d = m.where(F.col("value").isNotNull() & ~F.isnan("value")).join(dummies, "sample").join(blocks, "sample")
    d = d.join(d.groupBy(*FEATURE).agg(F.avg("value").alias("_m")), FEATURE).withColumn("_y", F.col("value") - F.col("_m"))
    r = F.col("row")
    s = d.groupBy(*FEATURE, "block").agg(F.first("_m").alias("ave"), F.count("*").cast("double").alias("n"), F.sum("_y").alias("y"), F.sum(F.col("_y") ** 2).alias("yy"),
                                         F.array(*[F.sum(r[i]) for i in range(w)]).alias("x"), F.array(*[F.sum(r[i] * F.col("_y")) for i in range(w)]).alias("xy"),
                                         F.array(*[F.sum(r[i] * r[j]) for i, j in pairs]).alias("xx"))
    s = checkpointed(s.groupBy(*FEATURE).agg(F.first("ave").alias("ave"), F.sort_array(F.collect_list(F.struct("block", "n", "y", "yy", "x", "xy", "xx"))).alias("b")))
    s = s.select(*FEATURE, "ave", *[F.col(f"b.{k}").alias(k) for k in ("n", "y", "yy", "x", "xy", "xx")])

    def sums(pdf):
        """``layer, feature, ave``, and by block: n, y, yy, x, xy; X'X of all; None for a design that is not of full rank."""
        for lay, f, ave, n, y, yy, x, xy, xx in pdf[["layer", "feature", "ave", "n", "y", "yy", "x", "xy", "xx"]].itertuples(index=False):
            g = np.zeros((w, w))
            for (i, j), v in zip(pairs, np.sum(np.vstack(list(xx)), 0)):
                g[i, j] = g[j, i] = v
            n, size = np.array(n), np.sqrt(np.diag(g))
            full = n.sum() > w and (size > 0).all() and np.linalg.matrix_rank(g / np.outer(size, size), tol=1e-12) == w
            yield lay, f, ave, n, np.array(y), float(np.sum(yy)), np.vstack(list(x)), np.sum(np.vstack(list(xy)), 0), g, size, full

    def inverse(g, size):
        return np.linalg.inv(g / np.outer(size, size)) / np.outer(size, size)

    def estimates(it):
        for pdf in it:
            rows = []
            for lay, f, _, n, y, yy, x, xy, g, size, full in sums(pdf):
                if n.sum() != total or not full:
                    continue  # a feature with gaps takes no part
                b, k, all_n = inverse(g, size) @ xy, len(n), n.sum()
                mb = (y - x @ b) / n
                within = (mb ** 2 * n).sum()
                ssb = within - (y - x @ b).sum() ** 2 / all_n
                msb, msw = ssb / max(k - 1, 1), (max(yy - b @ xy, 0.0) - within) / max(all_n - k - w + 1, 1)
                n0 = (all_n - (n ** 2).sum() / all_n) / max(k - 1, 1)
                rho = np.clip((msb - msw) / (msb + (n0 - 1) * msw), -0.99 / max(n.max() - 1, 1), 0.99)
                rows.append((lay, np.arctanh(rho)))
            yield pd.DataFrame(rows, columns=["layer", "z"])

    z = checkpointed(s.mapInPandas(estimates, "layer string, z double").withColumn("all", F.lit(1)))
    q = quantiles(z, ["all"], "z", {"lo": trim, "hi": 1 - trim})
    rho = math.tanh(z.join(q, "all").where("z >= lo and z <= hi").agg(F.avg("z")).first()[0])

    def run(it):
        for pdf in it:
            rows = []
            for lay, f, ave, n, y, yy, x, xy, g, size, full in sums(pdf):
                if not full:
                    continue
                less = rho / (1 + (n - 1) * rho)
                gw = (g - x.T @ (x * less[:, None])) / (1 - rho)
                xyw, yyw = (xy - x.T @ (y * less)) / (1 - rho), (yy - (y ** 2 * less).sum()) / (1 - rho)
                v = inverse(gw, np.sqrt(np.diag(gw)))
                b = v @ xyw
                df = float(n.sum() - w)
                s2 = max(float(yyw - b @ xyw), 0.0) / df
                cv = c.T @ v @ c
                est = b @ c
                h = df / 2
                rows.append((lay, f, est, np.sqrt(np.diag(cv)), s2, df, ave, est @ np.linalg.pinv(cv) @ est / np.linalg.matrix_rank(cv),
                             np.log(max(s2, 1e-300)) - digamma(h) + np.log(h), _trigamma(np.array([h]))[0]))
            yield pd.DataFrame(rows, columns=["layer", "feature", "coef", "unscaled", "s2", "df", "ave", "quad", "e", "tri"])

    return s.mapInPandas(run, FIT)


def _tested(m: DataFrame, fit: DataFrame, c: np.ndarray, terms: list[str], prior: bool) -> DataFrame:
    """Moderated statistics of every term of a fit."""
    pri = moderate(fit) if prior else {r[0]: (1.0, 0.0) for r in fit.select("layer").distinct().collect()}
    p = m.sparkSession.createDataFrame([(k, a, min(b, 1e10)) for k, (a, b) in pri.items()] or [("", 1.0, 0.0)], "layer string, s0 double, d0 double")
    post = (F.col("d0") * F.col("s0") + F.col("df") * F.col("s2")) / (F.col("d0") + F.col("df"))
    d = (fit.join(F.broadcast(p), "layer").withColumn("post", post).withColumn("df_total", F.least(F.col("df") + F.col("d0"), F.lit(1e10)))
         .withColumn("f_stat", F.col("quad") / F.col("post")).withColumn("f_df", F.lit(float(np.linalg.matrix_rank(c)))))
    names = F.array(*[F.lit(t) for t in terms])
    d = d.select(*FEATURE, "ave", F.sqrt("s2").alias("sigma"), "df", "df_total", "post", "f_stat", "f_df",
                 F.posexplode(F.arrays_zip("coef", "unscaled")).alias("_i", "_c"))
    d = d.select(*FEATURE, names[F.col("_i")].alias("term"), F.col("_c.coef").alias("coef"), "ave", "sigma", "df", "df_total",
                 (F.col("_c.coef") / (F.col("_c.unscaled") * F.sqrt("post"))).alias("stat"), "f_stat", "f_df")
    d = d.withColumn("pval", t_pvalue("stat", "df_total")).withColumn("f_pval", f_pvalue("f_stat", "f_df", "df_total"))
    return bh(d, "pval", ["layer", "term"])


def adjustment_effect(m: DataFrame, meta: DataFrame, var: str, covars: list[str], **kw) -> DataFrame:
    """-log10 p and FDR with and without covariates."""
    a, b = lm_test(m, meta, var, covars=covars, **kw), lm_test(m, meta, var, **kw)
    pick = lambda d, s: d.select(*FEATURE, "term", (-F.log10("pval")).alias(f"logp_{s}"), F.col("padj").alias(f"padj_{s}"), F.col("coef").alias(f"coef_{s}"))
    return pick(a, "adjusted").join(pick(b, "raw"), [*FEATURE, "term"])


def significant(df: DataFrame, p: float = 0.05, fc: float = 0.0, by: str = "padj", topn: int | None = None) -> DataFrame:
    """Features passing p and, over all terms, the largest |coef|; ``topn`` by p per layer when none pass."""
    s = df.groupBy(*FEATURE).agg(F.min(by).alias(by), F.max(F.abs("coef")).alias("max_coef"))
    ok = s.where((F.col(by) <= p) & (F.col("max_coef") >= fc))
    if topn is None:
        return ok
    none = s.select("layer").distinct().join(ok, "layer", "left_anti")
    top = row_numbers(s.join(none, "layer", "left_semi"), ["layer"], by, "feature").where(F.col("rn") <= topn).drop("rn")
    return ok.unionByName(top.select(*ok.columns))


def pairwise_lm(m: DataFrame, meta: DataFrame, var: str, **kw) -> DataFrame:
    """Every pair of levels in one model; the F over all of them for more than two groups."""
    return lm_test(m, meta, var, contrasts={"kind": "pairs"}, **kw)


def overall_f(m: DataFrame, meta: DataFrame, var: str, **kw) -> DataFrame:
    """One row per feature: F over all levels of ``var``, its p and FDR within the layer."""
    r = pairwise_lm(m, meta, var, **kw).groupBy(*FEATURE).agg(*[F.first(c).alias(c) for c in ("f_stat", "f_df", "df_total", "f_pval")])
    return bh(r, "f_pval", ["layer"]).withColumnRenamed("padj", "f_padj")


def membership(m: DataFrame, meta: DataFrame, var: str, fdr: float = 0.05) -> DataFrame:
    """Significant features per pairwise comparison, with the comparisons each belongs to."""
    r = pairwise_lm(m, meta, var).where(F.col("padj") < fdr)
    return r.groupBy(*FEATURE).agg(F.array_sort(F.collect_set("term")).alias("comparisons"), F.count("*").alias("n_comparisons"))


def lm_test_taxa(m: DataFrame, taxa: DataFrame, meta: DataFrame, var: str, transform=None, **kw) -> DataFrame:
    """The pairwise model at every taxonomic rank; the rank takes the place of the layer."""
    from lamella.operators.mapping import rollup_taxa
    d = rollup_taxa(m, taxa).select(F.col("rank").alias("layer"), "feature", "sample", "value")
    return pairwise_lm(transform(d) if transform else d, meta, var, **kw)
