"""Dimension reduction and integration (inventory section K).

Features stay distributed.  What the driver sees is a Gram matrix of samples or an
N x k block, both summed on the executors; feature weights are row-local functions
of a broadcast basis, so iterative methods need one pass per round and keep no
per-feature state between rounds.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from lamella.core import FEATURE, bounded, checkpointed, sample_ids, shared_samples, vectors, with_stats
from lamella.functions.ranking import row_numbers
from lamella.operators import tall
from lamella.operators.blocks import fold_rows

LOAD = "layer string, feature string, factor int, value double"


@dataclass
class Reduction:
    """scores (sample, factor, value), loadings (layer, feature, factor, value), var_exp (layer, factor, value)."""
    scores: DataFrame
    loadings: DataFrame
    var_exp: DataFrame
    info: dict


def prepare(x: np.ndarray, center: bool = True, scale: bool = False) -> np.ndarray:
    """Centred (and scaled) rows; missing cells become 0, the row mean."""
    if center:
        x = x - np.nanmean(x, axis=1, keepdims=True)
    if scale:
        sd = np.nanstd(x, axis=1, ddof=1, keepdims=True)
        x = x / np.where(sd > 0, sd, 1.0)
    return np.nan_to_num(x)


def _mat(pdf):
    return np.vstack(pdf["vec"].to_numpy())


def grams(vecs: DataFrame, prep) -> dict[str, np.ndarray]:
    """Sample-by-sample Gram matrix of each layer, in one pass."""
    def fn(pdf):
        return {lay: (lambda x: x.T @ x)(prep(_mat(g), lay)) for lay, g in pdf.groupby("layer", sort=False)}
    return fold_rows(vecs, fn)


def _eig(g: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    w, u = np.linalg.eigh(g)
    w, u = np.maximum(w[::-1][:k], 0), u[:, ::-1][:, :k]
    sign = np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])
    return w, u * np.where(sign == 0, 1, sign)


def _scores_df(spark, order, mat, extra: str | None = None) -> DataFrame:
    rows = [((extra,) if extra is not None else ()) + (s, j + 1, float(mat[i, j])) for i, s in enumerate(order) for j in range(mat.shape[1])]
    return spark.createDataFrame(rows, ("layer string, " if extra is not None else "") + "sample string, factor int, value double")


def _var_df(spark, rows) -> DataFrame:
    return spark.createDataFrame([(l, j + 1, float(v)) for l, vs in rows for j, v in enumerate(vs)], "layer string, factor int, value double")


def loadings(vecs: DataFrame, fn) -> DataFrame:
    """``fn(matrix, layer)`` -> rows x k; long loadings."""
    def run(it):
        for pdf in it:
            for lay, g in pdf.groupby("layer", sort=False):
                w = fn(_mat(g), lay)
                k = w.shape[1]
                yield pd.DataFrame({"layer": lay, "feature": np.repeat(g["feature"].to_numpy(), k), "factor": np.tile(np.arange(1, k + 1), len(g)), "value": w.ravel()})
    return vecs.mapInPandas(run, LOAD)


def local_scores(scores: DataFrame) -> tuple[list[str], np.ndarray]:
    """N x k score matrix on the driver (N checked)."""
    order = sample_ids(scores)
    p = scores.select("sample", "factor", "value").toPandas().pivot(index="sample", columns="factor", values="value").loc[order]
    return order, p.to_numpy(float)


def pca(m: DataFrame, k: int = 5, scale: bool = False) -> Reduction:
    """PCA of samples in each layer: scores carry the layer, variance in percent."""
    if tall.many_samples(m):
        return _pca_tall(m, k, scale, False)
    order = sample_ids(m)
    vecs = vectors(m, order)
    gs = grams(vecs, lambda x, lay: prepare(x, True, scale))
    spark, basis, sc, ve = m.sparkSession, {}, None, []
    for lay, g in sorted(gs.items()):
        w, u = _eig(g, k)
        basis[lay] = u / np.sqrt(np.where(w > 1e-12, w, np.inf))
        part = _scores_df(spark, order, u * np.sqrt(w), lay)
        sc = part if sc is None else sc.unionByName(part)
        ve.append((lay, 100 * w / np.trace(g)))
    return Reduction(sc, loadings(vecs, lambda x, lay: prepare(x, True, scale) @ basis[lay]), _var_df(spark, ve), {})


def combined_pca(m: DataFrame, k: int = 5, scale: bool = True) -> Reduction:
    """PCA of all layers stacked; factors padded with zeros up to ``k``."""
    if tall.many_samples(m):
        return _pca_tall(m, k, scale, True)
    order = sample_ids(m)
    vecs = vectors(m, order)
    gs = grams(vecs, lambda x, lay: prepare(x, True, scale))
    g = sum(gs.values())
    w, u = _eig(g, k)
    if len(w) < k:
        w, u = np.pad(w, (0, k - len(w))), np.pad(u, ((0, 0), (0, k - u.shape[1])))
    basis = u / np.sqrt(np.where(w > 1e-12, w, np.inf))
    ve = [("all", 100 * w / np.trace(g))] + [(lay, 100 * np.einsum("ij,ik,kj->j", u, gl, u) / np.trace(gl)) for lay, gl in sorted(gs.items())]
    return Reduction(_scores_df(m.sparkSession, order, u * np.sqrt(w)), loadings(vecs, lambda x, lay: prepare(x, True, scale) @ basis),
                     _var_df(m.sparkSession, ve), {})


def _pca_tall(m: DataFrame, k: int, scale: bool, stacked: bool) -> Reduction:
    """The same tables from products of features: their eigenvectors are the loadings, scores are sums over a sample's cells."""
    spark, t = m.sparkSession, tall.sample_rows(m)
    unit = t.unit() if scale else np.ones(len(t.keys))
    c = tall.products(t)["xy"] / np.outer(unit, unit)
    parts = t.layers()
    groups = {"all": np.arange(len(t.keys))} if stacked else parts
    vec, val = np.zeros((len(t.keys), len(groups) * k)), {}
    for j, (g, ix) in enumerate(groups.items()):
        val[g], vec[ix, j * k:(j + 1) * k] = tall.axes(c[np.ix_(ix, ix)], k)
    rows = checkpointed(tall.mapped(t, vec / unit[:, None]))
    sign = tall.signs(rows, vec.shape[1])
    vec *= sign
    rows = rows.withColumn("row", F.zip_with("row", F.array(*[F.lit(float(s)) for s in sign]), lambda x, s: x * s))
    everyone = m.where(F.col("sample").isNotNull()).select("sample").distinct()
    sc, load, ve = None, None, []
    for j, (g, ix) in enumerate(groups.items()):
        part = tall.long_scores(rows, everyone, k, j * k)
        part = part if stacked else part.select(F.lit(g).alias("layer"), "sample", "factor", "value")
        sc = part if sc is None else sc.unionByName(part)
        own = tall.feature_table(spark, [t.keys[i] for i in ix], vec[ix, j * k:(j + 1) * k])
        load = own if load is None else load.unionByName(own)
        ve.append((g, 100 * val[g] / (np.trace(c[np.ix_(ix, ix)]) or 1.0)))
    if stacked:
        root = np.where(val["all"] > 0, np.sqrt(val["all"]), np.inf)
        for lay, ix in parts.items():
            u = c[ix] @ vec / root  # products of the layer's features with the axes
            ve.append((lay, 100 * (u ** 2).sum(0) / (np.trace(c[np.ix_(ix, ix)]) or 1.0)))
    return Reduction(checkpointed(sc), load, _var_df(spark, ve), {"values": val})


def rv(m: DataFrame) -> DataFrame:
    """RV coefficient of each pair of layers."""
    if tall.many_samples(m):
        t = tall.sample_rows(m)
        c, at = tall.products(t)["xy"], t.layers()
        ss = lambda a, b: float((c[np.ix_(at[a], at[b])] ** 2).sum())
        rows = [(a, b, float(ss(a, b) / np.sqrt(ss(a, a) * ss(b, b)))) for a in at for b in at if a < b]
        return m.sparkSession.createDataFrame(rows, "layer1 string, layer2 string, rv double")
    order = sample_ids(m)
    gs = grams(vectors(m, order), lambda x, lay: prepare(x))
    names = sorted(gs)
    rows = [(a, b, float((gs[a] * gs[b]).sum() / np.sqrt((gs[a] ** 2).sum() * (gs[b] ** 2).sum()))) for i, a in enumerate(names) for b in names[i + 1:]]
    return m.sparkSession.createDataFrame(rows, "layer1 string, layer2 string, rv double")


def mcia(m: DataFrame, k: int = 5) -> Reduction:
    """Co-inertia of layers under non-symmetric correspondence analysis.

    A layer is shifted to be positive, features become profiles over samples minus
    the sample margin, weighted by their share; tables are divided by their inertia.
    Each axis maximizes the sum of squared covariances; tables are then deflated by
    their own axis.
    """
    if tall.many_samples(m):
        return _mcia_tall(m, k)
    order = sample_ids(m)
    n = len(order)
    vecs = vectors(m, order)
    low = {r[0]: min(r[1], 0.0) for r in m.groupBy("layer").agg(F.min("value")).collect()}
    fill = lambda x, lay: np.where(np.isnan(x), 0.0, x - low[lay])
    margin = fold_rows(vecs, lambda pdf: {lay: fill(_mat(g), lay).sum(0) for lay, g in pdf.groupby("layer", sort=False)})

    def prep(x, lay):
        y = fill(x, lay)
        tot = margin[lay].sum()
        s = y.sum(1, keepdims=True)
        c = margin[lay] / tot
        z = np.where(s > 0, y / np.where(s > 0, s, 1), c) - c
        return z * np.sqrt(s / tot)

    gs = grams(vecs, prep)
    inertia = {lay: np.trace(g) for lay, g in gs.items()}
    axes, cov, block = _coinertia({lay: g / inertia[lay] for lay, g in gs.items()}, min(k, n - 1))
    load = lambda x, lay: _coinertia_loadings(prep(x, lay) / np.sqrt(inertia[lay]), block[lay])
    spark = m.sparkSession
    return Reduction(_scores_df(spark, order, np.column_stack(axes)), loadings(vecs, load), _var_df(spark, sorted(cov.items())),
                     {"layer_scores": {lay: np.column_stack([t for _, _, t in b]) for lay, b in block.items()}})


def _coinertia(cur: dict[str, np.ndarray], k: int) -> tuple[list, dict, dict]:
    """Axes, and by layer their covariances and ``(axis, root of its covariance, layer score)``, from the products of samples or of their coordinates."""
    axes, cov, block = [], {lay: [] for lay in cur}, {lay: [] for lay in cur}
    for _ in range(k):
        _, u = _eig(sum(cur.values()), 1)
        v = u[:, 0]
        axes.append(v)
        for lay, g in cur.items():
            gv = g @ v
            c = float(v @ gv)
            cov[lay].append(c)
            t = gv / np.sqrt(max(c, 1e-300))
            block[lay].append((v, np.sqrt(max(c, 1e-300)), t))
            cur[lay] = g - np.outer(gv, gv) / max(c, 1e-300)

    return axes, cov, block


def _coinertia_loadings(z: np.ndarray, block: list) -> np.ndarray:
    out = []
    for v, c, t in block:
        w = z @ v / c
        out.append(w)
        z = z - np.outer(w, t)
    return np.column_stack(out)


def _mcia_tall(m: DataFrame, k: int) -> Reduction:
    """The same in coordinates: a sample's row follows from its own cells and totals of features, and axes use inner products only."""
    spark, t = m.sparkSession, tall.sample_rows(m)
    at, everyone = t.layers(), m.where(F.col("sample").isNotNull()).select("sample").distinct()
    n = everyone.count()
    low = {r[0]: min(r[1], 0.0) for r in m.groupBy("layer").agg(F.min("value")).collect() if r[1] is not None}
    shift = t.mean - np.array([low[lay] for lay, _ in t.keys])
    s = t.n * shift  # totals of the features, as the rows are off their means
    tot = {lay: s[ix].sum() for lay, ix in at.items()}

    def prep(x):
        y = np.where(np.isnan(x), 0.0, x + shift)
        out = np.zeros_like(y)
        for lay, ix in at.items():
            c = y[:, ix].sum(1, keepdims=True) / tot[lay]
            out[:, ix] = np.where(s[ix] > 0, y[:, ix] / np.where(s[ix] > 0, s[ix], 1) - c, 0.0) * np.sqrt(np.maximum(s[ix], 0) / tot[lay])
        return out

    p = len(t.keys)
    a, back = tall.coordinates(fold_rows(t.rows, lambda pdf: {"c": sum((lambda z: z.T @ z)(prep(x)) for _, x in tall.matrices(pdf, p))})["c"], 1e-14)
    gs = {lay: a[:, ix] @ a[:, ix].T for lay, ix in at.items()}
    inertia = {lay: np.trace(g) for lay, g in gs.items()}
    axes, cov, block = _coinertia({lay: g / inertia[lay] for lay, g in gs.items()}, min(k, n - 1))
    turn = back @ np.column_stack(axes)

    def score(it):
        for pdf in it:
            for part, x in tall.matrices(pdf, p):
                yield pd.DataFrame({"sample": part["sample"], "row": list(prep(x) @ turn)})

    rows = checkpointed(t.rows.mapInPandas(score, "sample string, row array<double>"))
    sign = tall.signs(rows, len(axes))
    rows = rows.withColumn("row", F.zip_with("row", F.array(*[F.lit(float(v)) for v in sign]), lambda x, v: x * v))
    load = None
    for lay, ix in at.items():
        part = tall.feature_table(spark, [t.keys[i] for i in ix], _coinertia_loadings(a[:, ix].T / np.sqrt(inertia[lay]), block[lay]) * sign)
        load = part if load is None else load.unionByName(part)
    return Reduction(tall.long_scores(rows, everyone, len(axes)), load, _var_df(spark, sorted(cov.items())), {})


def _start(order: list[str], k: int, seed: int) -> np.ndarray:
    """Deterministic start: a seeded generator over the sorted sample order."""
    return np.random.default_rng(seed).random((len(order), k))


def factor_model(m: DataFrame, k: int | None = None, rounds: int = 20, min_r2: float = 1e-4, seed: int = 1) -> Reduction:
    """Multi-view Gaussian factor model with relevance priors per view and factor.

    One pass per round: each feature solves its weight posterior from the current
    factors (its noise by a short fixed point), and adds to sums of shape N x k x k,
    N x k and view x k.
    """
    if tall.many_samples(m):
        return _factor_model_tall(m, k, rounds, min_r2)
    order = sample_ids(m)
    n = len(order)
    k = k or (5 if n < 15 else 10 if n < 50 else 15 if n < 250 else 20 if n < 1000 else 25)
    k = min(k, n - 1)
    vecs = checkpointed(vectors(m, order))
    layers = sorted(r[0] for r in m.select("layer").distinct().collect())
    g = grams(vecs, lambda x, lay: prepare(x, True, True))
    w0, u0 = _eig(sum(v / np.trace(v) for v in g.values()), k)
    z, zc = u0 * np.sqrt(n), np.repeat(np.eye(k)[None] * 1e-3, n, 0)
    alpha = {lay: np.ones(k) for lay in layers}

    def weights(x, lay, z, zz, alpha):
        ok = (~np.isnan(x)).astype(float)
        y = np.nan_to_num(x - np.nanmean(x, 1, keepdims=True))
        cnt = ok.sum(1)
        ss = (y ** 2).sum(1)
        a = (ok @ zz.reshape(n, -1)).reshape(-1, k, k)
        b = y @ z
        tau = cnt / np.maximum(ss, 1e-12)
        for _ in range(3):
            s = np.linalg.inv(tau[:, None, None] * a + np.diag(alpha))
            w = tau[:, None] * np.einsum("fij,fj->fi", s, b)
            res = ss - 2 * (w * b).sum(1) + np.einsum("fi,fij,fj->f", w, a, w) + np.einsum("fij,fij->f", a, s)
            tau = (cnt + 2e-3) / (np.maximum(res, 1e-12) + 2e-3 * ss / np.maximum(cnt, 1))
        return y, ok, w, s, tau

    for _ in range(rounds):
        zz = zc + np.einsum("ni,nj->nij", z, z)
        cz, czz, ca = z, zz, alpha

        def fn(pdf):
            out = {}
            for lay, grp in pdf.groupby("layer", sort=False):
                y, ok, w, s, tau = weights(_mat(grp), lay, cz, czz, ca[lay])
                ww = s + np.einsum("fi,fj->fij", w, w)
                add = {"A": ok.T @ (tau[:, None] * ww.reshape(len(w), -1)), "B": y.T @ (tau[:, None] * w),
                       "w2:" + lay: np.einsum("fii->i", ww), "d:" + lay: np.array([float(len(w))])}
                for key, v in add.items():
                    out[key] = out.get(key, 0) + v
            return out

        s = fold_rows(vecs, fn)
        zc = np.linalg.inv(np.eye(k) + s["A"].reshape(n, k, k))
        z = np.einsum("nij,nj->ni", zc, s["B"])
        alpha = {lay: s["d:" + lay][0] / np.maximum(s["w2:" + lay], 1e-9) for lay in layers}
    zz = zc + np.einsum("ni,nj->nij", z, z)
    fz, fzz, fa = z, zz, alpha

    def r2(pdf):
        out = {}
        for lay, grp in pdf.groupby("layer", sort=False):
            y, ok, w, _, _ = weights(_mat(grp), lay, fz, fzz, fa[lay])
            per = np.array([((y - ok * np.outer(w[:, j], fz[:, j])) ** 2).sum() for j in range(k)])
            out["r:" + lay], out["t:" + lay] = per, np.array([(y ** 2).sum()])
        return out

    s = fold_rows(vecs, r2)
    expl = {lay: 1 - s["r:" + lay] / s["t:" + lay] for lay in layers}
    best = np.max([expl[lay] for lay in layers], axis=0)
    keep = [j for j in np.argsort(-sum(expl.values()), kind="stable") if best[j] >= min_r2] or [int(np.argmax(best))]
    spark = m.sparkSession
    return Reduction(_scores_df(spark, order, z[:, keep]), loadings(vecs, lambda x, lay: weights(x, lay, fz, fzz, fa[lay])[2][:, keep]),
                     _var_df(spark, [(lay, expl[lay][keep]) for lay in layers]), {})


def _factor_model_tall(m: DataFrame, k: int | None, rounds: int, min_r2: float) -> Reduction:
    """The same with samples as rows: a sample's factors follow from its own cells and the features' weights, so a round is one pass that
    adds up, for each feature, the sums its weights come from."""
    spark, t = m.sparkSession, tall.sample_rows(m)
    everyone = m.where(F.col("sample").isNotNull()).select("sample").distinct()
    n, p, at = everyone.count(), len(t.keys), t.layers()
    k = min(k or 25, n - 1)
    unit = t.unit()
    c = tall.products(t)["xy"]
    ss, cnt = np.diag(c).copy(), t.n
    c = c / np.outer(unit, unit)
    share = np.empty(p)
    for ix in at.values():
        share[ix] = 1 / np.sqrt(max(np.trace(c[np.ix_(ix, ix)]), 1e-300))
    e, u = tall.axes(c * np.outer(share, share), k)
    start = (share / unit)[:, None] * u * np.sqrt(n) * np.where(e > 0, 1 / np.sqrt(np.where(e > 0, e, 1)), 0.0)

    def factors(x, model):
        """Mean and covariance of each sample's factors."""
        if model is None:
            return np.nan_to_num(x) @ start, np.repeat(np.eye(k)[None] * 1e-3, len(x), 0)
        w, ww, tau = model
        zc = np.linalg.inv(np.eye(k) + ((~np.isnan(x)).astype(float) @ (tau[:, None] * ww.reshape(p, -1))).reshape(-1, k, k))
        return np.einsum("nij,nj->ni", zc, np.nan_to_num(x) @ (tau[:, None] * w)), zc

    def pieces(pdf):
        """A batch in slices of samples whose k x k matrices fit a task."""
        step = max(1, tall.CELLS // (k * k))
        for a in range(0, len(pdf), step):
            yield from tall.matrices(pdf.iloc[a:a + step], p)

    def sums(model):
        def fn(pdf):
            out = {"a": np.zeros((p, k * k)), "b": np.zeros((p, k)), "z2": np.zeros((p, k))}
            for _, x in pieces(pdf):
                z, zc = factors(x, model)
                ok = (~np.isnan(x)).astype(float)
                out["a"] += ok.T @ (zc + z[:, :, None] * z[:, None, :]).reshape(len(z), -1)
                out["b"] += np.nan_to_num(x).T @ z
                out["z2"] += ok.T @ z ** 2
            return out
        return fold_rows(t.rows, fn)

    def weights(s, alpha):
        a, b = s["a"].reshape(p, k, k), s["b"]
        tau = cnt / np.maximum(ss, 1e-12)
        for _ in range(3):
            v = np.linalg.inv(tau[:, None, None] * a + alpha[:, :, None] * np.eye(k))
            w = tau[:, None] * np.einsum("fij,fj->fi", v, b)
            res = ss - 2 * (w * b).sum(1) + np.einsum("fi,fij,fj->f", w, a, w) + np.einsum("fij,fij->f", a, v)
            tau = (cnt + 2e-3) / (np.maximum(res, 1e-12) + 2e-3 * ss / np.maximum(cnt, 1))
        return w, v + w[:, :, None] * w[:, None, :], tau

    alpha, model = np.ones((p, k)), None
    for _ in range(rounds):
        w, ww, tau = weights(sums(model), alpha)
        model = w, ww, tau
        for ix in at.values():
            alpha[ix] = len(ix) / np.maximum(np.einsum("fii->fi", ww[ix]).sum(0), 1e-9)
    last = sums(model)
    w = weights(last, alpha)[0]
    per = ss[:, None] - 2 * w * last["b"] + w ** 2 * last["z2"]
    expl = {lay: 1 - per[ix].sum(0) / ss[ix].sum() for lay, ix in at.items()}
    best = np.max(list(expl.values()), axis=0)
    keep = [j for j in np.argsort(-sum(expl.values()), kind="stable") if best[j] >= min_r2] or [int(np.argmax(best))]
    final = model

    def score(it):
        for pdf in it:
            for part, x in pieces(pdf):
                yield pd.DataFrame({"sample": part["sample"], "row": list(factors(x, final)[0][:, keep])})

    rows = t.rows.mapInPandas(score, "sample string, row array<double>")
    return Reduction(tall.long_scores(rows, everyone, len(keep)), tall.feature_table(spark, t.keys, w[:, keep]), _var_df(spark, [(lay, expl[lay][keep]) for lay in sorted(expl)]), {})


# ---- supervised block PLS ------------------------------------------------------------------

def outcome(meta: DataFrame, var: str, order: list[str]) -> tuple[np.ndarray, list[str]]:
    """Scaled outcome columns in sample order: dummies of a discrete variable, or the number itself."""
    from lamella.operators.differential import sample_frame
    s = sample_frame(meta, [var]).set_index("sample")[var].reindex(order)
    if pd.api.types.is_numeric_dtype(s):
        y, names = s.to_numpy(float)[:, None], [var]
    else:
        names = sorted(s.unique())
        y = np.column_stack([(s == v).to_numpy(float) for v in names])
    return y, names


def _center(g: np.ndarray) -> np.ndarray:
    g = g - g.mean(0, keepdims=True)
    return g - g.mean(1, keepdims=True)


def _block_components(gs: dict[str, np.ndarray], y: np.ndarray, k: int, design: float, rounds: int = 100, tol: float = 1e-9):
    """Block components in sample space: t_b = K_b z_b / sqrt(z_b' K_b z_b), z_b the design-weighted sum of the other scores."""
    return _components({**{b: g.copy() for b, g in gs.items()}, "_y": _center(y @ y.T)}, k, design, rounds, tol)


def _components(ks: dict[str, np.ndarray], k: int, design: float, rounds: int = 100, tol: float = 1e-9):
    """The same from the products of samples, or of their coordinates, of each block and ``_y``."""
    names = list(ks)
    comp = {b: [] for b in names}
    for _ in range(k):
        t = {b: _eig(kb, 1)[1][:, 0] for b, kb in ks.items()}
        ref = t["_y"]
        t = {b: v * (1 if v @ ref >= 0 else -1) for b, v in t.items()}
        z = {}
        for _ in range(rounds):
            move = 0.0
            for b in names:
                zb = sum((1.0 if "_y" in (b, c) else design) * np.sign((t[b] @ t[c]) or 1.0) * t[c] for c in names if c != b)
                q = zb @ ks[b] @ zb
                new = ks[b] @ zb / np.sqrt(max(q, 1e-300))
                move = max(move, np.abs(new - t[b]).max() / max(np.abs(new).max(), 1e-300))
                t[b], z[b] = new, zb / np.sqrt(max(q, 1e-300))
            if move < tol:
                break
        for b in names:
            comp[b].append((t[b], z[b]))
            if b != "_y":
                p = np.outer(t[b], t[b]) / max(t[b] @ t[b], 1e-300)
                r = np.eye(len(p)) - p
                ks[b] = r @ ks[b] @ r
    return comp


def block_pls(m: DataFrame, meta: DataFrame, var: str, k: int = 5, design: float = 0.1) -> Reduction:
    """Supervised integration: scores are the mean over layers of min-max scaled block scores, minus 0.5."""
    if tall.many_samples(m):
        return _block_pls_tall(m, meta, var, k, design)
    order = shared_samples(m, meta.where(F.col(var).isNotNull()))
    vecs = vectors(m, order)
    gs = grams(vecs, lambda x, lay: prepare(x, True, True))
    y, _ = outcome(meta, var, order)
    y = (y - y.mean(0)) / y.std(0, ddof=1)
    comp = _block_components(gs, y, k, design)
    mm = lambda a: (a - a.min(0)) / np.where(np.ptp(a, axis=0) > 0, np.ptp(a, axis=0), 1)
    blocks = {b: np.column_stack([t for t, _ in comp[b]]) for b in gs}
    joint = np.mean([mm(b) for b in blocks.values()], axis=0) - 0.5

    def load(x, lay):
        x = prepare(x, True, True)
        out = []
        for t, z in comp[lay]:
            out.append(x @ z)
            x = x - np.outer(x @ t, t) / (t @ t)
        return np.column_stack(out)

    raw = loadings(vecs, load)
    scaled = _scaled_loadings(raw)
    ve = [(b, [float(t @ gs[b] @ t / (t @ t) / np.trace(gs[b])) for t, _ in comp[b]]) for b in sorted(gs)]
    spark = m.sparkSession
    return Reduction(_scores_df(spark, order, joint), scaled, _var_df(spark, ve), {"blocks": blocks, "raw_loadings": raw})


def with_outcome(m: DataFrame, meta: DataFrame, var: str) -> DataFrame:
    """The cells of samples that have ``var``, and a layer ``_y``: one feature for each level, or the number itself."""
    y = meta.where(F.col(var).isNotNull()).select("sample", F.col(var).alias("_v")).join(m.select("sample").distinct(), "sample", "left_semi")
    if dict(y.dtypes)["_v"] in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean"):
        own = y.select(F.lit("_y").alias("layer"), F.lit(var).alias("feature"), "sample", F.col("_v").cast("double").alias("value"))
    else:
        levels = sorted(r[0] for r in bounded(y.select("_v").distinct(), 1000, var))
        own = y.select(F.lit("_y").alias("layer"), F.explode(F.array(*[F.lit(v) for v in levels])).alias("_l"), "sample", "_v").select(
            "layer", F.col("_l").cast("string").alias("feature"), "sample", (F.col("_v") == F.col("_l")).cast("double").alias("value"))
    return m.join(y.select("sample"), "sample", "left_semi").select("layer", "feature", "sample", "value").unionByName(own)


def _block_pls_tall(m: DataFrame, meta: DataFrame, var: str, k: int, design: float) -> Reduction:
    """The same in coordinates: the components lie in the span of all features and the outcome, and use inner products only."""
    spark, t = m.sparkSession, tall.sample_rows(with_outcome(m, meta, var))
    unit, at = t.unit(), t.layers()
    a, back = tall.coordinates(tall.products(t)["xy"] / np.outer(unit, unit))
    gs = {lay: a[:, ix] @ a[:, ix].T for lay, ix in at.items()}
    comp = _components({**{lay: g.copy() for lay, g in gs.items() if lay != "_y"}, "_y": gs["_y"].copy()}, k, design)
    lays = [lay for lay in gs if lay != "_y"]
    rows = checkpointed(tall.mapped(t, back @ np.column_stack([c for lay in lays for c, _ in comp[lay]]) / unit[:, None]))
    w = len(lays) * k
    ends = rows.agg(*[f(F.col("row")[j]) for j in range(w) for f in (F.min, F.max)]).first()
    lo, hi = np.array(ends[0::2]), np.array(ends[1::2])
    span = np.where(hi > lo, hi - lo, 1.0)
    scaled = [[(F.col("row")[i * k + j] - F.lit(float(lo[i * k + j]))) / F.lit(float(span[i * k + j])) for i in range(len(lays))] for j in range(k)]
    joint = rows.select("sample", F.posexplode(F.array(*[sum(own[1:], own[0]) / len(lays) - 0.5 for own in scaled])).alias("_j", "value")).select(
        "sample", (F.col("_j") + 1).alias("factor"), "value")
    raw = None
    for lay in lays:
        x, out = a[:, at[lay]].T, []
        for c, z in comp[lay]:
            out.append(x @ z)
            x = x - np.outer(x @ c, c) / (c @ c)
        part = tall.feature_table(spark, [t.keys[i] for i in at[lay]], np.column_stack(out))
        raw = part if raw is None else raw.unionByName(part)
    ve = [(lay, [float(c @ gs[lay] @ c / (c @ c) / np.trace(gs[lay])) for c, _ in comp[lay]]) for lay in lays]
    return Reduction(joint, _scaled_loadings(raw), _var_df(spark, ve), {"raw_loadings": raw})


def _scaled_loadings(raw: DataFrame) -> DataFrame:
    l = with_stats(raw, ["layer", "factor"], F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    return l.select(*FEATURE, "factor", ((F.col("value") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))).alias("value"))


def block_pls_cv(m: DataFrame, meta: DataFrame, var: str, k: int = 5, folds: int = 5, design: float = 0.1, seed: int = 1) -> DataFrame:
    """Balanced error rate by component count; class by weighted vote over layers at the largest predicted dummy.

    Folds only need sub-blocks of the Gram matrices, which one distributed pass has made; with more than ``MAX_SAMPLES``
    samples, products of features for each fold.
    """
    known = meta.where(F.col(var).isNotNull())
    if tall.many_samples(m.join(known.select("sample"), "sample", "left_semi")):
        ber = _block_pls_cv_tall(m, meta, var, k, folds, design, seed)
    else:
        order = shared_samples(m, known)
        gs = grams(vectors(m, order), lambda x, lay: prepare(x, True, True))
        y, names = outcome(meta, var, order)
        cls = y.argmax(1)
        rng = np.random.default_rng(seed)
        fold = np.empty(len(order), int)
        for c in range(len(names)):
            ix = rng.permutation(np.flatnonzero(cls == c))
            fold[ix] = np.arange(len(ix)) % folds
        ber = _cv_errors(gs, y, fold, folds, k, design)
    best = int(np.argmin(ber)) + 1
    return m.sparkSession.createDataFrame([(j + 1, ber[j], j + 1 == best) for j in range(k)], "ncomp int, error double, chosen boolean")


def _cv_errors(gs: dict[str, np.ndarray], y: np.ndarray, fold: np.ndarray, folds: int, k: int, design: float) -> list[float]:
    """Balanced error rate for 1 to ``k`` components, from the Gram matrices of all samples."""
    cls = y.argmax(1)
    pred = np.zeros((k, len(y)), int)
    for f in range(folds):
        tr, te = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        sub = {}
        for b, g in gs.items():
            mu = g[np.ix_(tr, tr)].mean(0)
            sub[b] = (_center(g[np.ix_(tr, tr)]), g[np.ix_(te, tr)] - g[np.ix_(te, tr)].mean(1, keepdims=True) - mu + mu.mean())
        ytr = y[tr]
        yc = (ytr - ytr.mean(0)) / np.where(ytr.std(0) > 0, ytr.std(0), 1)
        comp = _block_components({b: a for b, (a, _) in sub.items()}, yc, k, design)
        for j in range(1, k + 1):
            votes = np.zeros((len(te), y.shape[1]))
            for b, (ktr, kte) in sub.items():
                t_te, cross = [], kte.copy()
                for t, z in comp[b][:j]:
                    s = cross @ z
                    t_te.append(s)
                    r = np.eye(len(t)) - np.outer(t, t) / (t @ t)
                    cross = (cross - np.outer(s, t @ ktr) / (t @ t)) @ r
                    ktr = r @ ktr @ r
                tt = np.column_stack([t for t, _ in comp[b][:j]])
                yhat = ytr.mean(0) + np.column_stack(t_te) @ np.linalg.pinv(tt) @ (ytr - ytr.mean(0))
                wgt = abs(np.corrcoef(comp[b][j - 1][0], comp["_y"][j - 1][0])[0, 1])
                votes[np.arange(len(te)), yhat.argmax(1)] += np.nan_to_num(wgt)
            pred[j - 1, te] = votes.argmax(1)
    return [float(np.mean([(pred[j][cls == c] != c).mean() for c in range(y.shape[1])])) for j in range(k)]


def dealt_folds(classes: DataFrame, folds: int, seed: int) -> DataFrame:
    """``sample, cls, fold``: the samples of each class in an order hashed from their ids, dealt to the folds in turn."""
    d = classes.select("sample", "cls", F.pmod(F.xxhash64(F.lit(seed), "sample"), F.lit(1 << 50)).cast("double").alias("_at"))
    return row_numbers(d, ["cls"], "_at", "sample").select("sample", "cls", F.pmod(F.col("rn") - 1, F.lit(folds)).cast("int").alias("fold"))


def _block_pls_cv_tall(m: DataFrame, meta: DataFrame, var: str, k: int, folds: int, design: float, seed: int) -> list[float]:
    """The same from sums over each fold: components in coordinates, scores and predictions of a sample from its own cells."""
    t = tall.sample_rows(checkpointed(with_outcome(m, meta, var)))
    p, at, unit = len(t.keys), t.layers(), t.unit()
    ys = at.pop("_y")
    unit[ys] = 1.0  # outcome columns are scaled in each fold
    share = t.mean[ys]

    def classes(it):
        for pdf in it:
            for part, x in tall.matrices(pdf, p):
                yield pd.DataFrame({"sample": part["sample"], "cls": (x[:, ys] + share).argmax(1).astype("int32")})

    rows = checkpointed(t.rows.join(dealt_folds(t.rows.mapInPandas(classes, "sample string, cls int"), folds, seed), "sample"))

    def sums(pdf):
        out: dict[str, np.ndarray] = {}
        for f, own in pdf.groupby("fold", sort=False):
            for _, x in tall.matrices(own, p):
                x = np.nan_to_num(x) / unit
                for name, v in ((f"{f}:xy", x.T @ x), (f"{f}:s", x.sum(0)), (f"{f}:n", np.array([len(x)]))):
                    out[name] = out[name] + v if name in out else v
        return out

    # the parts of a fold are added in few groups, as each holds a matrix of features
    total = fold_rows(rows, sums, 2)
    models = {}
    for f in range(folds):
        c, s, n = (sum(total[f"{g}:{name}"] for g in range(folds) if g != f and f"{g}:n" in total) for name in ("xy", "s", "n"))
        models[f] = _fold_model(np.atleast_2d(c), np.atleast_1d(s) / n, float(np.ravel(n)[0]), at, ys, k, design)

    def wrong(pdf):
        out = {"wrong": np.zeros((k, len(ys))), "n": np.zeros(len(ys))}
        for f, own in pdf.groupby("fold", sort=False):
            mu, parts = models[f]
            for part, x in tall.matrices(own, p):
                x, cls = np.nan_to_num(x) / unit - mu, part["cls"].to_numpy()
                out["n"] += np.bincount(cls, minlength=len(ys))
                scores = {lay: x[:, ix] @ parts[lay][0] for lay, ix in at.items()}
                for j in range(k):
                    votes = np.zeros((len(x), len(ys)))
                    for lay, (_, maps, weights) in parts.items():
                        yhat = share + mu[ys] + scores[lay][:, :j + 1] @ maps[j]
                        votes[np.arange(len(x)), yhat.argmax(1)] += weights[j]
                    out["wrong"][j] += np.bincount(cls[votes.argmax(1) != cls], minlength=len(ys))
        return out

    r = fold_rows(rows, wrong)
    return [float(v) for v in (r["wrong"] / r["n"]).mean(1)]


def _fold_model(c: np.ndarray, mu: np.ndarray, n: float, at: dict[str, np.ndarray], ys: np.ndarray, k: int, design: float):
    """``mu`` and, of each layer, the map of centred cells to scores, of 1 to ``k`` scores to the outcome columns, and the vote's weights.

    ``c`` and ``mu`` are products and means of a fold's ``n`` training samples.
    """
    c = c - n * np.outer(mu, mu)
    sd = np.sqrt(np.maximum(np.diag(c)[ys], 0) / n)
    scale = np.ones(len(mu))
    scale[ys] = np.where(sd > 1e-6, sd, 1.0)
    a, _ = tall.coordinates(c / np.outer(scale, scale))
    y = a[:, ys] * scale[ys]
    comp = _components({**{lay: a[:, ix] @ a[:, ix].T for lay, ix in at.items()}, "_y": a[:, ys] @ a[:, ys].T}, k, design)
    parts = {}
    for lay, ix in at.items():
        x, to, back, maps, weights = a[:, ix], [], [], [], []
        for j, (t, z) in enumerate(comp[lay]):
            # a deflated cell is the cell less what earlier scores tell of it
            w = x.T @ z
            to.append(w - sum((own * (p @ w) for own, p in zip(to, back)), np.zeros(len(w))))
            back.append(x.T @ t / max(t @ t, 1e-300))
            x = x - np.outer(t, back[-1])
            maps.append(np.linalg.pinv(np.column_stack([s for s, _ in comp[lay][:j + 1]])) @ y)
            ty = comp["_y"][j][0]
            weights.append(abs(t @ ty) / max(np.sqrt((t @ t) * (ty @ ty)), 1e-300))
        parts[lay] = (np.column_stack(to), maps, weights)
    return mu, parts


# ---- consensus PCA -------------------------------------------------------------------------

def _rotate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float, float]:
    """b rotated and scaled onto a (both centred): fitted matrix, residual SS, m12 (on unit-norm matrices)."""
    ac, bc = a - a.mean(0), b - b.mean(0)
    u, d, vt = np.linalg.svd(ac.T @ bc)
    fit = bc @ (vt.T @ u.T) * d.sum() / (bc ** 2).sum()
    ss = float(((ac - fit) ** 2).sum())
    return fit + a.mean(0), ss, ss / float((ac ** 2).sum())


def procrustes(a: DataFrame, b: DataFrame) -> tuple[DataFrame, float, float]:
    """Scores ``b`` rotated onto ``a``; residual SS and m12."""
    order, x = local_scores(a)
    _, y = local_scores(b)
    fit, ss, m12 = _rotate(x, y)
    return _scores_df(a.sparkSession, order, fit), ss, m12


def consensus_pca(m: DataFrame, k: int = 5, weights: dict[str, float] | None = None, scale: bool = True) -> Reduction:
    """PCA per layer, aligned to the first layer, weighted mean; contribution = squared correlation per factor."""
    if tall.many_samples(m):
        return _consensus_tall(m, k, weights, scale)
    order = sample_ids(m)
    vecs = vectors(m, order)
    gs = grams(vecs, lambda x, lay: prepare(x, True, scale))
    names = sorted(gs)
    eig = {lay: _eig(gs[lay], k) for lay in names}
    raw = {lay: u * np.sqrt(w) for lay, (w, u) in eig.items()}
    aligned = {lay: raw[lay] if lay == names[0] else _rotate(raw[names[0]], raw[lay])[0] for lay in names}
    wts = np.array([(weights or {}).get(lay, 1.0) for lay in names])
    cons = np.tensordot(wts / wts.sum(), np.stack([aligned[lay] for lay in names]), 1)
    contrib = {lay: [float(np.corrcoef(cons[:, j], aligned[lay][:, j])[0, 1] ** 2) for j in range(cons.shape[1])] for lay in names}
    ve = [(lay, 100 * eig[lay][0] / np.trace(gs[lay])) for lay in names]
    basis = {lay: eig[lay][1] / np.sqrt(np.where(eig[lay][0] > 1e-12, eig[lay][0], np.inf)) for lay in names}
    spark = m.sparkSession
    return Reduction(_scores_df(spark, order, cons), loadings(vecs, lambda x, lay: prepare(x, True, scale) @ basis[lay]), _var_df(spark, ve), {"contribution": contrib})


def _consensus_tall(m: DataFrame, k: int, weights: dict[str, float] | None, scale: bool) -> Reduction:
    """The same from products of features: scores are centred, so rotations and correlations need their products only."""
    spark, t = m.sparkSession, tall.sample_rows(m)
    unit, at = t.unit() if scale else np.ones(len(t.keys)), t.layers()
    c = tall.products(t)["xy"] / np.outer(unit, unit)
    names, p = list(at), len(t.keys)
    eig = {lay: tall.axes(c[np.ix_(ix, ix)], k) for lay, ix in at.items()}
    vec = np.zeros((p, len(names) * k))
    for j, lay in enumerate(names):
        vec[at[lay], j * k:(j + 1) * k] = eig[lay][1]
    vec *= tall.signs(checkpointed(tall.mapped(t, vec / unit[:, None])), vec.shape[1])
    raw = {lay: vec[:, j * k:(j + 1) * k] for j, lay in enumerate(names)}
    first, aligned = raw[names[0]], {}
    for lay in names:
        u, d, vt = np.linalg.svd(first.T @ c @ raw[lay])
        aligned[lay] = raw[lay] if lay == names[0] else raw[lay] @ (vt.T @ u.T) * d.sum() / max(np.trace(raw[lay].T @ c @ raw[lay]), 1e-300)
    wts = np.array([(weights or {}).get(lay, 1.0) for lay in names])
    cons = np.tensordot(wts / wts.sum(), np.stack([aligned[lay] for lay in names]), 1)
    cross = lambda x, y: np.einsum("ij,ik,kj->j", x, c, y)
    with np.errstate(divide="ignore", invalid="ignore"):
        contrib = {lay: (cross(cons, aligned[lay]) ** 2 / (cross(cons, cons) * cross(aligned[lay], aligned[lay]))).tolist() for lay in names}
    ve = [(lay, 100 * eig[lay][0] / (np.trace(c[np.ix_(ix, ix)]) or 1.0)) for lay, ix in at.items()]
    load = None
    for lay, ix in at.items():
        part = tall.feature_table(spark, [t.keys[i] for i in ix], raw[lay][ix])
        load = part if load is None else load.unionByName(part)
    everyone = m.where(F.col("sample").isNotNull()).select("sample").distinct()
    return Reduction(tall.long_scores(checkpointed(tall.mapped(t, cons / unit[:, None])), everyone, k), load, _var_df(spark, ve), {"contribution": contrib})


# ---- sparse CCA ----------------------------------------------------------------------------

def _z(x):
    return prepare(x, True, True)


def _threshold(sums, hi: np.ndarray, target: np.ndarray, grid: int = 96) -> np.ndarray:
    """For each column the least threshold of a twice refined grid up to ``hi`` whose weights have an L1 norm, over their L2 norm, of
    at most ``target``; ``sums(g)`` gives sums ``l1`` and ``l2`` (of squares) at the thresholds ``g`` (grid x columns)."""
    lo = np.zeros_like(hi)
    for _ in range(2):
        g = lo + (hi - lo) * np.linspace(0, 1, grid)[:, None]
        r = sums(g)
        ratio = r["l1"] / np.sqrt(np.maximum(r["l2"], 1e-300))
        ok = (ratio <= target) & (r["l2"] > 1e-20)
        first = np.where(ok.any(0), ok.argmax(0), np.maximum((r["l2"] > 1e-20).sum(0) - 1, 0))
        c = np.arange(len(hi))
        lo, hi = g[np.maximum(first - 1, 0), c], g[first, c]
    return hi


def _soft_side(vecs: DataFrame, t: np.ndarray, pen: np.ndarray, nfeat: int, grid: int = 96) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores of the soft-thresholded, unit-norm weights of one layer for each column of ``t``.

    The threshold that brings the L1 norm to pen * sqrt(features) is bracketed on a
    grid and refined once; each is one pass returning sums per grid point.
    """
    hi = np.sqrt((t ** 2).sum(0) * (t.shape[0] - 1))

    def sums(g):
        def fn(pdf):
            a = np.abs(_z(_mat(pdf)) @ t)
            s = np.maximum(a[None] - g[:, None, :], 0)
            return {"l1": s.sum(1), "l2": (s ** 2).sum(1)}

        return fold_rows(vecs, fn)

    cut = _threshold(sums, hi, pen * np.sqrt(nfeat), grid)

    def out(pdf):
        x = _z(_mat(pdf))
        a = x @ t
        u = np.sign(a) * np.maximum(np.abs(a) - cut, 0)
        return {"s": x.T @ u, "q": (u ** 2).sum(0), "nz": (u != 0).sum(0).astype(float)}

    r = fold_rows(vecs, out)
    norm = np.sqrt(np.maximum(r["q"], 1e-300))
    return r["s"] / norm, cut, norm, r["nz"]


def _project(vecs: DataFrame, s: np.ndarray) -> DataFrame:
    """Rows with the sample direction ``s`` taken out."""
    def run(it):
        for pdf in it:
            if len(pdf):
                x = _z(_mat(pdf))
                yield pdf.assign(vec=list(x - np.outer(x @ s, s) / (s @ s)))
    return vecs.mapInPandas(run, "layer string, feature string, vec array<double>")


def _cca_rounds(a, b, na, nb, t, p1, p2, perms=None, rounds=5):
    """Alternate sides.  Column j of ``t`` sees layer-1 samples reordered by ``perms[j]``."""
    n, c = t.shape
    perms = np.tile(np.arange(n)[:, None], (1, c)) if perms is None else perms
    inv = np.argsort(perms, axis=0)
    cols = np.arange(c)
    for _ in range(rounds):
        su, cu, nu, zu = _soft_side(a, t[inv, cols], p1, na)
        sv, cv, nv, zv = _soft_side(b, su[perms, cols], p2, nb)
        t = sv
    sp = su[perms, cols]
    corr = np.array([np.corrcoef(sp[:, j], sv[:, j])[0, 1] if sp[:, j].std() > 0 and sv[:, j].std() > 0 else 0.0 for j in range(c)])
    return su, sv, corr, (zu, zv)


def _first_direction(a: DataFrame, b: DataFrame) -> np.ndarray:
    """Start: leading direction of layer-2 scores against layer 1, from the two Grams."""
    fn = lambda pdf: {"g": (lambda x: x.T @ x)(_z(_mat(pdf)))}
    ga, gb = fold_rows(a, fn)["g"], fold_rows(b, fn)["g"]
    wb, ub = np.linalg.eigh(gb)
    h = ub * np.sqrt(np.maximum(wb, 0)) @ ub.T
    return (h @ _eig(h @ ga @ h, 1)[1])[:, :1]


def sparse_cca(m: DataFrame, l1: str, l2: str, k: int = 2, p1: float = 0.3, p2: float = 0.3, rounds: int = 5) -> Reduction:
    """Penalized decomposition of two layers; later components on rows with earlier scores projected out."""
    order = sample_ids(m.where(F.col("layer").isin(l1, l2)))
    a = vectors(m.where(F.col("layer") == l1), order)
    b = vectors(m.where(F.col("layer") == l2), order)
    na, nb = a.count(), b.count()
    spark = m.sparkSession
    su_all, sv_all, corr, sel, w = [], [], [], [], None
    for j in range(k):
        t = _first_direction(a, b)
        su, sv, c, (zu, zv) = _cca_rounds(a, b, na, nb, t, np.array([p1]), np.array([p2]), rounds=rounds)
        su_all.append(su[:, 0])
        sv_all.append(sv[:, 0])
        corr.append(float(c[0]))
        sel.append((int(zu[0]), int(zv[0])))
        for vec, other, pen, nf in ((a, sv, p1, na), (b, su, p2, nb)):
            _, cut, norm, _ = _soft_side(vec, other, np.array([pen]), nf)
            part = loadings(vec, lambda x, lay, o=other, cut=cut, norm=norm: (lambda q: np.sign(q) * np.maximum(np.abs(q) - cut, 0) / norm)(_z(x) @ o)) \
                .withColumn("factor", F.lit(j + 1))
            w = part if w is None else w.unionByName(part)
        if j + 1 < k:
            a, b = checkpointed(_project(a, su[:, 0])), checkpointed(_project(b, sv[:, 0]))
    s1, s2 = np.column_stack(su_all), np.column_stack(sv_all)
    sc = _scores_df(spark, order, s1, l1).unionByName(_scores_df(spark, order, s2, l2))
    ve = [(l, [100 * float(s[:, j] @ s[:, j] / ((len(order) - 1) * nf)) for j in range(k)]) for l, s, nf in ((l1, s1, na), (l2, s2, nb))]
    return Reduction(sc, w, _var_df(spark, ve), {"correlation": corr, "selected": sel})


def cca_penalty(m: DataFrame, l1: str, l2: str, penalties: list[float], nperm: int = 25, rounds: int = 3, seed: int = 1) -> DataFrame:
    """z-score of the Fisher-transformed correlation against permutations; all runs share each pass as columns."""
    own = m.where(F.col("layer").isin(l1, l2))
    if tall.many_samples(own):
        corr = _cca_tall(own, l1, l2, penalties, nperm, rounds, seed)
    else:
        order = sample_ids(own)
        a, b = (checkpointed(vectors(m.where(F.col("layer") == l), order)) for l in (l1, l2))
        na, nb = a.count(), b.count()
        n = len(order)
        rng = np.random.default_rng(seed)
        perms = np.column_stack([np.arange(n)] + [rng.permutation(n) for _ in range(nperm)])
        full = np.tile(perms, (1, len(penalties)))
        pen = np.repeat(penalties, nperm + 1)
        t = np.tile(_first_direction(a, b), (1, full.shape[1]))
        corr = _cca_rounds(a, b, na, nb, t, pen, pen, full, rounds)[2].reshape(len(penalties), nperm + 1)
    z = np.arctanh(np.clip(corr, -0.999999, 0.999999))
    rows = []
    for i, p in enumerate(penalties):
        sd = z[i, 1:].std(ddof=1) or 1.0
        rows.append((float(p), float(np.tanh(z[i, 0])), float((z[i, 0] - z[i, 1:].mean()) / sd), float((z[i, 1:] >= z[i, 0]).mean())))
    return m.sparkSession.createDataFrame(rows, "penalty double, correlation double, z double, pval double")


def _cca_tall(m: DataFrame, l1: str, l2: str, penalties: list[float], nperm: int, rounds: int, seed: int, cells: int = 1 << 21) -> np.ndarray:
    """Correlations (penalties x permutations, the true order first) from products of features.

    The rounds use samples only in products of the two layers, of rows paired by a permutation, and of each layer with itself.
    Paired products are summed for as many permutations in one pass as have ``cells`` entries.
    """
    m = checkpointed(m)
    a, b = (tall.sample_rows(m.where(F.col("layer") == l)) for l in (l1, l2))
    na, nb = (m.where((F.col("layer") == l) & F.col("sample").isNotNull()).select(*FEATURE).distinct().count() for l in (l1, l2))
    numbers = checkpointed(tall.numbered(m))
    n = numbers.count()
    ga, gb = (tall.products(x)["xy"] / np.outer(x.unit(), x.unit()) for x in (a, b))
    left = checkpointed(a.rows.join(numbers, "sample").select("_n", "i", "x"))
    right = checkpointed(b.rows.join(numbers, "sample").select(F.col("_n").alias("_at"), F.col("i").alias("i2"), F.col("x").alias("x2")))
    pa, pb = len(a.keys), len(b.keys)
    step = max(1, tall.CELLS // max(pa, pb))

    def paired(pdf):
        out: dict[str, np.ndarray] = {}
        for j, own in pdf.groupby("_j", sort=False):
            for at in range(0, len(own), step):
                part = own.iloc[at:at + step]
                (_, x), = tall.matrices(part, pa)
                (_, y), = tall.matrices(part[["i2", "x2"]].set_axis(["i", "x"], axis=1), pb)
                v = np.nan_to_num(x).T @ np.nan_to_num(y)
                out[str(j)] = out[str(j)] + v if str(j) in out else v
        return out

    corr, start = np.zeros((len(penalties), nperm + 1)), None
    per, pen = max(1, cells // (pa * pb)), np.array(penalties, float)
    for j0 in range(0, nperm + 1, per):
        some = range(j0, min(j0 + per, nperm + 1))
        r = fold_rows(tall.permuted_rows(left, n, some, seed).join(right, "_at").select("_j", "i", "x", "i2", "x2"), paired)
        for j in some:
            c = r.get(str(j), np.zeros((pa, pb))) / np.outer(a.unit(), b.unit())
            if start is None:  # the leading direction of layer-2 scores against layer 1
                start = np.linalg.svd(c, full_matrices=False)[2][0]
            corr[:, j] = _cca_rounds_tall(c, ga, gb, n, na, nb, np.tile(start[:, None], (1, len(pen))), pen, rounds)
    return corr


def _cca_rounds_tall(c: np.ndarray, ga: np.ndarray, gb: np.ndarray, n: int, na: int, nb: int, v: np.ndarray, pen: np.ndarray, rounds: int) -> np.ndarray:
    """``_cca_rounds`` from products: scores are features times weights ``u`` and ``v`` (a column for each penalty)."""
    def soft(a, sq, nfeat):
        def sums(g):
            s = np.maximum(np.abs(a)[None] - g[:, None, :], 0)
            return {"l1": s.sum(1), "l2": (s ** 2).sum(1)}

        w = np.sign(a) * np.maximum(np.abs(a) - _threshold(sums, np.sqrt(np.maximum(sq, 0) * (n - 1)), pen * np.sqrt(nfeat)), 0)
        return w / np.sqrt(np.maximum((w ** 2).sum(0), 1e-300))

    size = lambda g, w: ((g @ w) * w).sum(0)
    for _ in range(rounds):
        u = soft(c @ v, size(gb, v), na)
        v = soft(c.T @ u, size(ga, u), nb)
    norm = np.sqrt(np.maximum(size(ga, u), 0) * np.maximum(size(gb, v), 0))
    return np.where(norm > 0, ((c @ v) * u).sum(0) / np.where(norm > 0, norm, 1.0), 0.0)


def multi_cca(m: DataFrame, k: int = 1, **kw) -> Reduction:
    """The first layer against each other layer."""
    layers = sorted(r[0] for r in m.select("layer").distinct().collect())
    rs = [sparse_cca(m, layers[0], other, k, **kw) for other in layers[1:]]
    join = lambda name: [getattr(r, name).withColumn("pair", F.lit(o)) for r, o in zip(rs, layers[1:])]
    fold = lambda parts: parts[0] if len(parts) == 1 else fold([parts[0].unionByName(parts[1]), *parts[2:]])
    return Reduction(fold(join("scores")), fold(join("loadings")), fold(join("var_exp")), {o: r.info for r, o in zip(rs, layers[1:])})


# ---- non-negative factorization ------------------------------------------------------------

def _multiplicative(y, h, steps=10):
    """Non-negative row weights of mixed-sign data: clipped least squares, then multiplicative steps."""
    hh = h.T @ h
    yh = y @ h
    w = np.maximum(yh @ np.linalg.pinv(hh), 1e-6)
    p, q = (np.abs(hh) + hh) / 2, (np.abs(hh) - hh) / 2
    yp, yq = (np.abs(yh) + yh) / 2, (np.abs(yh) - yh) / 2
    for _ in range(steps):
        w = w * np.sqrt((yp + w @ q) / np.maximum(yq + w @ p, 1e-12))
    return w


def _least_clip(y, h):
    return np.maximum(y @ h @ np.linalg.pinv(h.T @ h), 0)


def _factorize(m: DataFrame, k: int, how: str, iterations: int, tol: float, seed: int, prep, row_weights) -> Reduction:
    order = sample_ids(m)
    vecs = checkpointed(vectors(m, order))
    low = {}
    if prep is None:
        low = {lay: v[0] for lay, v in ((r["layer"], (r["lo"],)) for r in _zscore_min(m).collect())}
        prep = lambda x, lay: np.maximum(_z(x) - low[lay], 0)
    h = _start(order, k, seed)
    errors: list[float] = []
    for _ in range(iterations):
        cur = h

        def fn(pdf):
            out = {}
            for lay, g in pdf.groupby("layer", sort=False):
                y = prep(_mat(g), lay)
                w = row_weights(y, cur)
                key = lay if how == "joint" else "all"
                for name, v in (("ww:" + key, w.T @ w), ("yw:" + key, y.T @ w), ("e", np.array([((y - w @ cur.T) ** 2).sum(), y.size]))):
                    out[name] = out.get(name, 0) + v
            return out

        s = fold_rows(vecs, fn)
        keys = [x[3:] for x in s if x.startswith("ww:")]
        h = np.mean([np.maximum(s["yw:" + q] @ np.linalg.pinv(s["ww:" + q]), 0) for q in keys], axis=0)
        dead = h.sum(0) < 1e-9
        h[:, dead] = _start(order, k, seed + len(errors) + 1)[:, dead]
        errors.append(float(np.sqrt(s["e"][0] / s["e"][1])))
        if len(errors) > 1 and abs(errors[-2] - errors[-1]) < tol * errors[-2]:
            break
    final = h

    def fit(pdf):
        out = {}
        for lay, g in pdf.groupby("layer", sort=False):
            y = prep(_mat(g), lay)
            w = row_weights(y, final)
            out["t:" + lay] = np.array([(y ** 2).sum()])
            out["r:" + lay] = np.array([(y ** 2).sum() - ((y - np.outer(w[:, j], final[:, j])) ** 2).sum() for j in range(k)])
        return out

    s = fold_rows(vecs, fit)
    layers = sorted(x[2:] for x in s if x.startswith("t:"))
    ve = [(lay, 100 * s["r:" + lay] / s["t:" + lay][0]) for lay in layers]
    spark = m.sparkSession
    return Reduction(_scores_df(spark, order, h), loadings(vecs, lambda x, lay: row_weights(prep(x, lay), final)), _var_df(spark, ve), {"rmse": errors})


def _zscore_min(m: DataFrame) -> DataFrame:
    d = with_stats(m, FEATURE, F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    z = (F.col("value") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    return d.groupBy("layer").agg(F.min(z).alias("lo"))


def nmf(m: DataFrame, k: int = 10, how: str = "concat", iterations: int = 100, tol: float = 1e-4, seed: int = 123) -> Reduction:
    """Alternating least squares with clipping on z-scored layers shifted to be non-negative.

    ``concat`` solves one H over all features; ``joint`` takes the mean of the layers' solutions.
    """
    return _factorize(m, k, how, iterations, tol, seed, None, _least_clip)


def semi_nmf(m: DataFrame, k: int = 10, how: str = "concat", iterations: int = 100, tol: float = 1e-4, seed: int = 123) -> Reduction:
    """As :func:`nmf` on z-scores of either sign; row weights by multiplicative steps."""
    return _factorize(m, k, how, iterations, tol, seed, lambda x, lay: _z(x), _multiplicative)


# ---- tables of a result --------------------------------------------------------------------

def top_features(w: DataFrame, n: int = 20) -> DataFrame:
    """Top ``n`` features by absolute weight per layer and factor."""
    d = row_numbers(w.withColumn("_a", F.abs("value")), ["layer", "factor"], "_a", "feature", "rank", descending=True)
    return d.where(F.col("rank") <= n).drop("_a")


def contributions(w: DataFrame) -> DataFrame:
    """Share (%) of each layer in the weight total of a factor."""
    s = w.groupBy("layer", "factor").agg(F.sum("value").alias("_s"))
    return with_stats(s, ["factor"], F.sum("_s").alias("_t")).select("layer", "factor", (100 * F.col("_s") / F.col("_t")).alias("share"))


def variance_report(var_exp: DataFrame) -> DataFrame:
    """Per layer and factor: value and running total in factor order."""
    return var_exp.withColumn("cumulative", F.sum("value").over(W.partitionBy("layer").orderBy("factor").rowsBetween(W.unboundedPreceding, 0)))


def loading_table(load: DataFrame, labels: DataFrame | None = None, first: int = 3) -> DataFrame:
    """One row per feature with the signed loading of largest magnitude over the first factors."""
    d = load.where(F.col("factor") <= first).groupBy(*FEATURE).agg(F.max_by("value", F.struct(F.abs("value"), -F.col("factor"))).alias("value"))
    if labels is not None:
        d = d.join(labels.select(*FEATURE, "label"), FEATURE, "left")
    else:
        d = d.withColumn("label", F.lit(None).cast("string"))
    return d.withColumn("label", F.coalesce(F.nullif("label", F.lit("")), "feature"))


def select_factors(df: DataFrame, factors: list[int] | None = None, layers: list[str] | None = None, scale: bool = False, absolute: bool = False) -> DataFrame:
    """Pick factors and layers of a score or loading table; divide by the largest |value| per factor; absolute values."""
    if factors:
        df = df.where(F.col("factor").isin(factors))
    if layers:
        df = df.where(F.col("layer").isin(layers))
    if scale:
        keys = [c for c in ("layer", "factor") if c in df.columns]
        df = with_stats(df, keys, F.max(F.abs("value")).alias("_x")).withColumn("value", F.col("value") / F.col("_x")).drop("_x")
    return df.withColumn("value", F.abs("value")) if absolute else df


def project(m: DataFrame, load: DataFrame) -> DataFrame:
    """``sample, factor, value``: least-squares score of each factor alone, over all features with a loading and a value.

    Values are centred by feature; a sample with no such feature, or loadings that are all 0, has no score.
    """
    c = with_stats(m.where("value IS NOT NULL"), FEATURE, F.avg("value").alias("_m"))
    d = c.join(load.select(*FEATURE, "factor", F.col("value").alias("w")), FEATURE)
    s = d.groupBy("sample", "factor").agg(F.sum((F.col("value") - F.col("_m")) * F.col("w")).alias("_xw"), F.sum(F.col("w") ** 2).alias("_ww"))
    return s.where("_ww > 0").select("sample", "factor", (F.col("_xw") / F.col("_ww")).alias("value"))


def r2(m: DataFrame, scores: DataFrame, load: DataFrame) -> DataFrame:
    """Explained share of each layer by each factor alone, from scores and loadings."""
    c = with_stats(m, FEATURE, F.avg("value").alias("_m")).select(*FEATURE, "sample", (F.col("value") - F.col("_m")).alias("y"))
    tot = c.groupBy("layer").agg(F.sum(F.col("y") ** 2).alias("tot"))
    fit = c.join(scores.select("sample", "factor", F.col("value").alias("z")), "sample").join(load.select(*FEATURE, "factor", F.col("value").alias("w")), [*FEATURE, "factor"])
    res = fit.groupBy("layer", "factor").agg(F.sum((F.col("y") - F.col("z") * F.col("w")) ** 2).alias("res"))
    return res.join(tot, "layer").select("layer", "factor", (1 - F.col("res") / F.col("tot")).alias("r2"))


def correlated_factors(scores: DataFrame, limit: float = 0.5) -> DataFrame:
    """Factor pairs whose scores correlate beyond the limit."""
    a, b = scores.select("sample", F.col("factor").alias("factor1"), F.col("value").alias("x")), scores.select("sample", F.col("factor").alias("factor2"), F.col("value").alias("y"))
    return a.join(b, "sample").where("factor1 < factor2").groupBy("factor1", "factor2").agg(F.corr("x", "y").alias("r")).where(F.abs("r") > limit)


# Chi-square quantiles with 3 degrees of freedom.
CHI2_3 = {0.5: 2.365973884375338, 0.9: 6.251388631170325, 0.95: 7.814727903251179, 0.99: 11.344866730144373}


def ellipsoid(scores: DataFrame, groups: DataFrame, level: float = 0.95) -> DataFrame:
    """Centre, covariance and radius of each group in the first three factors (four points at least)."""
    p = scores.where("factor <= 3").groupBy("sample").agg(*[F.max(F.when(F.col("factor") == j, F.col("value"))).alias(f"x{j}") for j in (1, 2, 3)])
    d = p.join(groups, "sample").groupBy("group").agg(
        F.count("*").alias("n"), *[F.avg(f"x{j}").alias(f"c{j}") for j in (1, 2, 3)],
        *[F.covar_samp(f"x{i}", f"x{j}").alias(f"s{i}{j}") for i in (1, 2, 3) for j in (1, 2, 3) if i <= j])
    return d.where("n >= 4").withColumn("radius", F.sqrt(F.lit(CHI2_3[level])))
