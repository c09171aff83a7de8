"""Filling nulls (inventory section D).  Absent cells are filled like null cells."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from lamella.core import CELL, FEATURE, SAMPLE, bounded, checkpointed, densify, keep_features, layer_sample_counts, sample_ids, vectors, with_stats
from lamella.functions.ranking import quantile_grid
from lamella.functions.special import hash_uniform, normal_quantile, norm_cdf
from lamella.operators import tall
from lamella.operators.blocks import BLOCK, fold_rows, pair_blocks


def _v():
    return F.col("value")


def _pos():
    return F.when(_v() > 0, _v())




def drop_incomplete(m: DataFrame) -> DataFrame:
    """Features present in every sample of their layer."""
    n = m.groupBy(*FEATURE).agg(F.count("value").alias("_n")).join(layer_sample_counts(m), "layer")
    return keep_features(m, n.where(F.col("_n") == F.col("n_samples")))


def _fill(m, stat, out, inf_safe=False):
    d = with_stats(densify(m), FEATURE, stat.alias("_s"))
    return d.withColumn("value", out).select(*CELL, "value")


def impute(m: DataFrame, how: str, **kw) -> DataFrame:
    if how == "exclude":
        return drop_incomplete(m)
    if how == "lod":
        lod = F.when(_v().isNull() | (_v() == 0), F.col("_s") / 5).otherwise(_v())
        return _fill(m, F.min(_pos()), lod)
    if how == "halfmin":
        return _fill(m, F.min(_v()), F.coalesce(_v(), F.col("_s") / 2))
    if how == "mean":
        return _fill(m, F.avg(_v()), F.coalesce(_v(), F.col("_s")))
    if how == "median":
        return _fill(m, F.percentile(_v(), 0.5), F.coalesce(_v(), F.col("_s")))
    if how == "halfmin_pos":
        return _fill(m, F.min(_pos()), F.coalesce(_v(), F.col("_s") / 2, F.lit(0.0)))
    return {"knn": impute_knn, "lowrank": impute_lowrank, "ppca": impute_ppca, "qrilc": impute_qrilc}[how](m, **kw)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Mean squared difference over shared cells; inf when none is shared."""
    mx, my = ~np.isnan(x), ~np.isnan(y)
    x0, y0 = np.where(mx, x, 0), np.where(my, y, 0)
    n = mx.astype(float) @ my.T
    ss = (x0 ** 2) @ my.T - 2 * x0 @ y0.T + mx.astype(float) @ (y0 ** 2).T
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, np.maximum(ss, 0) / n, np.inf)


def impute_knn(m: DataFrame, k: int = 10, by: str = "feature") -> DataFrame:
    """Mean of the k nearest features (or samples) that have the cell; else the feature mean.

    Features: only incomplete ones look for neighbours; each block pair returns at
    most k neighbours per wanted cell.  Samples: one N x N distance sum.
    """
    d = densify(m)
    many = tall.many_samples(m)
    if by == "sample":
        return _knn_samples_tall(m, d, k) if many else _knn_samples(d, k)
    if many:
        numbers, n = tall.numbering(m)
        vecs, block = tall.feature_vectors(m, numbers, n), tall.block(n)
        names = numbers.select(F.col("_n").cast("int").alias("pos"), "sample")
    else:
        order = sample_ids(d)
        vecs, block = vectors(d, order), BLOCK
        names = F.broadcast(m.sparkSession.createDataFrame(list(enumerate(order)), "pos int, sample string"))
    holes = vecs.where(F.exists("vec", lambda x: F.isnan(x)))

    def near(lk, x, rk, y, same):
        dist = np.round(_distances(x, y), 12)
        rows = []
        for a, (la, fa) in enumerate(lk):
            ok = np.array([lb == la and fb != fa for lb, fb in rk])
            for c in np.flatnonzero(np.isnan(x[a])):
                cand = np.flatnonzero(ok & ~np.isnan(y[:, c]) & np.isfinite(dist[a]))
                for b in sorted(cand, key=lambda b: (dist[a, b], rk[b][1]))[:k]:
                    rows.append((la, fa, int(c), dist[a, b], rk[b][1], y[b, c]))
        return pd.DataFrame(rows, columns=["layer", "feature", "pos", "dist", "other", "v"])

    cand = pair_blocks(holes, vecs, near, "layer string, feature string, pos int, dist double, other string, v double", block)
    w = W.partitionBy("layer", "feature", "pos").orderBy("dist", "other")
    fill = (cand.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
            .groupBy("layer", "feature", "pos").agg(F.avg("v").alias("_fill"))
            .join(names, "pos").drop("pos"))
    return (with_stats(d, FEATURE, F.avg("value").alias("_mean")).join(fill, CELL, "left")
            .select(*CELL, F.coalesce("value", "_fill", "_mean").alias("value")))


def _knn_samples(d: DataFrame, k: int) -> DataFrame:
    layers = [r[0] for r in d.select("layer").distinct().collect()]
    out = None
    for lay in layers:
        one = d.where(F.col("layer") == lay)
        order = sample_ids(one)
        n = len(order)

        def sums(pdf):
            x = np.vstack(pdf["vec"].to_numpy())
            ok = (~np.isnan(x)).astype(float)
            x0 = np.where(ok > 0, x, 0)
            q = (x0 ** 2).T @ ok
            return {"ss": q + q.T - 2 * x0.T @ x0, "n": ok.T @ ok}

        vecs = vectors(one, order)
        s = fold_rows(vecs, sums)
        with np.errstate(divide="ignore", invalid="ignore"):
            dist = np.where(s["n"] > 0, s["ss"] / s["n"], np.inf)
        np.fill_diagonal(dist, np.inf)
        near = np.argsort(np.round(dist, 12), axis=1, kind="stable")

        def fill(it):
            for pdf in it:
                x = np.vstack(pdf["vec"].to_numpy()) if len(pdf) else np.empty((0, n))
                y = x.copy()
                for r, c in zip(*np.nonzero(np.isnan(x))):
                    cand = [j for j in near[c] if np.isfinite(dist[c, j]) and not np.isnan(x[r, j])][:k]
                    y[r, c] = x[r, cand].mean() if cand else np.nanmean(x[r])
                yield pdf.assign(vec=list(y))

        part = _unpack(vecs.mapInPandas(fill, "layer string, feature string, vec array<double>"), order)
        out = part if out is None else out.unionByName(part)
    return out


def _knn_samples_tall(m: DataFrame, d: DataFrame, k: int) -> DataFrame:
    """The same by layer from pairs of sample blocks: a block gives each wanted cell of a sample its k nearest that have the cell."""
    out = None
    for (lay,) in sorted(bounded(m.select("layer").distinct(), 1000, "layers")):
        one = m.where(F.col("layer") == lay)
        t = tall.sample_rows(one)
        p = len(t.keys)
        names, mean = [f for _, f in t.keys], t.mean

        def whole(it):
            for pdf in it:
                for part, x in tall.matrices(pdf, p):
                    yield pd.DataFrame({"layer": lay, "feature": part["sample"].to_numpy(), "vec": list(x)})

        v = checkpointed(t.rows.mapInPandas(whole, "layer string, feature string, vec array<double>"))

        def near(lk, x, rk, y, _):
            # values are off their feature's mean, which distances do not see
            parts, own, other = [], np.array([f for _, f in lk], object), np.array([f for _, f in rk], object)
            step = max(1, tall.CELLS // len(y))
            for a in range(0, len(x), step):
                part = x[a:a + step]
                dist = np.round(_distances(part, y), 12)
                dist[own[a:a + step][:, None] == other[None, :]] = np.inf
                for c in range(p):
                    rows, have = np.flatnonzero(np.isnan(part[:, c])), np.flatnonzero(~np.isnan(y[:, c]))
                    if not len(rows) or not len(have):
                        continue
                    e = dist[np.ix_(rows, have)]
                    best = np.argsort(e, axis=1, kind="stable")[:, :k]  # blocks are in the order of names, which settles ties
                    e = np.take_along_axis(e, best, 1)
                    i, j = np.nonzero(np.isfinite(e))
                    parts.append(pd.DataFrame({"sample": own[a:a + step][rows[i]], "_c": c, "dist": e[i, j], "other": other[have[best[i, j]]], "v": y[have[best[i, j]], c]}))
            return pd.concat(parts) if parts else pd.DataFrame()

        holes = v.where(F.exists("vec", lambda x: x.isNull() | F.isnan(x)))  # NaN comes back from a task as null
        cand = pair_blocks(holes, v, near, "sample string, _c int, dist double, other string, v double", blocks=max(6, -(-v.count() // tall.BLOCK_ROWS)))
        best = F.slice(F.array_sort(F.collect_list(F.struct("dist", "other", "v"))), 1, k)
        place = m.sparkSession.createDataFrame([(c, f, float(mean[c])) for c, f in enumerate(names)], "_c int, feature string, _at double")
        fill = (cand.groupBy("sample", "_c").agg(best.alias("_b")).join(F.broadcast(place), "_c")
                .select("sample", "feature", (F.aggregate("_b", F.lit(0.0), lambda s, r: s + r["v"]) / F.size("_b") + F.col("_at")).alias("_fill")))
        real = d.where(F.col("layer") == lay).withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
        part = with_stats(real, FEATURE, F.avg("value").alias("_mean")).join(fill, ["feature", "sample"], "left").select(
            *CELL, F.coalesce("value", "_fill", "_mean", F.lit(float("nan"))).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def _grid(m: DataFrame, own: DataFrame, rows: DataFrame, t: tall.Rows, fn) -> DataFrame:
    """``CELL, value``: every feature of ``own`` with every sample of ``m``; a feature without any value is NaN.

    ``fn(part, x)`` gives the filled matrix of a batch of ``rows``, samples x features, off the features' means; observed cells stay.
    """
    p, mean = len(t.keys), t.mean
    lay, feat = (np.array([k[j] for k in t.keys], object) for j in (0, 1))

    def run(it):
        for pdf in it:
            for part, x in tall.matrices(pdf, p):
                y = np.where(np.isnan(x), fn(part, x), x) + mean
                yield pd.DataFrame({"layer": np.tile(lay, len(part)), "feature": np.tile(feat, len(part)), "sample": np.repeat(part["sample"].to_numpy(), p), "value": y.ravel()})

    known = m.sparkSession.createDataFrame(t.keys, "layer string, feature string")
    bare = own.select(*FEATURE).distinct().join(F.broadcast(known), FEATURE, "left_anti").crossJoin(m.where(F.col("sample").isNotNull()).select("sample").distinct())
    out = bare.select(*CELL, F.lit(float("nan")).alias("value"))
    if p:
        out = rows.mapInPandas(run, "layer string, feature string, sample string, value double").unionByName(out)
    seen = own.where(F.col("value").isNotNull() & ~F.isnan("value")).select(*CELL, F.col("value").alias("_own"))
    return out.join(seen, CELL, "left").select(*CELL, F.coalesce("_own", "value").alias("value"))  # observed values as they were, to the last digit


def _with_all(t: tall.Rows, m: DataFrame) -> DataFrame:
    """The rows of ``t`` and an empty one for each sample without any value."""
    bare = m.where(F.col("sample").isNotNull()).select("sample").distinct().join(t.rows.select("sample"), "sample", "left_anti")
    return checkpointed(t.rows.unionByName(bare.select("sample", F.array().cast("array<int>").alias("i"), F.array().cast("array<double>").alias("x"))))


def _lowrank_tall(m: DataFrame, k: int, iterations: int, tol: float) -> DataFrame:
    """``impute_lowrank`` with samples as rows.

    The basis is the samples' coordinates on the axes of products of features.  A round keeps ``row``, each sample's coordinates, and
    adds up two matrices: products of features, whose axes give the next coordinates, and each feature's normal equations over the samples that have
    it.  It ends when no row of the projection moves by ``tol``, which bounds every entry.
    """
    t = tall.sample_rows(m)
    p, rows = len(t.keys), _with_all(t, m)
    k = min(k, max(rows.count() - 1, 1), p)

    def filled(part, x, coef):
        if coef is None:
            return np.nan_to_num(x)
        return np.where(np.isnan(x), np.vstack(part["row"].to_numpy()) @ coef.T, x)

    coef, done, state = None, False, rows
    for step in range(iterations):
        cur = coef

        def products(pdf):
            out = np.zeros((p, p))
            for part, x in tall.matrices(pdf, p):
                y = filled(part, x, cur)
                out += y.T @ y
            return {"c": out}

        w, u = np.linalg.eigh(fold_rows(state, products)["c"])
        w, u = w[::-1][:k], u[:, ::-1][:, :k]
        turn = np.where(w > 1e-20 * max(w[0], 1e-300), u / np.sqrt(np.maximum(w, 1e-300)), 0.0)

        def move(it):
            for pdf in it:
                for part, x in tall.matrices(pdf, p):
                    new = filled(part, x, cur) @ turn
                    old = part["row"] if "row" in part else [np.zeros(k)] * len(part)
                    yield pd.DataFrame({"sample": part["sample"], "i": part["i"], "x": part["x"], "old": list(old), "row": list(new)})

        state = checkpointed(state.mapInPandas(move, "sample string, i array<int>, x array<double>, old array<double>, row array<double>"))

        def equations(pdf):
            a, b, cross = np.zeros((p, k * k)), np.zeros((p, k)), np.zeros((k, k))
            for part, x in tall.matrices(pdf, p):
                v = np.vstack(part["row"].to_numpy())
                a += (~np.isnan(x)).astype(float).T @ (v[:, :, None] * v[:, None, :]).reshape(len(v), -1)
                b += np.nan_to_num(x).T @ v
                cross += v.T @ np.vstack(part["old"].to_numpy())
            return {"a": a, "b": b, "cross": cross}

        s = fold_rows(state, equations)
        coef = np.linalg.solve(s["a"].reshape(p, k, k) + 1e-3 * np.eye(k), s["b"][:, :, None])[:, :, 0]
        if step:
            turned = s["cross"]

            def moved(it):
                for pdf in it:
                    if len(pdf):
                        v, o = np.vstack(pdf["row"].to_numpy()), np.vstack(pdf["old"].to_numpy())
                        yield pd.DataFrame({"d": (v ** 2).sum(1) + (o ** 2).sum(1) - 2 * ((v @ turned) * o).sum(1)})

            done = state.mapInPandas(moved, "d double").agg(F.max("d")).first()[0] < tol ** 2
            if done:
                break
    final = coef
    return _grid(m, m, state, t, lambda part, x: np.vstack(part["row"].to_numpy()) @ final.T).withColumn("converged", F.lit(bool(done)))


def _ppca_tall(m: DataFrame, k: int, rounds: int, tol: float, floor: float) -> DataFrame:
    """``impute_ppca`` with samples as rows: a sample's mean and weights follow from its own cells and the features' factors.

    So a round is one pass that solves every sample and adds up, for each feature, the sums that its factors come from.
    """
    n = m.where(F.col("sample").isNotNull()).select("sample").distinct().count()
    k = max(1, min(k, n - 1))
    out, ends = None, {}
    for (lay,) in sorted(bounded(m.select("layer").distinct(), 1000, "layers")):
        here = m.where(F.col("layer") == lay)
        t = tall.sample_rows(here)
        p, mu, rows = len(t.keys), t.mean, _with_all(t, m)
        if not p:
            part = _grid(m, here, rows, t, None)
            out = part if out is None else out.unionByName(part)
            continue
        own = lambda pdf: ((part, x + mu) for part, x in tall.matrices(pdf, p))

        def margins(pdf):
            out = {"v": 0.0, "c": np.zeros((p, p)), "n": np.zeros(p)}
            for _, x in own(pdf):
                cnt = np.maximum((~np.isnan(x)).sum(1), 1)
                mean = np.nansum(x, 1) / cnt
                out["v"] += (np.nansum(x ** 2, 1) / cnt - mean ** 2).sum()
                y = np.nan_to_num(x - mean[:, None])
                out["c"] += y.T @ y
                out["n"] += (~np.isnan(x)).sum(0)
            return out

        s = fold_rows(rows, margins)
        var = max(float(s["v"] / n), 1e-12)
        least, seen = floor * var, s["n"]
        e, u = np.linalg.eigh(s["c"])
        e, u = np.maximum(e[::-1][:k], 0), u[:, ::-1][:, :k]
        start = u * np.where(e > 1e-14 * max(e[0], 1e-300), np.sqrt(np.maximum(e / p, 1e-6 * var) / np.maximum(e, 1e-300)), 0.0)
        start = np.pad(start, ((0, 0), (0, k - start.shape[1])))

        def solved(x, state):
            """Mean and weights of each sample, and for the noise what is left of its squares."""
            seen = (~np.isnan(x)).astype(float)
            if state is None:
                mean = np.nansum(x, 1) / np.maximum(seen.sum(1), 1)
                return mean, np.nan_to_num(x - mean[:, None]) @ start, 0.0
            z1, zz, mid, turn = state
            a = (seen @ zz.reshape(p, -1)).reshape(-1, k + 1, k + 1)
            b = np.nan_to_num(x) @ z1
            v = np.einsum("nij,nj->ni", np.linalg.pinv(a, rcond=np.finfo(float).eps * (k + 1), hermitian=True), b)
            left = np.nansum(x ** 2) - 2 * (v * b).sum() + np.einsum("ni,nij,nj->", v, a, v)
            return v[:, k] + v[:, :k] @ mid, v[:, :k] @ turn, left

        def expect(state):
            def fn(pdf):
                out = {"ww": np.zeros((p, k * k)), "d": np.zeros((p, k)), "q": np.zeros(p), "left": 0.0}
                for _, x in own(pdf):
                    mean, w, left = solved(x, state)
                    f = (~np.isnan(x)).astype(float)
                    y = np.nan_to_num(x - mean[:, None])
                    out["ww"] += f.T @ (w[:, :, None] * w[:, None, :]).reshape(len(w), -1)
                    out["d"] += y.T @ w
                    out["q"] += (y ** 2).sum(0)
                    out["left"] += left
                return out
            return fold_rows(rows, fn)

        state, s2, done, last = None, var, False, None
        r = expect(None)
        for _ in range(rounds):
            inner = r["ww"].reshape(p, k, k) + s2 * np.eye(k)
            inv = np.linalg.inv(inner)
            z = np.einsum("fij,fj->fi", inv, r["d"])
            logdet = (seen - k) * np.log(s2) + np.linalg.slogdet(inner)[1]
            like = float((-0.5 * ((r["q"] - (z * r["d"]).sum(1)) / s2 + logdet + seen * np.log(2 * np.pi))).sum())
            z1 = np.column_stack([z, np.ones(p)])
            zz = z1[:, :, None] * z1[:, None, :]
            zz[:, :k, :k] += s2 * inv
            all_z = zz.sum(0) / p
            mid = all_z[:k, k]
            state = (z1, zz, mid, np.linalg.cholesky(all_z[:k, :k] - np.outer(mid, mid) + 1e-12 * np.eye(k)))
            r = expect(state)
            s2 = max(float(r["left"] / seen.sum()), least)
            done = last is not None and abs(like - last) <= tol * abs(like)
            if done:
                break
            last = like
        final = state
        z = np.einsum("fij,fj->fi", np.linalg.inv(r["ww"].reshape(p, k, k) + s2 * np.eye(k)), r["d"])

        def fit(part, x):
            mean, w, _ = solved(x + mu, final)
            return w @ z.T + mean[:, None] - mu

        part = _grid(m, here, rows, t, fit)
        ends[lay] = done
        out = part if out is None else out.unionByName(part)
    flags = F.create_map(*[F.lit(v) for lay in ends for v in (lay, bool(ends[lay]))]) if ends else F.create_map().cast("map<string,boolean>")
    return out.withColumn("converged", flags[F.col("layer")])


def _unpack(vecs: DataFrame, order: list[str]) -> DataFrame:
    names = F.array(*[F.lit(s) for s in order]) if len(order) <= 50 else None
    d = vecs.select(*FEATURE, F.posexplode("vec").alias("_i", "value"))
    if names is not None:
        return d.select(*FEATURE, names[F.col("_i")].alias("sample"), "value")
    lookup = vecs.sparkSession.createDataFrame(list(enumerate(order)), "_i int, sample string")
    return d.join(F.broadcast(lookup), "_i").select(*CELL, "value")


def impute_lowrank(m: DataFrame, k: int = 5, iterations: int = 100, tol: float = 1e-4) -> DataFrame:
    """Rank-k completion by alternating least squares, until the basis moves by less than ``tol``; ``converged`` tells whether it did.

    A row's fill depends only on its observed cells and the current N x k basis,
    so each round is one pass with a small broadcast: no state, no lineage.
    """
    if tall.many_samples(m):
        return _lowrank_tall(m, k, iterations, tol)
    order = sample_ids(m)
    vecs = checkpointed(vectors(m, order))
    n = len(order)
    k = min(k, n - 1)

    def fill(x, basis):
        mu = np.nanmean(x, axis=1, keepdims=True)
        y = np.where(np.isnan(x), 0.0, x - mu)
        if basis is None:
            return y, mu
        out = y.copy()
        for r in np.flatnonzero(np.isnan(x).any(axis=1)):
            ok = ~np.isnan(x[r])
            v = basis[ok]
            c = np.linalg.solve(v.T @ v + 1e-3 * np.eye(v.shape[1]), v.T @ y[r, ok])
            out[r, ~ok] = basis[~ok] @ c
        return out, mu

    basis, last, done = None, None, False
    for _ in range(iterations):
        cur = basis

        def gram(pdf):
            x = np.vstack(pdf["vec"].to_numpy())
            x = x[~np.isnan(x).all(axis=1)]
            y, _ = fill(x, cur)
            return {"g": y.T @ y}

        w, v = np.linalg.eigh(fold_rows(vecs, gram)["g"])
        basis = v[:, ::-1][:, :k]
        proj = basis @ basis.T
        done = last is not None and bool(np.abs(proj - last).max() < tol)
        if done:
            break
        last = proj
    final = basis

    def out(it):
        for pdf in it:
            if len(pdf):
                x = np.vstack(pdf["vec"].to_numpy())
                y, mu = fill(x, final)
                yield pdf.assign(vec=list(np.where(np.isnan(x), y + mu, x)))

    return _unpack(vecs.mapInPandas(out, "layer string, feature string, vec array<double>"), order).withColumn("converged", F.lit(done))


def _posterior(x: np.ndarray, w: np.ndarray, s2: float):
    """For each pattern of observed cells (rows of ``x``, centred): its mask, its rows, their factor means, the shared covariance, the log likelihood."""
    seen = ~np.isnan(x)
    masks, at = np.unique(seen, axis=0, return_inverse=True)
    at = at.ravel()
    for p, ok in enumerate(masks):
        rows = np.flatnonzero(at == p)
        d, wo = x[rows][:, ok], w[ok]
        inner = wo.T @ wo + s2 * np.eye(w.shape[1])
        inv = np.linalg.inv(inner)
        z = d @ wo @ inv
        quad = ((d ** 2).sum() - (z * (d @ wo)).sum()) / s2
        logdet = (ok.sum() - w.shape[1]) * np.log(s2) + np.linalg.slogdet(inner)[1]
        yield ok, rows, z, s2 * inv, -0.5 * (quad + len(rows) * (logdet + ok.sum() * np.log(2 * np.pi)))


def impute_ppca(m: DataFrame, k: int = 5, rounds: int = 500, tol: float = 1e-6, floor: float = 1e-8) -> DataFrame:
    """Probabilistic PCA of each layer by expectation maximisation: missing cells get their expected value.

    A round is one pass: rows solve once for each pattern of missing cells and add to sums of shape N x (k+1) x (k+1).  It ends
    when the log likelihood moves by less than ``tol`` of itself; ``converged`` tells whether it did within ``rounds``.  The noise stays
    above ``floor`` of the layer's variance.  A feature without any value stays missing.
    """
    if tall.many_samples(m):
        return _ppca_tall(m, k, rounds, tol, floor)
    order = sample_ids(m)
    vecs = checkpointed(vectors(m, order))
    n = len(order)
    k = max(1, min(k, n - 1))
    matrix = lambda pdf: (lambda x: x[~np.isnan(x).all(axis=1)])(np.vstack(pdf["vec"].to_numpy()))

    def by_layer(fn):
        def run(pdf):
            out = {}
            for lay, g in pdf.groupby("layer", sort=False):
                x = matrix(g)
                if len(x):
                    out |= {f"{name}:{lay}": v for name, v in fn(x, lay).items()}
            return out
        return fold_rows(vecs, run)

    def margins(x, lay):
        f = np.nan_to_num(x)
        return {"n": (~np.isnan(x)).sum(0).astype(float), "s": f.sum(0), "q": (f ** 2).sum(0), "rows": np.array(float(len(x)))}

    sums = by_layer(margins)
    layers = sorted(key[2:] for key in sums if key.startswith("n:"))
    means = {lay: sums[f"s:{lay}"] / np.maximum(sums[f"n:{lay}"], 1) for lay in layers}
    start = by_layer(lambda x, lay: {"g": (lambda y: y.T @ y)(np.nan_to_num(x - means[lay]))})
    state, least = {}, {}
    for lay in layers:
        mean = means[lay]
        var = max(float(np.mean(sums[f"q:{lay}"] / np.maximum(sums[f"n:{lay}"], 1) - mean ** 2)), 1e-12)
        e, u = np.linalg.eigh(start[f"g:{lay}"] / sums[f"rows:{lay}"])
        state[lay] = (mean, u[:, ::-1][:, :k] * np.sqrt(np.maximum(e[::-1][:k], 1e-6 * var)), var)
        least[lay] = floor * var
    done, last = dict.fromkeys(layers, False), {}
    for _ in range(rounds):
        if all(done.values()):
            break
        cur = dict(state)

        def expect(x, lay):
            mean, w, s2 = cur[lay]
            a, b, all_z = np.zeros((n, k + 1, k + 1)), np.zeros((n, k + 1)), np.zeros((k + 1, k + 1))
            like = xx = cnt = 0.0
            for ok, rows, z, cov, ll in _posterior(x - mean, w, s2):
                z1 = np.column_stack([z, np.ones(len(z))])
                zz = z1.T @ z1
                zz[:k, :k] += len(z) * cov
                all_z += zz
                a[ok] += zz
                b[ok] += x[rows][:, ok].T @ z1
                like, xx, cnt = like + ll, xx + (x[rows][:, ok] ** 2).sum(), cnt + len(rows) * ok.sum()
            return {"a": a, "b": b, "z": all_z, "t": np.array([like, xx, cnt])}

        r = by_layer(expect)
        for lay in layers:
            if done[lay]:
                continue
            a, b, (like, xx, cnt) = r[f"a:{lay}"], r[f"b:{lay}"], r[f"t:{lay}"]
            v = np.stack([np.linalg.lstsq(a[j], b[j], rcond=None)[0] for j in range(n)])
            s2 = (xx - 2 * (v * b).sum() + np.einsum("ni,nij,nj->", v, a, v)) / cnt
            z = r[f"z:{lay}"] / sums[f"rows:{lay}"]  # factors back to mean 0 and unit covariance: without it their scale drifts for hundreds of rounds
            mid, turn = z[:k, k], np.linalg.cholesky(z[:k, :k] - np.outer(z[:k, k], z[:k, k]) + 1e-12 * np.eye(k))
            state[lay] = (v[:, k] + v[:, :k] @ mid, v[:, :k] @ turn, max(float(s2), least[lay]))
            done[lay] = lay in last and abs(like - last[lay]) <= tol * abs(like)
            last[lay] = like
    final = dict(state)

    def out(it):
        for pdf in it:
            for lay, g in pdf.groupby("layer", sort=False):
                x = np.vstack(g["vec"].to_numpy())
                some = np.flatnonzero(~np.isnan(x).all(axis=1))
                if len(some):
                    mean, w, s2 = final[lay]
                    y = x[some]
                    fit = np.empty_like(y)
                    for _, rows, z, _, _ in _posterior(y - mean, w, s2):
                        fit[rows] = z @ w.T + mean
                    x[some] = np.where(np.isnan(y), fit, y)
                yield g.assign(vec=list(x))

    ends = F.create_map(*[F.lit(v) for lay in layers for v in (lay, done[lay])]) if layers else F.create_map().cast("map<string,boolean>")
    cells = _unpack(vecs.mapInPandas(out, "layer string, feature string, vec array<double>"), order)
    return cells.withColumn("converged", ends[F.col("layer")])


def impute_qrilc(m: DataFrame, seed: int = 123) -> DataFrame:
    """Left-censored draws per sample (log-scale input).

    Observed quantiles are regressed on the normal quantiles above the missing
    share; draws invert the truncated normal at a hash of the cell key, so they do
    not depend on partitioning.  Feature minimum - 1 where the fit is undefined.
    """
    d = densify(m)
    grid = [0.001 + 0.01 * i for i in range(100)]
    s = (d.groupBy(*SAMPLE).agg(F.count("value").alias("_n"), F.count("*").alias("_all"))
         .join(quantile_grid(checkpointed(d.select(*SAMPLE, "value")), SAMPLE, "value", grid), SAMPLE)
         .withColumn("_pna", 1 - F.col("_n") / F.col("_all")))
    pts = (s.select(*SAMPLE, "_pna", F.posexplode("_q").alias("_i", "_y"))
           .withColumn("_p", F.col("_pna") + 0.001 + F.col("_i") * (0.99 - F.col("_pna")) / 99)
           .withColumn("_x", normal_quantile("_p")))
    fit = pts.groupBy(*SAMPLE).agg(F.regr_slope("_y", "_x").alias("_sd"), F.regr_intercept("_y", "_x").alias("_mu"),
                                   F.first("_pna").alias("_pna"))
    d = d.join(fit, SAMPLE, "left")
    d = with_stats(d, FEATURE, (F.min("value") - 1).alias("_floor"))
    u = hash_uniform("feature", "sample", seed=seed) * (F.col("_pna") + 0.001)
    draw = F.col("_mu") + F.col("_sd") * normal_quantile(u)
    good = F.col("_sd").isNotNull() & (F.col("_sd") > 0)
    return d.select(*CELL, F.when(_v().isNotNull(), _v()).when(good, draw).otherwise(F.coalesce("_floor", F.lit(0.0))).alias("value"))


def log_qrilc(m: DataFrame, seed: int = 123) -> DataFrame:
    """Values that are not positive and finite become null, then log2, then :func:`impute_qrilc`."""
    ok = (_v() > 0) & (_v() < float("inf"))
    return impute_qrilc(m.withColumn("value", F.when(ok, F.log2("value"))), seed)
