"""Interaction, mediation, variance partition and constrained ordination (inventory section O)."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lamella.core import FEATURE, bounded, checkpointed, sample_ids, shared_samples, vectors, with_stats
from lamella.functions.ranking import bh, quantiles, row_numbers
from lamella.functions.special import t_pvalue
from lamella.operators import tall
from lamella.operators.blocks import fold_rows, pair_blocks
from lamella.operators.correlation import PAIR, strongest
from lamella.operators.differential import _columns, sample_frame
from lamella.operators.reduction import Reduction, _eig, _scores_df, _var_df, grams, loadings, local_scores, pca, prepare


def _type_column(x: pd.Series) -> np.ndarray:
    if pd.api.types.is_numeric_dtype(x):
        return x.to_numpy(float)
    lev = sorted(x.unique())
    if len(lev) != 2:
        raise ValueError("the interaction variable needs two levels or numbers")
    return (x == lev[1]).to_numpy(float)


def interaction_models(m: DataFrame, meta: DataFrame, l1: str, l2: str, var: str, covars: list[str] | None = None, max_p: float | None = None) -> DataFrame:
    """Y ~ a + type + a:type + covariates for every a of ``l1`` and Y of ``l2``.

    In a block task each a gives one small design, solved for all Y of the block at
    once.  BH runs over all pairs; ``max_p`` only trims the returned table.
    """
    covars = covars or []
    if tall.many_samples(m.where(F.col("layer").isin(l1, l2))) or tall.many_samples(meta.dropna(subset=["sample", var, *covars])):
        d = bh(checkpointed(_interactions_tall(m, meta, l1, l2, var, covars)).withColumn("pval", t_pvalue("stat", "df")))
        return d if max_p is None else d.where(F.col("pval") <= max_p)
    pdf = sample_frame(meta, [var, *covars])
    have = set(sample_ids(m.where(F.col("layer").isin(l1, l2))))
    pdf = pdf[pdf["sample"].isin(have)].reset_index(drop=True)
    order = list(pdf["sample"])
    typ = _type_column(pdf[var])
    cov = [_columns(pdf[c], False)[0] for c in covars]

    def fn(lk, x, rk, y, same):
        n = x.shape[1]
        parts = []
        for i, a in enumerate(x):
            base = np.column_stack([np.ones(n), a, typ, a * typ, *cov])
            gap = np.isnan(a)[None, :] | np.isnan(y)
            est, t, r2, df = (np.full(len(y), np.nan) for _ in range(4))
            pats = {}
            for j in range(len(y)):
                pats.setdefault(gap[j].tobytes(), []).append(j)
            for js in pats.values():
                ok = ~gap[js[0]]
                d, yy = base[ok], y[np.ix_(js, np.flatnonzero(ok))]
                if ok.sum() <= d.shape[1] or np.linalg.matrix_rank(d) < d.shape[1]:
                    continue
                v = np.linalg.inv(d.T @ d)
                b = yy @ d @ v
                ss = ((yy - b @ d.T) ** 2).sum(1)
                f = ok.sum() - d.shape[1]
                est[js], df[js] = b[:, 3], f
                t[js] = b[:, 3] / np.sqrt(np.maximum(ss / f * v[3, 3], 1e-300))
                r2[js] = 1 - ss / np.maximum(((yy - yy.mean(1, keepdims=True)) ** 2).sum(1), 1e-300)
            parts.append(pd.DataFrame({"layer1": lk[i][0], "feature1": lk[i][1], "layer2": [k[0] for k in rk], "feature2": [k[1] for k in rk],
                                       "coef": est, "stat": t, "df": df, "r2": r2}))
        out = pd.concat(parts)
        return out[~out["coef"].isna()]

    a, b = vectors(m.where(F.col("layer") == l1), order), vectors(m.where(F.col("layer") == l2), order)
    d = pair_blocks(a, b, fn, PAIR + ", coef double, stat double, df double, r2 double").withColumn("pval", t_pvalue("stat", "df"))
    d = bh(d)
    return d if max_p is None else d.where(F.col("pval") <= max_p)


def interaction_select(res: DataFrame, top: int | None = None, p: float = 0.05, by: str = "pval", coef_quantile: float = 0.0, r2: float = 0.0) -> DataFrame:
    """Pairs ranked by |coefficient|, the ``top`` ones if asked, with the volcano class of each."""
    d = res.withColumn("_a", F.round(F.abs("coef"), 12)).withColumn("_one", F.lit(1)).withColumn("_id", F.concat_ws("|", "layer1", "feature1", "layer2", "feature2"))
    d = row_numbers(d, ["_one"], "_a", "_id", "rank", descending=True)
    if top is not None:
        d = d.where(F.col("rank") <= top)
    if coef_quantile > 0:
        d = d.join(quantiles(d, ["_one"], "_a", {"_cut": coef_quantile}), "_one")
    else:
        d = d.withColumn("_cut", F.lit(0.0))
    ok = (F.col(by) <= p) & (F.col("_a") >= F.col("_cut")) & (F.col("r2") >= r2)
    return d.withColumn("class", F.when(~ok, "none").when(F.col("coef") > 0, "up").otherwise("down")).drop("_a", "_one", "_cut", "_id")


def interaction_network(sel: DataFrame, sign: str = "both", n: int | None = None) -> DataFrame:
    """Edges of a sign, those of the strongest ``n`` distinct coefficients if asked."""
    d = sel.where(F.col("class") != "none")
    if sign != "both":
        d = d.where(F.col("coef") > 0 if sign == "positive" else F.col("coef") < 0)
    return strongest(d, n, "coef").select(F.concat_ws(":", "layer1", "feature1").alias("src"), F.concat_ws(":", "layer2", "feature2").alias("dst"), F.col("coef").alias("weight"))


def _type_values(d: DataFrame, col: str) -> tuple:
    """``_type_column`` of any number of rows: the column of ``d``, and whether it is a number."""
    if dict(d.dtypes)[col] in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean"):
        return F.col(col).cast("double"), True
    lev = sorted(r[0] for r in bounded(d.select(col).distinct(), 1000, col))
    if len(lev) != 2:
        raise ValueError("the interaction variable needs two levels or numbers")
    return (F.col(col) == F.lit(lev[1])).cast("double"), False


def _interactions_tall(m: DataFrame, meta: DataFrame, l1: str, l2: str, var: str, covars: list[str]) -> DataFrame:
    """The models from sums over samples: of a to the powers 0 to 2, of products of two of 1, type and covariates, and of Y, for all pairs at once.

    a, Y and the numbers are taken off their means, which changes neither the interaction nor what it is tested against.
    """
    spark = m.sparkSession
    d = meta.select("sample", *dict.fromkeys([var, *covars])).dropna().join(m.where(F.col("layer").isin(l1, l2)).select("sample").distinct(), "sample", "left_semi")
    typ, _ = _type_values(d, var)
    cols = [typ]
    for c in covars:
        if dict(d.dtypes)[c] in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean"):
            cols.append(F.col(c).cast("double"))
        else:
            cols += [(F.col(c) == F.lit(v)).cast("double") for v in sorted(r[0] for r in bounded(d.select(c).distinct(), 1000, c))[1:]]
    d = checkpointed(d.select("sample", F.array(*cols).alias("z")))
    q = len(cols)
    ends = d.agg(*[f(F.col("z")[j]) for j in range(q) for f in (F.avg, F.stddev_samp)]).first()
    mid = np.array([0.0 if v is None else v for v in ends[0::2]])
    unit = np.array([v if v else 1.0 for v in ends[1::2]])
    t = tall.sample_rows(m.where(F.col("layer").isin(l1, l2)).join(d.select("sample"), "sample", "left_semi"))
    at = t.layers()
    if l1 not in at or l2 not in at:
        return spark.createDataFrame([], PAIR + ", coef double, stat double, df double, r2 double")
    p, ia, iy = len(t.keys), at[l1], at[l2]
    t.rows = t.rows.join(d, "sample")
    w = q + 1  # 1, type, covariates
    both = [(k, l) for k in range(w) for l in range(k, w)]

    def fn(pdf):
        out: dict[str, np.ndarray] = {}
        for part, x in tall.matrices(pdf, p):
            g = np.column_stack([np.ones(len(part)), (np.vstack(part["z"].to_numpy()) - mid) / unit])
            a, y = x[:, ia], x[:, iy]
            ha, hy = (~np.isnan(a)).astype(float), (~np.isnan(y)).astype(float)
            a, y = np.nan_to_num(a), np.nan_to_num(y)
            power = {0: ha, 1: a, 2: a ** 2}
            add = {f"{e}:{k}:{l}": (power[e] * (g[:, k] * g[:, l])[:, None]).T @ hy for e in power for k, l in both if e == 0 or max(k, l) < 2}
            # the columns are 1, a, type, a type, covariates: a meets a covariate, and a type meets it, once
            add |= {f"1:{k}:{l}": (a * (g[:, k] * g[:, l])[:, None]).T @ hy for k, l in both if max(k, l) >= 2 and k < 2}
            add |= {f"y{e}:{k}": (power[e] * g[:, [k]]).T @ y for e in (0, 1) for k in range(w) if e == 0 or k < 2}
            add["yy"] = ha.T @ y ** 2
            for k, v in add.items():
                out[k] = out[k] + v if k in out else v
        return out

    sums = fold_rows(t.rows, fn)
    if not sums:
        return spark.createDataFrame([], PAIR + ", coef double, stat double, df double, r2 double")
    # each column as (power of a, which of 1, type, covariates)
    design = [(0, 0), (1, 0), (0, 1), (1, 1), *[(0, k) for k in range(2, w)]]
    shared = spark.sparkContext.broadcast(([t.keys[i] for i in ia], [t.keys[i] for i in iy], sums))

    def run(it):
        lk, rk, s = shared.value
        for pdf in it:
            for i in pdf["id"].to_numpy():
                xx = np.empty((len(rk), len(design), len(design)))
                for j, (e, k) in enumerate(design):
                    for h, (f, l) in enumerate(design):
                        xx[:, j, h] = s[f"{e + f}:{min(k, l)}:{max(k, l)}"][i]
                xy = np.column_stack([s[f"y{e}:{k}"][i] for e, k in design])
                n, yy = xx[:, 0, 0], s["yy"][i]
                size = np.sqrt(np.maximum(np.diagonal(xx, axis1=1, axis2=2), 0))
                ok = (n > len(design)) & (size > 0).all(1)
                norm = xx[ok] / size[ok][:, :, None] / size[ok][:, None, :]
                ok[ok] = np.linalg.eigvalsh(norm)[:, 0] > 1e-12 if len(norm) else True
                if not ok.any():
                    continue
                xx, xy, n, yy, size = xx[ok], xy[ok], n[ok], yy[ok], size[ok]
                v = np.linalg.inv(xx / size[:, :, None] / size[:, None, :]) / size[:, :, None] / size[:, None, :]
                b = np.einsum("pij,pj->pi", v, xy)
                ss = np.maximum(yy - (b * xy).sum(1), 0)
                df = n - len(design)
                r2 = 1 - ss / np.maximum(yy - xy[:, 0] ** 2 / n, 1e-300)
                keys = [k for k, o in zip(rk, ok) if o]
                yield pd.DataFrame({"layer1": lk[i][0], "feature1": lk[i][1], "layer2": [k[0] for k in keys], "feature2": [k[1] for k in keys],
                                    "coef": b[:, 3] / unit[0], "stat": b[:, 3] / np.sqrt(np.maximum(ss / df * v[:, 3, 3], 1e-300)), "df": df, "r2": r2})

    return spark.range(len(ia)).repartition(16).mapInPandas(run, PAIR + ", coef double, stat double, df double, r2 double")


def _mediation_tall(m: DataFrame, meta: DataFrame, x: str, outcome: str, task) -> DataFrame:
    """``task(layer, feature, x, mediator, outcome)`` for each feature with its own samples in the order of their names; a task holds one feature."""
    d = meta.select("sample", *dict.fromkeys([x, outcome])).dropna().join(m.select("sample").distinct(), "sample", "left_semi")
    xs, ys = _type_values(d, x)[0], _type_values(d, outcome)[0]
    d = m.where(F.col("value").isNotNull() & ~F.isnan("value")).join(d.select("sample", xs.alias("_x"), ys.alias("_y")), "sample")

    def one(key, pdf):
        pdf = pdf.sort_values("sample", ignore_index=True)
        return task(key[0], key[1], pdf["_x"].to_numpy(), pdf["value"].to_numpy(), pdf["_y"].to_numpy())

    return d.select(*FEATURE, "sample", "value", "_x", "_y").repartition(64, *FEATURE).groupBy(*FEATURE).applyInPandas(one, MEDIATION)


MEDIATION = "layer string, feature string, effect string, estimate double, low double, high double, pval double"


def mediation(m: DataFrame, meta: DataFrame, x: str, outcome: str, sims: int = 1000, seed: int = 1) -> DataFrame:
    """Does each feature mediate x -> outcome?  M ~ x, Y ~ x + M (linear, or logistic for a two-level outcome).

    Features are the distributed work; bootstrap draws are seeded by the feature, so
    they do not depend on partitioning.  Effects are on the outcome scale (probability
    for a logistic model).
    """
    many = tall.many_samples(m) or tall.many_samples(meta.dropna(subset=["sample", x, outcome]))
    if many:
        binary = dict(meta.dtypes)[outcome] not in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
    else:
        pdf = sample_frame(meta, [x, outcome])
        have = set(sample_ids(m))
        pdf = pdf[pdf["sample"].isin(have)].reset_index(drop=True)
        order, xv = list(pdf["sample"]), _type_column(pdf[x])
        binary = not pd.api.types.is_numeric_dtype(pdf[outcome])
        yv = _type_column(pdf[outcome])

    def ols(a, y):
        return np.linalg.lstsq(a, y, rcond=None)[0]

    def logit(a, y):
        b = np.zeros(a.shape[1])
        for _ in range(15):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
            step = np.linalg.solve(a.T @ (a * np.maximum(p * (1 - p), 1e-6)[:, None]) + 1e-6 * np.eye(a.shape[1]), a.T @ (y - p))
            b = b + step
            if np.abs(step).max() < 1e-6:
                break
        return b

    def effects(xs, ms, ys):
        one = np.ones(len(xs))
        a = ols(np.column_stack([one, xs]), ms)
        lo, hi = (0.0, 1.0)
        if not binary:
            b = ols(np.column_stack([one, xs, ms]), ys)
            return np.array([a[1] * b[2], b[1], a[1] * b[2] + b[1]])
        b = logit(np.column_stack([one, xs, ms]), ys)
        res = ms - a[0] - a[1] * xs
        pr = lambda t, tm: (1 / (1 + np.exp(-np.clip(b[0] + b[1] * t + b[2] * (a[0] + a[1] * tm + res), -30, 30)))).mean()
        acme = ((pr(hi, hi) - pr(hi, lo)) + (pr(lo, hi) - pr(lo, lo))) / 2
        ade = ((pr(hi, hi) - pr(lo, hi)) + (pr(hi, lo) - pr(lo, lo))) / 2
        return np.array([acme, ade, pr(hi, hi) - pr(lo, lo)])

    def drawn(xs, mm, ys, draws):
        """The effects of every draw; a linear model needs only how often each sample was drawn, summed over products of the columns."""
        if binary or not many:
            return np.array([effects(xs[i], mm[i], ys[i]) for i in draws])
        c = np.column_stack([np.ones(len(xs)), xs - xs.mean(), mm - mm.mean(), ys - ys.mean()])
        up = [(i, j) for i in range(4) for j in range(i, 4)]
        products = np.array([c[:, i] * c[:, j] for i, j in up])
        out = []
        for i in draws:
            g = np.empty((4, 4))
            for (a, b), v in zip(up, products @ np.bincount(i, minlength=len(xs))):
                g[a, b] = g[b, a] = v
            # least squares by pseudo-inverse, as columns may not be independent in a draw
            fit = lambda k: np.linalg.pinv(g[:k, :k], rcond=1e-13, hermitian=True)
            slope, b = (fit(2) @ g[:2, 2])[1], fit(3) @ g[:3, 3]
            out.append((slope * b[2], b[1], slope * b[2] + b[1]))
        return np.array(out)

    def one(lay, f, xs, mm, ys):
        import zlib
        est = effects(xs, mm, ys)
        rng = np.random.default_rng([seed, zlib.crc32(f"{lay}:{f}".encode())])
        boot = drawn(xs, mm, ys, (rng.integers(0, len(xs), len(xs)) for _ in range(sims)))
        prop = np.append(est, est[0] / est[2] if est[2] else np.nan)
        with np.errstate(divide="ignore", invalid="ignore"):
            bp = np.column_stack([boot, boot[:, 0] / boot[:, 2]])
        rows = []
        for j, name in enumerate(("acme", "ade", "total", "proportion")):
            b = bp[:, j][np.isfinite(bp[:, j])]
            lo, hi = np.quantile(b, [0.025, 0.975])
            rows.append((lay, f, name, prop[j], lo, hi, min(1.0, 2 * min((b <= 0).mean(), (b >= 0).mean()))))
        return pd.DataFrame(rows, columns=["layer", "feature", "effect", "estimate", "low", "high", "pval"])

    if many:
        return _mediation_tall(m, meta, x, outcome, one)

    def run(it):
        for p in it:
            for lay, f, v in p[["layer", "feature", "vec"]].itertuples(index=False):
                ms = np.array(v)
                ok = ~np.isnan(ms)
                yield one(lay, f, xv[ok], ms[ok], yv[ok])

    return vectors(m, order).mapInPandas(run, MEDIATION)


def variance_partition(m: DataFrame, meta: DataFrame, fixed: list[str], random: list[str] | None = None) -> DataFrame:
    """Share of each covariate (type II sum of squares; random intercepts by moments) and of the residual, per feature."""
    random = random or []
    every = [*fixed, *random]
    pdf = sample_frame(meta, every)
    have = set(sample_ids(m))
    pdf = pdf[pdf["sample"].isin(have)].reset_index(drop=True)
    n = len(pdf)
    part = {v: _columns(pdf[v], False)[0] for v in every}
    hat = lambda vs: (lambda x: np.eye(n) - x @ np.linalg.pinv(x))(np.column_stack([np.ones(n), *[part[v] for v in vs]]))
    full = hat(every)
    reduced = {v: hat([u for u in every if u != v]) for v in every}
    rank = {v: max(1, round(np.trace(reduced[v]) - np.trace(full))) for v in every}
    dfr = max(1, round(np.trace(full)))

    def run(it):
        for p in it:
            if not len(p):
                continue
            y = prepare(np.vstack(p["vec"].to_numpy()))
            rss = ((y @ full) ** 2).sum(1)
            ss = {v: np.maximum(((y @ reduced[v]) ** 2).sum(1) - rss, 0) for v in every}
            for v in random:
                # a random intercept keeps what exceeds its expected residual share
                ss[v] = np.maximum(ss[v] - rank[v] * rss / dfr, 0)
            tot = rss + sum(ss.values())
            yield pd.concat([pd.DataFrame({"layer": p["layer"], "feature": p["feature"], "term": t, "fraction": s / np.where(tot > 0, tot, 1)})
                             for t, s in [*ss.items(), ("Residuals", rss)]])

    return vectors(m, list(pdf["sample"])).mapInPandas(run, "layer string, feature string, term string, fraction double")


# ---- variation partitioning and ordination ---------------------------------------------------

def _adj_r2(y: np.ndarray, x: np.ndarray) -> float:
    n = len(y)
    yc, xc = y - y.mean(0), x - x.mean(0)
    fit = xc @ np.linalg.pinv(xc) @ yc
    p = np.linalg.matrix_rank(xc)
    r2 = (fit ** 2).sum() / (yc ** 2).sum()
    return float(1 - (1 - r2) * (n - 1) / max(n - p - 1, 1))


def _permuted(spark, fn, perms: int, seed: int, payload) -> np.ndarray:
    """``fn(permutation, payload)`` for every permutation id, spread over tasks; ids make the draws reproducible."""
    shared = spark.sparkContext.broadcast(payload)
    n = payload["n"]

    def run(it):
        for pdf in it:
            yield pd.DataFrame({"i": pdf["i"], "v": [np.atleast_1d(fn(np.random.default_rng([seed, int(i)]).permutation(n), shared.value)).tolist() for i in pdf["i"]]})

    d = spark.createDataFrame([(i,) for i in range(perms)], "i int").repartition(16).mapInPandas(run, "i int, v array<double>")
    return np.array([r["v"] for r in d.orderBy("i").collect()])


def traits_matrix(meta: DataFrame, traits: list[str], order: list[str]) -> np.ndarray:
    s = sample_frame(meta, traits).set_index("sample").loc[order]
    cols = [s[t].to_numpy(float)[:, None] if pd.api.types.is_numeric_dtype(s[t]) else _columns(s[t], True)[0] for t in traits]
    x = np.column_stack(cols)
    return (x - x.mean(0)) / np.where(x.std(0, ddof=1) > 0, x.std(0, ddof=1), 1)


def vpa(m: DataFrame, meta: DataFrame, l1: str, l2: str, traits: list[str], pcs: int = 10, perms: int = 999, seed: int = 1) -> DataFrame:
    """Adjusted R2 fractions of traits by two layers (10 components each): a only first, b shared, c only second, d rest."""
    order = shared_samples(m.where(F.col("layer").isin(l1, l2)), meta)
    gs = grams(vectors(m.where(F.col("layer").isin(l1, l2)), order), lambda x, lay: prepare(x, True, True))
    x1, x2 = (u * np.sqrt(w) for w, u in (_eig(gs[l], min(pcs, len(order) - 2)) for l in (l1, l2)))
    y = traits_matrix(meta, traits, order)
    ra, rb, rc = _adj_r2(y, x1), _adj_r2(y, x2), _adj_r2(y, np.column_stack([x1, x2]))

    def f_partial(y, x, z):
        zz = np.column_stack([np.ones(len(y)), z])
        hz = zz @ np.linalg.pinv(zz)
        full = np.column_stack([zz, x])
        hf = full @ np.linalg.pinv(full)
        ry = y - hz @ y
        rss = ((y - hf @ y) ** 2).sum()
        k = np.linalg.matrix_rank(full) - np.linalg.matrix_rank(zz)
        return ((ry ** 2).sum() - rss) / max(k, 1) / (rss / max(len(y) - np.linalg.matrix_rank(full), 1))

    def stat(perm, p):
        out = []
        for x, z in ((p["x1"], p["x2"]), (p["x2"], p["x1"])):
            zz = np.column_stack([np.ones(len(z)), z])
            fit = zz @ np.linalg.pinv(zz) @ p["y"]
            out.append(f_partial(fit + (p["y"] - fit)[perm], x, z))
        return out

    obs = np.array([f_partial(y, x1, x2), f_partial(y, x2, x1)])
    null = _permuted(m.sparkSession, stat, perms, seed, {"n": len(order), "x1": x1, "x2": x2, "y": y})
    p = ((null >= obs - 1e-12).sum(0) + 1) / (perms + 1)
    rows = [("a", rc - rb, float(p[0])), ("b", ra + rb - rc, None), ("c", rc - ra, float(p[1])), ("d", 1 - rc, None)]
    return m.sparkSession.createDataFrame(rows, "fraction string, adj_r2 double, pval double")


def rda(m: DataFrame, meta: DataFrame, variables: list[str], k: int = 5, perms: int = 199, seed: int = 1) -> tuple[Reduction, DataFrame, DataFrame]:
    """Redundancy analysis of features on metadata: constrained axes; biplot scores; permutation F by term."""
    pdf = sample_frame(meta, variables)
    have = set(sample_ids(m))
    order = [s for s in pdf["sample"] if s in have]
    pdf = pdf.set_index("sample").loc[order]
    part = {v: _columns(pdf[v], False)[0] for v in variables}
    x = np.column_stack([part[v] for v in variables])
    x = x - x.mean(0)
    h = x @ np.linalg.pinv(x)
    vecs = vectors(m, order)
    g = sum(grams(vecs, lambda y, lay: prepare(y)).values())
    w, u = _eig(h @ g @ h, min(k, np.linalg.matrix_rank(x)))
    basis = u / np.sqrt(np.where(w > 1e-12, w, np.inf))
    red = Reduction(_scores_df(m.sparkSession, order, u * np.sqrt(w)), loadings(vecs, lambda y, lay: prepare(y) @ h @ basis),
                    _var_df(m.sparkSession, [("constrained", w / np.trace(g))]), {"constrained": float(np.trace(h @ g) / np.trace(g))})
    bi = [(f"x{i}", j + 1, float(np.corrcoef(x[:, i], u[:, j])[0, 1])) for i in range(x.shape[1]) for j in range(u.shape[1])]
    return red, m.sparkSession.createDataFrame(bi, "term string, factor int, value double"), _term_tests(m.sparkSession, g, part, perms, seed)


def _term_tests(spark, g: np.ndarray, part: dict[str, np.ndarray], perms: int, seed: int) -> DataFrame:
    """Sequential F of each term on a centred Gram matrix, with permutation p."""
    n = len(g)
    g = g - g.mean(0) - g.mean(1)[:, None] + g.mean()
    projs, dfs, prev = [], [], np.ones((n, 1)) @ np.ones((1, n)) / n
    cols = np.ones((n, 1))
    for v in part.values():
        cols = np.column_stack([cols, v])
        hat = cols @ np.linalg.pinv(cols)
        projs.append(hat - prev)
        dfs.append(max(1, round(np.trace(hat - prev))))
        prev = hat
    res = np.eye(n) - prev
    dfr = max(1, round(np.trace(res)))

    def stat(perm, p):
        gp = p["g"][np.ix_(perm, perm)]
        rss = (p["res"] * gp).sum() / dfr
        return [(q * gp).sum() / d / rss for q, d in zip(p["projs"], dfs)]

    payload = {"n": n, "g": g, "projs": projs, "res": res}
    obs = np.array(stat(np.arange(n), payload))
    null = _permuted(spark, stat, perms, seed, payload)
    p = ((null >= obs - 1e-12).sum(0) + 1) / (perms + 1)
    rows = [(v, float(d), float(f), float((q * g).sum() / np.trace(g)), float(pp)) for v, d, f, q, pp in zip(part, dfs, obs, projs, p)]
    return spark.createDataFrame(rows, "term string, df double, f double, r2 double, pval double")


def permanova(m: DataFrame, meta: DataFrame, variables: list[str], perms: int = 999, seed: int = 1) -> DataFrame:
    """Partition of squared Euclidean distances between samples by metadata terms: df, F, R2, permutation p."""
    pdf = sample_frame(meta, variables)
    have = set(sample_ids(m))
    order = [s for s in pdf["sample"] if s in have]
    pdf = pdf.set_index("sample").loc[order]
    g = sum(grams(vectors(m, order), lambda y, lay: prepare(y)).values())
    return _term_tests(m.sparkSession, g, {v: _columns(pdf[v], False)[0] for v in variables}, perms, seed)


def biplot(m: DataFrame, k: int = 2, n: int = 10, scale: bool = True) -> tuple[DataFrame, DataFrame]:
    """Scores, and the ``n`` features of largest contribution with arrows scaled to the score range."""
    r = pca(m, k, scale)
    s = r.scores.groupBy("layer").agg(F.max(F.abs("value")).alias("_r"))
    f = r.loadings.groupBy(*FEATURE).agg(F.sum(F.col("value") ** 2).alias("contribution"))
    top = row_numbers(f, ["layer"], "contribution", "feature", "rank", descending=True).where(F.col("rank") <= n)
    a = r.loadings.join(top, FEATURE)
    a = with_stats(a, ["layer"], F.max(F.abs("value")).alias("_m")).join(s, "layer")
    return r.scores, a.select(*FEATURE, "factor", "rank", "contribution", (F.col("value") / F.col("_m") * F.col("_r")).alias("value"))
