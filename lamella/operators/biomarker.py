"""Biomarker modelling (inventory section N).

``y`` is a frame ``sample, label``; the positive class is the last label in sorted order.
"""
from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window as W, functions as F

from lamella.core import FEATURE, MAX_SAMPLES, _fill_gaps, bounded, checkpointed, sample_ids, vectors
from lamella.functions.ranking import row_numbers
from lamella.functions.special import fisher_pvalue, hash_uniform, norm_cdf
from lamella.operators.differential import f_test, t_test
from lamella.operators import forest as forests, logistic, margins
from lamella.operators.filters import top_variance


def classes(y: DataFrame) -> list[str]:
    return sorted(r[0] for r in bounded(y.select("label").where(F.col("label").isNotNull()).distinct(), 1000, "labels"))


def prepare_groups(m: DataFrame, meta: DataFrame, var: str, a: str, b: str | None = None, top: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Layers and labels of two groups (``b`` None: all others), the ``top`` most variable features (None: all), and the size verdict."""
    lab = F.when(F.col(var) == a, a).when(F.lit(b is None) & F.col(var).isNotNull(), "others")
    if b is not None:
        lab = F.when(F.col(var).isin(a, b), F.col(var))
    y = meta.select("sample", lab.alias("label")).where(F.col("label").isNotNull())
    d = m.join(y.select("sample"), "sample", "left_semi")
    n = y.groupBy("label").agg(F.count("*").alias("n"))
    return top_variance(d, top), y, n.withColumn("status", F.when(F.col("n") < 10, "error").when(F.col("n") < 20, "warning").otherwise("ok"))


def _auc_by(d: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Mann-Whitney area; ranks within (keys), a group of at most one row per sample."""
    w = W.partitionBy(*keys).orderBy("value")
    rank = F.rank().over(w) + (F.count("*").over(W.partitionBy(*keys, "value")) - 1) / 2
    is1 = F.col("label") == pos
    g = d.withColumn("_r", rank).groupBy(*keys).agg(F.sum(F.when(is1, F.col("_r"))).alias("_s"), F.count_if(is1).cast("double").alias("n1"), F.count_if(~is1).cast("double").alias("n0"))
    a = (F.col("_s") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))
    return g.select(*keys, a.alias("raw_auc"), F.greatest(a, 1 - a).alias("auc"))


def auc(m: DataFrame, y: DataFrame) -> DataFrame:
    """Direction-free area under the ROC curve per feature, two classes."""
    lev = classes(y)
    if len(lev) != 2:
        return auc_multi(m, y)
    return _auc_by(m.where(F.col("value").isNotNull()).join(y, "sample"), FEATURE, lev[1]).select(*FEATURE, "auc")


def auc_multi(m: DataFrame, y: DataFrame) -> DataFrame:
    """Mean of the pairwise areas."""
    lev = classes(y)
    d = m.where(F.col("value").isNotNull()).join(y, "sample")
    parts = [_auc_by(d.where(F.col("label").isin(a, b)), FEATURE, b) for i, a in enumerate(lev) for b in lev[i + 1:]]
    return reduce(DataFrame.unionByName, parts).groupBy(*FEATURE).agg(F.avg("auc").alias("auc"))


def fold_change(m: DataFrame, y: DataFrame) -> DataFrame:
    """Against the first class: difference when any class mean is negative, else log2 ratio; infinities to +-99; mean over classes."""
    lev = classes(y)
    cm = m.join(y, "sample").groupBy(*FEATURE, "label").agg(F.avg("value").alias("mn"))
    neg = cm.groupBy("layer").agg((F.min("mn") < 0).alias("_neg"))
    base = cm.where(F.col("label") == lev[0]).select(*FEATURE, F.col("mn").alias("base"))
    d = cm.join(base, FEATURE).join(neg, "layer")
    ratio = F.when((F.col("mn") == 0) & (F.col("base") == 0), 0.0).when(F.col("base") == 0, 99.0).when(F.col("mn") == 0, -99.0) \
        .otherwise(F.log2(F.col("mn") / F.nullif(F.col("base"), F.lit(0.0))))
    d = d.withColumn("fc", F.when(F.col("_neg"), F.col("mn") - F.col("base")).otherwise(ratio))
    if len(lev) == 2:
        return d.where(F.col("label") == lev[1]).select(*FEATURE, "fc")
    return d.groupBy(*FEATURE).agg(F.avg("fc").alias("fc"))


def feature_clusters(m: DataFrame, k: int, seed: int = 28051968) -> DataFrame:
    """k-means of the distributed feature vectors (z-scored, gaps at the feature's mean)."""
    v = vectors(m, sample_ids(m))
    seen = F.filter("vec", lambda x: ~F.isnan(x))
    own = F.aggregate(seen, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(seen), F.lit(0))
    v = v.withColumn("_own", F.coalesce(own, F.lit(0.0)))
    v = v.select(*FEATURE, F.transform("vec", lambda x: F.nanvl(x, F.col("_own"))).alias("vec"))
    n = F.size("vec")
    mean = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x) / n
    v = v.withColumn("_m", mean)
    v = v.withColumn("_s", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + (x - F.col("_m")) ** 2) / (n - 1)))
    v = v.withColumn("f", array_to_vector(F.transform("vec", lambda x: (x - F.col("_m")) / F.greatest(F.col("_s"), F.lit(1e-12)))))
    return KMeans(k=k, seed=seed, featuresCol="f").fit(v).transform(v).select(*FEATURE, F.col("prediction").alias("cluster"))


def rank_table(m: DataFrame, y: DataFrame, k: int = 5) -> DataFrame:
    """AUC, p, fold change and feature cluster."""
    two = len(classes(y)) == 2
    p = t_test(m, y, "label", adjust=False) if two else f_test(m, y, "label")
    return (auc(m, y).join(p.select(*FEATURE, "stat", "pval"), FEATURE).join(fold_change(m, y), FEATURE)
            .join(feature_clusters(m, k), FEATURE))


# ---- ROC -----------------------------------------------------------------------------------

def roc(m: DataFrame, y: DataFrame, keys: list[str] = FEATURE, direction: str = "auto") -> DataFrame:
    """Thresholds (midpoints, -inf, inf) with sensitivity, specificity and likelihood ratios; one against the rest for more classes.

    ``direction`` auto: the class with the larger median is the hit; fixed: higher values always speak for the class, as
    predictions do.
    """
    lev = classes(y)
    d = m.where(F.col("value").isNotNull()).join(y, "sample")
    if len(lev) == 2:
        d = d.withColumn("class", F.lit(lev[1])).withColumn("hit", (F.col("label") == lev[1]).cast("int"))
    else:
        d = d.withColumn("class", F.explode(F.array(*[F.lit(c) for c in lev]))).withColumn("hit", (F.col("label") == F.col("class")).cast("int"))
    k = [*keys, "class"]
    med = d.groupBy(*k).agg(F.percentile(F.when(F.col("hit") == 1, F.col("value")), 0.5).alias("_m1"), F.percentile(F.when(F.col("hit") == 0, F.col("value")), 0.5).alias("_m0"),
                            F.sum("hit").alias("n1"), F.count_if(F.col("hit") == 0).alias("n0"))
    c = d.groupBy(*k, "value").agg(F.sum("hit").alias("a"), F.count_if(F.col("hit") == 0).alias("b")).join(med, k)
    w = W.partitionBy(*k).orderBy("value")
    c = c.withColumn("below1", F.sum("a").over(w)).withColumn("below0", F.sum("b").over(w)).withColumn("next", F.lead("value").over(w))
    first = med.select(*k, F.lit(float("-inf")).alias("threshold"), F.lit(0).cast("bigint").alias("below1"), F.lit(0).cast("bigint").alias("below0"), "n1", "n0", "_m1", "_m0")
    rest = c.select(*k, F.when(F.col("next").isNull(), float("inf")).otherwise((F.col("value") + F.col("next")) / 2).alias("threshold"), "below1", "below0", "n1", "n0", "_m1", "_m0")
    t = first.unionByName(rest)
    up = F.lit(True) if direction == "fixed" else F.col("_m0") <= F.col("_m1")
    sens = F.when(up, 1 - F.col("below1") / F.col("n1")).otherwise(F.col("below1") / F.col("n1"))
    spec = F.when(up, F.col("below0") / F.col("n0")).otherwise(1 - F.col("below0") / F.col("n0"))
    t = t.select(*k, "threshold", sens.alias("sens"), spec.alias("spec"))
    return t.withColumn("total", F.col("sens") + F.col("spec")).withColumn("lr_pos", F.col("sens") / F.nullif(1 - F.col("spec"), F.lit(0.0))) \
        .withColumn("lr_neg", (1 - F.col("sens")) / F.nullif(F.col("spec"), F.lit(0.0)))


def best_threshold(curve: DataFrame, how: str = "youden", keys: list[str] = FEATURE) -> DataFrame:
    """Threshold of largest sens + spec, or closest to the top-left corner (ties to the smallest threshold)."""
    s = F.round(F.col("sens") + F.col("spec"), 12) if how == "youden" else -F.round((1 - F.col("sens")) ** 2 + (1 - F.col("spec")) ** 2, 12)
    return curve.groupBy(*keys, "class").agg(F.max_by(F.struct("threshold", "sens", "spec"), F.struct(s, -F.col("threshold"))).alias("_b")).select(*keys, "class", "_b.*")


def roc_at(curve: DataFrame, col: str, value: float, keys: list[str] = FEATURE) -> DataFrame:
    """Coordinates at a threshold, or the best opposite coordinate at a minimum sensitivity / specificity."""
    k = [*keys, "class"]
    if col == "threshold":
        d = curve.where(F.col("threshold") <= value)
        return d.groupBy(*k).agg(F.max_by(F.struct("threshold", "sens", "spec"), "threshold").alias("_b")).select(*k, "_b.*")
    other = "spec" if col == "sens" else "sens"
    return curve.where(F.col(col) >= value).groupBy(*k).agg(F.max_by(F.struct("threshold", "sens", "spec"), F.struct(other, -F.col("threshold"))).alias("_b")).select(*k, "_b.*")


def partial_auc(curve: DataFrame, lo: float = 0.0, hi: float = 1.0, keys: list[str] = FEATURE) -> DataFrame:
    """Trapezoid area for false positive rates in [lo, hi]."""
    k = [*keys, "class"]
    w = W.partitionBy(*k).orderBy("x", "sens")
    d = curve.withColumn("x", 1 - F.col("spec")).withColumn("x0", F.lag("x").over(w)).withColumn("y0", F.lag("sens").over(w)).where(F.col("x0").isNotNull())
    a, b = F.greatest("x0", F.lit(lo)), F.least("x", F.lit(hi))
    at = lambda x: F.col("y0") + (F.col("sens") - F.col("y0")) * (x - F.col("x0")) / F.nullif(F.col("x") - F.col("x0"), F.lit(0.0))
    area = F.when(b > a, (b - a) * (at(a) + at(b)) / 2).otherwise(0.0)
    return d.groupBy(*k).agg(F.sum(area).alias("area"))


def roc_boot(m: DataFrame, y: DataFrame, reps: int = 500, level: float = 0.95, seed: int = 1) -> DataFrame:
    """Stratified bootstrap interval of the AUC per feature.

    The draws of sample positions are seeded and shared by all features; each feature is
    one row with a bounded vector.
    """
    order = sample_ids(m.join(y, "sample", "left_semi"))
    lab = {r["sample"]: r["label"] for r in bounded(y, 5000, "labels")}
    lev = sorted(set(lab.values()))
    one = np.array([lab[s] == lev[1] for s in order])
    rng = np.random.default_rng(seed)
    draws = [np.concatenate([rng.choice(np.flatnonzero(one), one.sum()), rng.choice(np.flatnonzero(~one), (~one).sum())]) for _ in range(reps)]
    n1, n0 = int(one.sum()), int((~one).sum())
    q = [(1 - level) / 2, (1 + level) / 2]

    def run(it):
        for pdf in it:
            rows = []
            for lay, f, v in pdf[["layer", "feature", "vec"]].itertuples(index=False):
                v = np.array(v)
                r = pd.DataFrame(np.array([v[d] for d in draws])).rank(axis=1).to_numpy()
                a = (r[:, :n1].sum(1) - n1 * (n1 + 1) / 2) / (n1 * n0)
                a = a if np.median(a) >= 0.5 else 1 - a
                rows.append((lay, f, *np.quantile(a, q), float(np.median(a))))
            yield pd.DataFrame(rows, columns=["layer", "feature", "low", "high", "median"])

    return vectors(m, order).mapInPandas(run, "layer string, feature string, low double, high double, median double")


#: Poisson(1): the chances of at most 0, 1, ... 11.
POISSON = np.cumsum([np.exp(-1) / math.factorial(k) for k in range(12)])


def poisson_weights(samples: list[str], reps: int, seed: int) -> np.ndarray:
    """Replicates x samples: how often a sample is drawn, from the md5 of ``sample|replicate|seed``."""
    u = np.array([[int(hashlib.md5(f"{s}|{r}|{seed}".encode()).hexdigest()[:8], 16) for s in samples] for r in range(1, reps + 1)], float) / 2 ** 32
    return (u[..., None] > POISSON).sum(-1)


def roc_intervals(m: DataFrame, y: DataFrame, specificities: list[float] = [], thresholds: list[float] = [], reps: int = 200, level: float = 0.95, seed: int = 1) -> DataFrame:
    """``layer, feature, kind, at, low, median, high``: bootstrap intervals of sensitivity at specificities, and of sensitivity and
    specificity at thresholds, for two classes.

    A replicate weighs samples by Poisson(1) counts that all features share; counts of a feature's sorted values then only need
    running sums, and no resampled row is made.  The hit is the class of the larger median in the data.  Replicates without one
    of the classes are left out; features without one of them give nulls.
    """
    lev = classes(y)
    if len(lev) != 2:
        raise ValueError("intervals need two classes")
    order = sample_ids(m.join(y.where(F.col("label").isNotNull()), "sample", "left_semi"))
    label = {r["sample"]: r["label"] for r in bounded(y, MAX_SAMPLES, "labels")}
    one = np.array([label[s] == lev[1] for s in order])
    weights = poisson_weights(order, reps, seed)
    q = [(1 - level) / 2, 0.5, (1 + level) / 2]

    def rows(layer: str, feature: str, x: np.ndarray) -> list[tuple]:
        seen = ~np.isnan(x)
        x, hit, w = x[seen], one[seen], weights[:, seen]
        names = [("sens_at_spec", s) for s in specificities] + [(k, t) for t in thresholds for k in ("sens_at_threshold", "spec_at_threshold")]
        if not hit.any() or hit.all():
            return [(layer, feature, *n, None, None, None) for n in names]
        up = np.median(x[~hit]) <= np.median(x[hit])
        by = np.argsort(x, kind="stable")
        x, w1, w0 = x[by], (w * hit)[:, by], (w * ~hit)[:, by]
        both = (w1.sum(1) > 0) & (w0.sum(1) > 0)
        last = np.flatnonzero(np.r_[x[1:] != x[:-1], True])  # cuts lie between different values
        below1, below0 = (np.column_stack([np.zeros(both.sum()), v[both].cumsum(1)[:, last] / v[both].sum(1)[:, None]]) for v in (w1, w0))
        sens, spec = (1 - below1, below0) if up else (below1, 1 - below0)
        out = []
        for s in specificities:
            out.append(np.where(spec >= s - 1e-12, sens, -1).max(1))
        for t in thresholds:
            k = np.searchsorted(x[last], t, side="right")
            out += [sens[:, k], spec[:, k]]
        return [(layer, feature, *n, *(np.quantile(v, q).tolist() if len(v) else [None] * 3)) for n, v in zip(names, out)]

    def run(it):
        for pdf in it:
            yield pd.DataFrame([r for lay, f, v in pdf[["layer", "feature", "vec"]].itertuples(index=False) for r in rows(lay, f, np.array(v))],
                               columns=["layer", "feature", "kind", "at", "low", "median", "high"])

    return vectors(m, order).mapInPandas(run, "layer string, feature string, kind string, at double, low double, median double, high double")


# ---- splits and classifiers ----------------------------------------------------------------

def mc_splits(y: DataFrame, p: float = 2 / 3, runs: int = 10, seed: int = 1, cap_train: int | None = None) -> DataFrame:
    """``run, sample, label, role``: from each class the same number (p of the smallest, rounded) trains, all others test.

    Order by the md5 of sample, run and seed.  ``cap_train`` bounds the training samples of all classes together.
    """
    small = y.groupBy("label").agg(F.count("*").alias("_n")).agg(F.min("_n").alias("_min")).withColumn("_one", F.lit(1))
    k = y.select("label").distinct().agg(F.count("*").alias("_k")).withColumn("_one", F.lit(1))
    d = y.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs)))).withColumn("_one", F.lit(1)).join(small, "_one").join(k, "_one")
    w = W.partitionBy("run", "label").orderBy(F.md5(F.concat_ws("|", "sample", "run", F.lit(seed))), "sample")
    d = d.withColumn("_r", F.row_number().over(w))
    ntr = F.round(F.col("_min") * p)
    if cap_train is not None:
        ntr = F.least(ntr, F.round(F.lit(cap_train) / F.col("_k")))
    return d.select("run", "sample", "label", F.when(F.col("_r") <= ntr, "train").otherwise("test").alias("role"))


def run_samples(m: DataFrame, splits: DataFrame) -> tuple[DataFrame, list[tuple[int, np.ndarray]], np.ndarray]:
    """Feature vectors over the samples of ``splits``, each run's training samples by place, and the samples' labels as 0/1."""
    pos = classes(splits)[-1]
    rows = bounded(splits.groupBy("sample").agg(F.max((F.col("label") == pos).cast("int")).alias("y"), F.sort_array(F.collect_set(F.when(F.col("role") == "train", F.col("run")))).alias("runs")),
                   MAX_SAMPLES, "samples")
    place = sample_ids(m.join(splits.select("sample").distinct(), "sample", "left_semi"))
    at = {s: i for i, s in enumerate(place)}
    own = sorted((at[r["sample"]], r["y"], r["runs"]) for r in rows if r["sample"] in at)
    runs = sorted({k for _, _, ks in own for k in ks})
    return vectors(m, place), [(k, np.array([i for i, _, ks in own if k in ks])) for k in runs], np.array([y for _, y, _ in own])


def rank_features(m: DataFrame, splits: DataFrame, how: str = "auroc", trees: int = 500, components: int = 2, cost: float = 1.0, seed: int = 1) -> DataFrame:
    """``run, layer, feature, score``: importance from the training part of each run, all runs together.

    ``auroc``, ``f`` and ``fisher`` look at one feature at a time; ``forest`` is the mean decrease in accuracy, ``pls`` the variable
    importance in projection and ``svm`` the squared weight in a linear machine, all with two classes.
    """
    if how in ("forest", "pls", "svm"):
        if len(classes(splits)) != 2:
            raise ValueError(f"{how} ranks for two classes")
        vecs, runs, y = run_samples(m, splits)
        if how == "forest":
            return forests.forest(vecs, runs, y, trees, seed=seed)[1]
        vecs = checkpointed(vecs)
        return margins.pls_importance(vecs, runs, y, components) if how == "pls" else margins.svm_importance(vecs, runs, y, cost)
    tr = splits.where("role = 'train'").select("run", "sample", "label")
    d = m.where(F.col("value").isNotNull()).join(tr, "sample")
    keys = ["run", *FEATURE]
    lev = classes(splits)
    if how == "auroc":
        return _auc_by(d, keys, lev[-1]).select(*keys, F.col("auc").alias("score"))
    if how == "fisher":
        # -log10 of Fisher's exact p of (above the median) x (last class)
        med = d.groupBy(*keys).agg(F.percentile("value", 0.5).alias("_m"))
        up, one = F.col("value") > F.col("_m"), F.col("label") == lev[-1]
        t = d.join(med, keys).groupBy(*keys).agg(F.count_if(up & one).alias("_x"), F.count_if(up).alias("_k"), F.count_if(one).alias("_d"), F.count("*").alias("_n"))
        return t.select(*keys, (-F.log10(fisher_pvalue("_x", "_k", "_n", "_d"))).alias("score"))
    s = d.groupBy(*keys, "label").agg(F.count("*").alias("n"), F.avg("value").alias("mn"), F.var_samp("value").alias("v"))
    t = s.groupBy(*keys).agg(F.sum("n").alias("N"), F.count("*").alias("k"), F.sum((F.col("n") - 1) * F.col("v")).alias("ssw"),
                             F.sum(F.col("n") * F.col("mn")).alias("s1"), F.sum(F.col("n") * F.col("mn") ** 2).alias("s2"))
    return t.select(*keys, ((F.col("s2") - F.col("s1") ** 2 / F.col("N")) / (F.col("k") - 1) / (F.col("ssw") / (F.col("N") - F.col("k")))).alias("score"))


def _plsda(x, y, xt, comps=2):
    mu, sd = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
    x, xt = (x - mu) / sd, (xt - mu) / sd
    yc, b = y - y.mean(), np.zeros(x.shape[1])
    xr, ws, ps, qs = x.copy(), [], [], []
    for _ in range(min(comps, x.shape[1], len(x) - 1)):
        w = xr.T @ yc
        if np.linalg.norm(w) < 1e-12:
            break
        w = w / np.linalg.norm(w)
        t = xr @ w
        p, q = xr.T @ t / (t @ t), yc @ t / (t @ t)
        xr = xr - np.outer(t, p)
        ws.append(w), ps.append(p), qs.append(q)
    if ws:
        wm, pm = np.column_stack(ws), np.column_stack(ps)
        b = wm @ np.linalg.solve(pm.T @ wm, np.array(qs))
    return np.clip(xt @ b + y.mean(), 0, 1), np.abs(b)


def _logit(x, y, xt, ridge=1e-3, rounds=50):
    mu, sd = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
    a = np.column_stack([np.ones(len(x)), (x - mu) / sd])
    at = np.column_stack([np.ones(len(xt)), (xt - mu) / sd])
    b, pen = np.zeros(a.shape[1]), ridge * np.eye(a.shape[1])
    pen[0, 0] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve(a.T @ (a * np.maximum(p * (1 - p), 1e-6)[:, None]) + pen, a.T @ (y - p) - pen @ b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return 1 / (1 + np.exp(-np.clip(at @ b, -30, 30))), np.abs(b[1:])


def _elastic(x, y, xt, folds=5):
    """Elastic net (alpha 0.5) at the penalty that five folds choose; folds take samples in turn within a class."""
    fold = np.empty(len(y), int)
    for c in (0, 1):
        own = np.flatnonzero(y == c)
        fold[own] = np.arange(len(own)) % folds
    beta, _, _ = logistic.elastic_net(logistic.over_arrays(x, y, fold), folds)
    return 1 / (1 + np.exp(-np.clip(beta[0] + xt @ beta[1:], -30, 30))), np.abs(beta[1:])


def _svm(x, y, xt, cost=1.0):
    both = np.vstack([x, xt]).T
    train = np.arange(len(x))
    z = margins.centred(both, train, True)
    own = z[:, train]
    many = len(x) ** 2 > margins.MOST >> 3 and len(x) > 2 * len(z)  # a Gram matrix of the samples would not fit a task
    a, offset, ok = margins.machine(own if many else own.T @ own, y, cost, factor=many)
    if not ok:
        raise ValueError("a machine did not converge")
    w = z[:, train] @ a
    slope, shift = margins.platt(w @ z[:, train] + offset, y)
    return 1 / (1 + np.exp(-np.clip(slope * (w @ z[:, len(x):] + offset) + shift, -30, 30))), w ** 2


SMALL_MODELS = {"plsda": _plsda, "logistic": _logit, "elastic": _elastic, "svm": _svm, "forest": forests.small_forest}


#: Trees times training rows that one forest on the driver may hold.
FOREST_ROWS = 1 << 20


def _forest(train: DataFrame, test: DataFrame, seed: int, trees: int = 300, depth: int = 30) -> DataFrame:
    """Spark ML's forest; one too large for the driver is grown in parts, whose votes are added up before the next is grown."""
    part = max(1, min(trees, FOREST_ROWS // max(1, train.count())))
    fit = lambda n, k: RandomForestClassifier(numTrees=n, maxDepth=depth, seed=seed + 1000003 * k).fit(train)
    prob = vector_to_array("probability")[1]
    if part == trees:
        return fit(trees, 0).transform(test).select("sample", "label", prob.alias("prob"))
    d = test.withColumn("_votes", F.lit(0.0))
    for k, lo in enumerate(range(0, trees, part)):
        n = min(part, trees - lo)
        d = checkpointed(fit(n, k).transform(d).select(*test.columns, (F.col("_votes") + n * prob).alias("_votes")))
    return d.select("sample", "label", (F.col("_votes") / trees).alias("prob"))


def classify(train: DataFrame, test: DataFrame, how: str, seed: int = 1) -> DataFrame:
    """Probability of class 1 for ``test``; frames hold ``sample, label (0/1), x array<double>``.

    The elastic net's penalty is chosen on five folds (``logistic``); the other models are Spark ML's.
    """
    if how == "elastic":
        d = checkpointed(logistic.folded(train.select("sample", F.col("label").cast("double").alias("label"), "x"), 5, seed))
        beta, _, _ = logistic.elastic_net(logistic.over_frame(d), sweeps=300)  # a pass over the samples costs more than sweeps
        return test.select("sample", F.col("label").cast("double").alias("label"), logistic.probability(F.col("x"), beta.tolist()).alias("prob"))
    tr = train.select("sample", F.col("label").cast("double").alias("label"), array_to_vector("x").alias("features"))
    te = test.select("sample", F.col("label").cast("double").alias("label"), array_to_vector("x").alias("features"))
    if how == "svm":
        svm = LinearSVC(maxIter=50, regParam=0.01).fit(tr)
        margin = lambda d: svm.transform(d).select("sample", "label", array_to_vector(F.array(vector_to_array("rawPrediction")[1])).alias("features"))
        return LogisticRegression(regParam=0.001).fit(margin(tr)).transform(margin(te)).select("sample", "label", vector_to_array("probability")[1].alias("prob"))
    if how == "rf":
        return _forest(tr, te, seed)
    est = {"logistic": LogisticRegression(regParam=1e-4)}[how]
    return est.fit(tr).transform(te).select("sample", "label", vector_to_array("probability")[1].alias("prob"))


def run_rows(m: DataFrame, splits: DataFrame, own: DataFrame, pos: str) -> DataFrame:
    """``run, size, sample, n, x, train, one``: a sample as one array of the ``n`` features of a run and size, at their place: NaN where
    it has no cell, 0 where the cell is null or no number.

    ``own``: ``run, size, layer, feature, _i``.  A task then gets a number for each cell of a sample and no names of features;
    samples without any of these cells are left out.
    """
    n = own.groupBy("run", "size").agg(F.count("*").cast("int").alias("n"))
    c = m.join(own, FEATURE).join(splits, ["run", "sample"])
    c = c.groupBy("run", "size", "sample", "label", "role").agg(F.collect_list(F.struct("_i", F.lit(0).alias("gap"), "value")).alias("_cells")).join(F.broadcast(n), ["run", "size"])
    gaps = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(i.alias("_i"), F.lit(1).alias("gap"), F.lit(None).cast("double").alias("value")))
    return _fill_gaps(c, gaps, "_i").select(
        "run", "size", "sample", "n",
        F.transform("_cells", lambda x: F.when(x["gap"] == 1, float("nan")).otherwise(F.coalesce(F.nanvl(x["value"], F.lit(0.0)), F.lit(0.0)))).alias("x"),
        (F.col("role") == "train").alias("train"), F.coalesce(F.col("label") == pos, F.lit(False)).alias("one"))


def mccv(m: DataFrame, y: DataFrame, sizes: list[int] = [2, 3, 5, 10, 20], runs: int = 10, how: str = "plsda", rank: str = "auroc", seed: int = 1,
         splits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Predictions ``run, size, sample, label, prob`` and importances ``run, size, layer, feature, value``.

    Features are ranked inside each run by one distributed job; a (run, size) task
    then holds at most ``max(sizes)`` features of the split samples.
    """
    sp = checkpointed(splits if splits is not None else mc_splits(y, runs=runs, seed=seed))
    scores = rank_features(m, sp, rank).withColumn("_id", F.concat_ws("\x01", *FEATURE))
    r = row_numbers(scores, ["run"], "score", "_id", "rank", descending=True).where(F.col("rank") <= max(sizes))
    own = r.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes]))).where(F.col("rank") <= F.col("size"))
    own = checkpointed(own.select("run", "size", *FEATURE, (F.row_number().over(W.partitionBy("run", "size").orderBy("_id")) - 1).alias("_i")))
    model = SMALL_MODELS[how]

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample", ignore_index=True)
        if pdf["sample"].duplicated().any() or (pdf["x"].str.len() != pdf["n"]).any():
            raise ValueError("a run holds a cell twice")
        x, tr, lab = np.vstack(pdf["x"].to_numpy()), pdf["train"].to_numpy(bool), pdf["one"].to_numpy(float)
        seen = np.flatnonzero(~np.isnan(x).all(0))  # a feature without a cell in the run is no column
        x = np.nan_to_num(x[:, seen], copy=False, posinf=np.inf, neginf=-np.inf)
        prob, imp = model(x[tr], lab[tr], x[~tr])
        a = pd.DataFrame({"run": key[0], "size": key[1], "sample": pdf["sample"].to_numpy()[~tr], "label": lab[~tr].astype(int), "prob": prob, "_i": -1, "value": np.nan})
        b = pd.DataFrame({"run": key[0], "size": key[1], "sample": None, "label": -1, "prob": np.nan, "_i": seen, "value": imp})
        return pd.concat([a, b])

    # the groups are few and their fits dear: a task each, which the size of the data alone would not give
    out = checkpointed(run_rows(m, sp, own, classes(y)[-1]).repartition(min(len(sizes) * runs, 1000), "run", "size").groupBy("run", "size").applyInPandas(
        fit, "run int, size int, sample string, label int, prob double, _i int, value double"))
    return (out.where("label >= 0").select("run", "size", "sample", "label", "prob"),
            out.where("label < 0").join(own, ["run", "size", "_i"]).select("run", "size", "layer", "feature", "value"))


def _pred_auc(pred: DataFrame, keys: list[str]) -> DataFrame:
    d = pred.select(*keys, "sample", F.col("label").cast("string").alias("label"), F.col("prob").alias("value"))
    return _auc_by(d, keys, "1").select(*keys, F.col("raw_auc").alias("auc"))


def mccv_performance(pred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """AUC and accuracy per run and size; mean, 95% range and the best size."""
    acc = pred.groupBy("run", "size").agg(F.avg(((F.col("prob") >= 0.5).cast("int") == F.col("label")).cast("double")).alias("accuracy"))
    per = _pred_auc(pred, ["run", "size"]).join(acc, ["run", "size"])
    s = per.groupBy("size").agg(F.avg("auc").alias("mean_auc"), F.percentile("auc", 0.025).alias("low"), F.percentile("auc", 0.975).alias("high"), F.avg("accuracy").alias("mean_accuracy"))
    best = s.withColumn("_one", F.lit(1)).groupBy("_one").agg(F.max_by("size", F.struct(F.round("mean_auc", 12), -F.col("size"))).alias("_best"))
    return per, s.withColumn("_one", F.lit(1)).join(best, "_one").withColumn("best", F.col("size") == F.col("_best")).drop("_one", "_best")


def mccv_test(m: DataFrame, y: DataFrame, features: DataFrame, runs: int = 10, how: str = "plsda", hold_out: list[str] | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Cross-validation of a chosen feature set; held-out or new samples (no label) predicted by the model of all others."""
    d = m.join(features.select(*FEATURE), FEATURE, "left_semi")
    n = features.count()
    known = y if not hold_out else y.where(~F.col("sample").isin(hold_out))
    pred, _ = mccv(d.join(known, "sample", "left_semi"), known, [n], runs, how, seed=seed)
    if not hold_out:
        return pred, None
    sp = known.select(F.lit(1).alias("run"), "sample", "label", F.lit("train").alias("role")).unionByName(
        y.where(F.col("sample").isin(hold_out)).select(F.lit(1).alias("run"), "sample", "label", F.lit("test").alias("role")))
    held, _ = mccv(d, y, [n], 1, how, seed=seed, splits=sp)
    return pred, held.select("sample", "label", "prob")


def average_roc(pred: DataFrame, how: str = "vertical", points: int = 101) -> DataFrame:
    """Mean ROC over runs on a common grid of false positive rate, true positive rate or threshold, with a 5-95% band."""
    d = pred.select(F.col("run").cast("string").alias("feature"), F.lit("roc").alias("layer"), "sample", F.col("prob").alias("value"))
    y = pred.groupBy("sample").agg(F.max("label").cast("string").alias("label"))
    c = roc(d, y, direction="fixed").select("feature", "threshold", F.round(1 - F.col("spec"), 12).alias("fpr"), F.round("sens", 12).alias("tpr"))
    key, val = {"vertical": ("fpr", "tpr"), "horizontal": ("tpr", "fpr"), "threshold": ("threshold", "tpr")}[how]
    grid = c.select("feature").distinct().withColumn("g", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i / (points - 1))))
    step = c.groupBy("feature", F.col(key).alias("g")).agg((F.min(val) if how == "horizontal" else F.max(val)).alias("v"))
    allp = grid.select("feature", "g", F.lit(None).cast("double").alias("v"), F.lit(1).alias("ask")).unionByName(step.select("feature", "g", "v", F.lit(0).alias("ask")))
    if how == "vertical":
        w = W.partitionBy("feature").orderBy("g", "ask").rowsBetween(W.unboundedPreceding, 0)
        look = F.last("v", ignorenulls=True).over(w)
    else:
        w = W.partitionBy("feature").orderBy("g", F.desc("ask")).rowsBetween(0, W.unboundedFollowing)
        look = F.first("v", ignorenulls=True).over(w)
    r = allp.withColumn("y", look).where("ask = 1")
    return r.groupBy("g").agg(F.avg("y").alias("mean"), F.percentile("y", 0.05).alias("low"), F.percentile("y", 0.95).alias("high"))


def importance(imp: DataFrame, n: int) -> DataFrame:
    """Selection frequency (rank within a run at most n) and mean importance."""
    w = W.partitionBy("run", "size").orderBy(F.desc(F.round("value", 12)), *FEATURE)
    d = imp.withColumn("_r", F.row_number().over(w))
    runs = imp.select("run").distinct().agg(F.count("*").alias("_runs")).withColumn("_one", F.lit(1))
    g = d.groupBy(*FEATURE).agg(F.count_if(F.col("_r") <= n).alias("_s"), F.avg("value").alias("importance")).withColumn("_one", F.lit(1))
    return g.join(runs, "_one").select(*FEATURE, (F.col("_s") / F.col("_runs")).alias("frequency"), "importance")


def high_low(m: DataFrame, y: DataFrame) -> DataFrame:
    """Class of the larger median per feature."""
    s = m.join(y, "sample").groupBy(*FEATURE, "label").agg(F.percentile("value", 0.5).alias("med"))
    return s.groupBy(*FEATURE).agg(F.max_by("label", "med").alias("high"), F.min_by("label", "med").alias("low"))


def confusion(pred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean probability and class per sample; counts of actual against predicted."""
    s = pred.groupBy("sample").agg(F.max("label").alias("label"), F.avg("prob").alias("prob")).withColumn("predicted", (F.col("prob") >= 0.5).cast("int"))
    return s, s.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def permutation_test(m: DataFrame, y: DataFrame, size: int, perms: int = 20, how: str = "plsda", seed: int = 1) -> DataFrame:
    """AUC with the observed labels (run 1) and with labels shuffled by hash; empirical p."""
    sp = mc_splits(y, runs=perms + 1, seed=seed)
    order = W.partitionBy("run").orderBy("sample")
    mixed = W.partitionBy("run").orderBy(F.xxhash64("sample", "run", F.lit(seed + 7)), "sample")
    pos = sp.withColumn("_i", F.row_number().over(order))
    lab = sp.select("run", F.col("label").alias("_l"), F.row_number().over(mixed).alias("_i"))
    sp2 = pos.join(lab, ["run", "_i"]).withColumn("label", F.when(F.col("run") == 1, F.col("label")).otherwise(F.col("_l"))).select("run", "sample", "label", "role")
    pred, _ = mccv(m, y, [size], how=how, splits=sp2)
    per, _ = mccv_performance(pred)
    obs = per.where("run = 1").select(F.col("auc").alias("_obs"), F.lit(1).alias("_one"))
    p = per.where("run > 1").withColumn("_one", F.lit(1)).join(obs, "_one").groupBy("_one").agg(((F.count_if(F.col("auc") >= F.col("_obs")) + 1) / (F.count("*") + 1)).alias("pval"))
    return per.withColumn("_one", F.lit(1)).join(p, "_one").select("run", "auc", "accuracy", "pval")


def equation(names: list[str], coef: list[float]) -> str:
    """The model as text, coefficients to three places."""
    return f"{coef[0]:.3f}" + "".join(f" {'-' if c < 0 else '+'} {abs(c):.3f} {n}" for n, c in zip(names, coef[1:]))


def logistic_model(m: DataFrame, y: DataFrame, features: list[tuple[str, str]], folds: int = 10, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """A logistic model of a few features for two classes, with stratified cross-validation.

    Coefficients (SE, z, p, odds ratio, whether the fit converged); probabilities of the samples by the fits that left their fold
    out; performance: AUC, sensitivity and specificity of training and cross-validation at the threshold closest to the top-left
    corner of the cross-validated curve; the equation.  All fits share each pass over the samples.  Samples with a gap in one of
    the features are left out.
    """
    pos = classes(y)[-1]
    names = [f"{l}:{f}" for l, f in features]
    wide = m.join(y, "sample").groupBy("sample", "label").agg(*[F.max(F.when((F.col("layer") == l) & (F.col("feature") == f), F.col("value"))).alias(f"x{i}")
                                                                for i, (l, f) in enumerate(features)]).dropna()
    w = W.partitionBy("label").orderBy(F.xxhash64("sample", F.lit(seed)), "sample")
    d = checkpointed(wide.select("sample", (F.col("label") == pos).cast("double").alias("label"), F.array(*[f"x{i}" for i in range(len(features))]).alias("x"),
                                 F.pmod(F.row_number().over(w), F.lit(folds)).alias("fold")))
    fits = logistic.path(logistic.over_frame(d), folds, lambdas=np.zeros(1), tol=1e-9)
    coef, se = fits.beta[0, 0].tolist(), np.sqrt(np.diag(np.linalg.pinv(fits.gram[0, 0]))).tolist()
    rows = [(n, c, e, c / e if e else None, float(2 * norm_cdf(-abs(c / e))) if e else None, float(np.exp(min(c, 700.0))), bool(fits.converged[0, 0])) for n, c, e in zip(["(Intercept)", *names], coef, se)]
    table = m.sparkSession.createDataFrame(rows, "term string, coef double, se double, z double, pval double, odds double, converged boolean")
    fit = F.explode(F.array(*[F.struct(F.lit(k).alias("fit"), logistic.probability(F.col("x"), fits.beta[k + 1, 0].tolist()).alias("prob")) for k in range(folds)])).alias("p")
    every = d.select("sample", F.col("label").cast("int").alias("label"), "fold", fit).select(
        "sample", "label", F.when(F.col("p.fit") == F.col("fold"), "cross-validation").otherwise("training").alias("part"), "p.prob")
    every = checkpointed(every)
    cv = every.where("part = 'cross-validation'")
    curve = roc(cv.select(F.lit("model").alias("layer"), F.lit("cv").alias("feature"), "sample", F.col("prob").alias("value")),
                cv.select("sample", F.col("label").cast("string").alias("label")), direction="fixed")
    best = best_threshold(curve, "topleft").select("threshold", F.lit(1).alias("_one"))
    hit = F.col("prob") > F.col("threshold")
    at = (every.withColumn("_one", F.lit(1)).join(best, "_one").groupBy("part", "threshold")
          .agg((F.count_if(hit & (F.col("label") == 1)) / F.nullif(F.count_if(F.col("label") == 1), F.lit(0))).alias("sens"),
               (F.count_if(~hit & (F.col("label") == 0)) / F.nullif(F.count_if(F.col("label") == 0), F.lit(0))).alias("spec")))
    return table, cv.select("sample", "label", "prob"), _pred_auc(every, ["part"]).join(at, "part"), equation(names, coef)


def logistic_report(m: DataFrame, y: DataFrame, features: list[tuple[str, str]], folds: int = 10, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The coefficients and the cross-validated predictions of ``logistic_model``."""
    return logistic_model(m, y, features, folds, seed)[:2]
