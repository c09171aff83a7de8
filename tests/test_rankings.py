"""PLS importance, linear machines and classifiers inside cross-validation against plain numpy."""
import numpy as np
import pytest

from lamella.core import checkpointed
from lamella.operators import biomarker as B, margins as M


def layer(spark, n=60, p=8, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * np.arange(1, p + 1)
    y = (x[:, 0] + x[:, 1] / 4 + 0.5 * rng.normal(size=n) > 0).astype(int)
    x[:, 5] = 7
    cells = [("a" if j < 5 else "b", f"f{j}", f"s{i:03d}", float(x[i, j])) for i in range(n) for j in range(p) if not (i == 3 and j == 4)]
    m = spark.createDataFrame(cells, "layer string, feature string, sample string, value double").repartition(4)
    labels = spark.createDataFrame([(f"s{i:03d}", "case" if v == 0 else "z") for i, v in enumerate(y)], "sample string, label string")
    x[3, 4] = np.nan
    return x, y, m, labels


def trained(splits):
    out = {}
    for r in splits.where("role = 'train'").collect():
        out.setdefault(r.run, []).append(int(r.sample[1:]))
    return {k: np.sort(v) for k, v in out.items()}


def vip(x, y, comps):
    x = np.where(np.isnan(x), np.nanmean(x, 0), x)
    x, y = x - x.mean(0), y - y.mean()
    out, w2, ss = [], np.zeros((0, x.shape[1])), []
    for _ in range(comps):
        w = x.T @ y
        w /= np.linalg.norm(w)
        t = x @ w
        q = y @ t / (t @ t)
        x = x - np.outer(t, x.T @ t / (t @ t))
        w2, ss = np.vstack([w2, w ** 2]), [*ss, q ** 2 * (t @ t)]
        out.append(np.sqrt(len(w) * (w2.T * ss).sum(1) / sum(ss)))
    return np.mean(out, 0)


def test_pls_importance_equals_nipals(spark):
    x, y, m, labels = layer(spark)
    splits = checkpointed(B.mc_splits(labels, runs=3))
    for comps in (1, 2, 3):
        got = {(r.run, int(r.feature[1:])): r.score for r in B.rank_features(m, splits, "pls", components=comps).collect()}
        for run, train in trained(splits).items():
            assert np.allclose([got[run, j] for j in range(8)], vip(x[train], y[train], comps), atol=1e-8)


def test_svm_weights_solve_the_machine(spark):
    x, y, m, labels = layer(spark)
    splits = checkpointed(B.mc_splits(labels, runs=2))
    got = {(r.run, int(r.feature[1:])): r.score for r in B.rank_features(m, splits, "svm").collect()}
    for run, train in trained(splits).items():
        z = x[train] - np.nanmean(x[train], 0)
        z = np.nan_to_num(z)
        sd = np.sqrt((z ** 2).sum(0) / (len(z) - 1))
        z = np.where(sd > 1e-9, z / np.where(sd > 0, sd, 1), 0)
        s = np.where(y[train] == 1, 1.0, -1.0)
        a, b, ok = M.machine(z @ z.T, y[train])
        w = z.T @ a
        # no gap between the problem and its dual: the weights are optimal
        primal = w @ w / 2 + np.maximum(0, 1 - s * (z @ w + b)).sum()
        dual = np.abs(a).sum() - w @ w / 2
        assert ok and abs(primal - dual) < 1e-3 and (a * s >= -1e-12).all() and (np.abs(a) <= 1 + 1e-12).all() and abs(a.sum()) < 1e-9
        assert np.allclose([got[run, j] for j in range(8)], w ** 2, atol=1e-6)
        assert got[run, 5] == 0 and max(range(8), key=lambda j: got[run, j]) in (0, 1)


def test_forest_ranking(spark):
    _, _, m, labels = layer(spark)
    got = B.rank_features(m, B.mc_splits(labels, runs=2), "forest", trees=60).collect()
    assert len(got) == 16
    for run in (1, 2):
        own = {r.feature: r.score for r in got if r.run == run}
        assert max(own, key=own.get) in ("f0", "f1") and own["f5"] == 0


@pytest.mark.parametrize("how", ["elastic", "svm", "forest"])
def test_classifiers_inside_cross_validation(spark, how):
    _, _, m, labels = layer(spark, n=90)
    pred, imp = B.mccv(m, labels, [2, 4], runs=2, how=how)
    per = B.mccv_performance(pred)[0].collect()
    assert len(per) == 4 and min(r.auc for r in per) > 0.75
    assert imp.count() == 2 * (2 + 4)
