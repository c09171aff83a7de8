"""Elastic-net paths and logistic reports against plain numpy."""
import numpy as np
import pytest

from lamella.operators import biomarker as B, logistic as L


def data(n=160, p=6, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * np.array([1, 5, 0.1, 1, 1, 0])[:p] + 3
    eta = (x[:, 0] - 3) * 1.5 - (x[:, 1] - 3) * 0.2
    return x, (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(float)


def plain(x, y, lam, alpha=0.5):
    """One fit by proximal gradient steps on standardised features."""
    n = len(y)
    sd = x.std(0)
    z = np.where(sd > 0, (x - x.mean(0)) / np.where(sd > 0, sd, 1), 0)
    a = np.column_stack([np.ones(n), z])
    b = np.zeros(a.shape[1])
    step = 4 * n / np.linalg.norm(a, 2) ** 2
    was, t = b.copy(), 1.0
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-a @ was))
        new = was + step * a.T @ (y - p) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * lam * alpha, 0) / (1 + step * lam * (1 - alpha))
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        was = new + (t - 1) / t1 * (new - b)
        if np.abs(new - b).max() < 1e-12:
            break
        b, t = new, t1
    beta = np.where(sd > 0, b[1:] / np.where(sd > 0, sd, 1), 0)
    return np.r_[b[0] - beta @ x.mean(0), beta]


def test_path_and_choice_equal_numpy(spark):
    x, y = data()
    d = L.folded(spark.createDataFrame([(str(i), float(v), r.tolist()) for i, (r, v) in enumerate(zip(x, y))], "sample string, label double, x array<double>").repartition(3), 5)
    rows = sorted(d.collect(), key=lambda r: int(r.sample))
    fold = np.array([r.fold for r in rows])
    beta, lam, fits = L.elastic_net(L.over_frame(d), penalties=20)
    again = L.elastic_net(L.over_arrays(x, y, fold), penalties=20)
    assert fits.converged.all() and np.allclose(beta, again[0], atol=1e-8) and lam == pytest.approx(again[1])
    wrong = np.zeros((5, 20))
    for q, l in enumerate(fits.lambdas):
        assert np.allclose(fits.beta[0, q], plain(x, y, l), atol=1e-5)
        for k in range(5):
            b = plain(x[fold != k], y[fold != k], l)
            wrong[k, q] = ((b[0] + x[fold == k] @ b[1:] > 0) != (y[fold == k] > 0.5)).sum()
    best = int(np.argmin(wrong.sum(0)))
    assert lam == fits.lambdas[best] and np.allclose(beta, plain(x, y, lam), atol=1e-5)
    assert (fits.beta[0, 0, 1:] == 0).all() and (fits.beta[0, -1, 1:5] != 0).all() and (fits.beta[..., 6] == 0).all()


def test_no_penalty_is_maximum_likelihood():
    x, y = data(300, 4)
    fits = L.path(L.over_arrays(x, y, np.arange(300) % 10), 10, lambdas=np.zeros(1))
    for k in (0, 1, 10):
        use = np.arange(300) % 10 != k - 1
        a = np.column_stack([np.ones(use.sum()), x[use]])
        p = 1 / (1 + np.exp(-a @ fits.beta[k, 0]))
        assert np.abs(a.T @ (y[use] - p)).max() < 1e-6
    assert fits.converged.all()


def test_odd_tables():
    one = L.elastic_net(L.over_arrays(np.zeros((4, 1)), np.array([0.0, 1, 0, 1]), np.zeros(4, int)))
    assert one[0].tolist() == [0.0, 0.0]
    with pytest.raises(ValueError, match="too many features"):
        L.elastic_net(L.over_arrays(np.random.default_rng(0).normal(size=(5, 400)), np.array([0.0, 1, 0, 1, 1]), np.arange(5) % 5))


def test_report_leaves_folds_out(spark):
    x, y = data(120, 2, seed=4)
    cells = [("a", f"f{j}", f"s{i}", float(x[i, j])) for i in range(120) for j in range(2) if (i, j) != (7, 1)]
    m = spark.createDataFrame(cells, "layer string, feature string, sample string, value double").repartition(3)
    labels = spark.createDataFrame([(f"s{i}", "one" if v else "none") for i, v in enumerate(y)], "sample string, label string")
    table, cv, perf, text = B.logistic_model(m, labels, [("a", "f0"), ("a", "f1")])
    own = [i for i in range(120) if i != 7]
    a = np.column_stack([np.ones(119), x[own]])
    lab = y[own]

    def newton(use):
        b = np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-a[use] @ b))
            b = b + np.linalg.solve(a[use].T @ (a[use] * (p * (1 - p))[:, None]), a[use].T @ (lab[use] - p))
        return b

    whole = newton(np.ones(119, bool))
    p = 1 / (1 + np.exp(-a @ whole))
    se = np.sqrt(np.diag(np.linalg.inv(a.T @ (a * (p * (1 - p))[:, None]))))
    rows = table.collect()
    assert np.allclose([r.coef for r in rows], whole, atol=1e-7) and np.allclose([r.se for r in rows], se, rtol=1e-5) and all(r.converged for r in rows)
    assert text.startswith(f"{whole[0]:.3f} ") and f"{abs(whole[2]):.3f} a:f1" in text
    got = {int(r["sample"][1:]): r for r in cv.collect()}
    assert sorted(got) == own and all(got[i].label == y[i] for i in own)
    from pyspark.sql import Window as W, functions as F
    numbered = m.join(labels, "sample").groupBy("sample", "label").count().where("count = 2").withColumn(
        "fold", F.pmod(F.row_number().over(W.partitionBy("label").orderBy(F.xxhash64("sample", F.lit(1)), "sample")), F.lit(10)))
    fold = {int(r["sample"][1:]): r.fold for r in numbered.collect()}
    at = np.array([fold[i] for i in own])
    prob = np.zeros(119)
    for k in range(10):
        prob[at == k] = 1 / (1 + np.exp(-a[at == k] @ newton(at != k)))
    assert np.allclose([got[i].prob for i in own], prob, atol=1e-7)
    r = {r.part: r for r in perf.collect()}
    auc = np.mean([[0.5 * (u == v) + (u > v) for v in prob[lab == 0]] for u in prob[lab == 1]])
    assert r["cross-validation"].auc == pytest.approx(auc) and r["training"].auc > 0.6
    cuts = [(-np.inf if i < 0 else c) for i, c in enumerate([0])] + sorted(prob)
    best = min((round((1 - (prob[lab == 1] > c).mean()) ** 2 + (1 - (prob[lab == 0] <= c).mean()) ** 2, 12) for c in cuts))
    cv_row = r["cross-validation"]
    assert round((1 - cv_row.sens) ** 2 + (1 - cv_row.spec) ** 2, 12) == pytest.approx(best)
