"""Completion by probabilistic PCA: planted ranks, odd tables, and the likelihood against the plain formula."""
import numpy as np

from lamella.operators import impute as IM

LONG = "layer string, feature string, sample string, value double"


def long(x, layer="l"):
    return [(layer, f"f{i:03d}", f"s{j:02d}", None if np.isnan(v) else float(v)) for i, row in enumerate(x) for j, v in enumerate(row)]


def test_recovers_a_planted_rank(spark):
    rng = np.random.default_rng(7)
    full = rng.normal(size=(300, 2)) @ rng.normal(size=(2, 20)) * 2 + rng.normal(size=20) * 5 + rng.normal(size=(300, 20)) * 0.05
    x = np.where(rng.random(full.shape) < 0.2, np.nan, full)
    r = IM.impute_ppca(spark.createDataFrame(long(x), LONG), 2).toPandas()
    assert r["converged"].all() and len(r) == x.size
    got = r.pivot(index="feature", columns="sample", values="value").sort_index().to_numpy()
    gap = np.isnan(x)
    np.testing.assert_array_equal(got[~gap], x[~gap])
    assert np.sqrt(((got - full)[gap] ** 2).mean()) < 0.08  # the noise is 0.05
    assert not IM.impute_ppca(spark.createDataFrame(long(x), LONG), 2, rounds=1).toPandas()["converged"].any()


def test_likelihood_of_patterns():
    rng = np.random.default_rng(1)
    x, w, s2 = rng.normal(size=(6, 5)), rng.normal(size=(5, 2)), 0.7
    x[0, 1] = x[3, 1] = x[4, 2] = np.nan
    want = 0.0
    for row in x:
        ok = ~np.isnan(row)
        c = w[ok] @ w[ok].T + s2 * np.eye(ok.sum())
        want -= 0.5 * (row[ok] @ np.linalg.solve(c, row[ok]) + np.linalg.slogdet(2 * np.pi * c)[1])
    assert np.isclose(sum(p[4] for p in IM._posterior(x, w, s2)), want)


def test_odd_tables(spark):
    x = np.arange(24.0).reshape(6, 4) % 5
    x[1] = np.nan
    x[2, 0] = np.nan
    cells = long(x) + long(np.full((3, 4), 2.0), "flat")
    r = IM.impute_ppca(spark.createDataFrame(cells, LONG), 9).toPandas()
    assert r[(r["layer"] == "l") & (r["feature"] == "f001")]["value"].isna().all()
    assert r[r["feature"] != "f001"]["value"].notna().all() and (r[r["layer"] == "flat"]["value"] == 2).all()
    assert IM.impute_ppca(spark.createDataFrame([], LONG)).count() == 0
