"""PCA by block power iteration against numpy."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.operators import reduction as RE, wide as WI
from lamella.plans import fixtures as X

LONG = "layer string, feature string, sample string, value double"


def table(r, rows):
    return r.toPandas().pivot(index=rows, columns="factor", values="value").sort_index().to_numpy()


def same(a, b, what, **tol):
    np.testing.assert_allclose(table(a, what), table(b, what), **tol)


def test_equals_the_sample_matrix_form(spark, sf):
    m = X.log_a(spark, sf)
    a, b = RE.pca(m, 4, True), WI.wide_pca(m, 4, True)
    assert b.info["converged"] == {"revenue": True}
    same(a.scores, b.scores, ["layer", "sample"], atol=1e-5)
    same(a.loadings, b.loadings, ["layer", "feature"], atol=1e-5)
    same(a.var_exp, b.var_exp, ["layer"], atol=1e-9)


def test_stacked_layers(spark, sf):
    m = X.log_ab(spark, sf)
    a, b = RE.combined_pca(m, 3), WI.wide_pca(m, 3, True, stacked=True)
    same(a.scores, b.scores, ["sample"], atol=1e-4)
    same(a.loadings, b.loadings, ["layer", "feature"], atol=1e-4)
    shares = lambda d: table(d, ["layer"])  # rows: all, quantity, revenue
    np.testing.assert_allclose(shares(a.var_exp)[0], shares(b.var_exp)[0], atol=1e-8)
    np.testing.assert_allclose(shares(a.var_exp)[1:], shares(b.var_exp)[1:], atol=1e-4)  # these move with the vectors, not with their square


def test_more_samples_than_a_matrix_could_hold(spark):
    """20,000 samples; values made in Spark from hashes, of which every seventh is missing."""
    n, f = 20000, 30
    noise = lambda *k: F.xxhash64(*k) / F.lit(2.0 ** 63)
    d = spark.range(n).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(f - 1))))
    low = sum(F.lit(3.0 / (r + 1)) * noise(F.lit(r), "id") * noise(F.lit(100 + r), "j") for r in range(4))
    m = d.where((F.col("id") * 31 + F.col("j")) % 7 != 0).select(
        F.lit("l").alias("layer"), F.format_string("f%02d", "j").alias("feature"), F.format_string("s%05d", "id").alias("sample"),
        (low + 0.1 * noise(F.lit(999), "id", "j") + F.col("j")).alias("value")).persist()
    p = m.toPandas().pivot(index="feature", columns="sample", values="value").sort_index()
    x = RE.prepare(p.to_numpy())
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    r = WI.wide_pca(m, 4, extra=8)
    assert r.info["converged"]["l"]
    np.testing.assert_allclose(np.sqrt(r.info["values"]["l"]), s[:4], rtol=1e-6)
    got = table(r.scores, ["sample"])
    np.testing.assert_allclose(np.abs(got), np.abs(vt[:4].T * s[:4]), atol=1e-3)
    np.testing.assert_allclose(got.T @ got, np.diag(s[:4] ** 2), atol=1e-6 * s[0] ** 2)
    m.unpersist()


def test_low_rank_constant_and_absent(spark):
    cells = [("a", f"f{i}", f"s{j}", float((i + 1) * j)) for i in range(4) for j in range(5)]  # rank 1
    cells += [("b", "g", f"s{j}", 2.0) for j in range(5)] + [("b", "g", "late", None), ("b", "h", "s0", float("nan"))]
    r = WI.wide_pca(spark.createDataFrame(cells, LONG), 3)
    assert r.info["converged"] == {"a": True, "b": True}
    sc = r.scores.toPandas()
    assert len(sc) == 2 * 6 * 3 and np.isfinite(sc["value"]).all()
    assert (sc[(sc["layer"] == "b") | (sc["factor"] > 1) | (sc["sample"] == "late")]["value"].abs() < 1e-9).all()
    var = {(x["layer"], x["factor"]): x["value"] for x in r.var_exp.collect()}
    assert var["a", 1] == pytest.approx(100) and var["a", 2] == pytest.approx(0, abs=1e-9) and var["b", 1] == 0


def test_too_few_rounds_are_told(spark, sf):
    assert WI.wide_pca(X.log_a(spark, sf), 4, extra=1, rounds=1).info["converged"] == {"revenue": False}


def test_empty(spark):
    r = WI.wide_pca(spark.createDataFrame([], LONG), 2)
    assert r.scores.count() == r.loadings.count() == r.var_exp.count() == 0
