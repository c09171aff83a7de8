"""More of the operators with more samples than a sample matrix may have: the same results as with few, by lowering the limit."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella import core
from lamella.operators import clustering as CL, correlation as CO, differential as DI, impute as IM, metadata as ME, models as MO, reduction as RE
from test_tall import data, equal, few, rows  # noqa: F401


def both(few, fn):
    """The result below and beyond the limit."""
    a = core.checkpointed(fn())
    few()
    return a, fn()


@pytest.mark.parametrize("gaps", [0, 1])
@pytest.mark.parametrize("method", ["kendall", "spearman"])
def test_rank_correlations(data, few, method, gaps):
    m = data[gaps].withColumn("value", F.round("value", 0))
    groups = {"one": [f"s{j:02d}" for j in range(0, 40, 2)], "two": [f"s{j:02d}" for j in range(1, 40, 2)]}
    fns = lambda: CO.correlate(m, method), lambda: CO.correlate(m, method, 0.3, True), lambda: CO.correlate(m, method, groups=groups)
    was = [core.checkpointed(fn()) for fn in fns]
    few()
    for a, fn, keys in zip(was, fns, ([], [], ["group"])):
        equal(a, fn(), [*CO.PAIR_KEYS, *keys])


def test_tau_by_sorting():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 9, (3, 60)).astype(float), rng.integers(0, 5, (4, 60)).astype(float)
    x[0, :7], y[1, 3:20], y[3] = np.nan, np.nan, 1.0
    (r, n), (s, k) = CO._kendall(x, y), CO._kendall_long(x, y, np.ones((3, 4), bool))
    np.testing.assert_allclose(s, r)
    np.testing.assert_array_equal(k, n)
    assert CO._inversions(np.array([3, 1, 2, 0, 0])) == 8


@pytest.mark.parametrize("method", ["kendall", "spearman"])
def test_metadata_rank_correlations(data, few, method):
    a, b = both(few, lambda: ME.meta_corr(data[2], method, digits=9))
    equal(a, b, ["var1", "var2"])


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(6)
    at = np.repeat([[0.0, 0, 0], [6, 0, 3], [0, 7, -4]], 15, axis=0)[:42] + rng.normal(size=(42, 3))
    return spark.createDataFrame([(f"s{i:02d}", j + 1, float(v)) for i, r in enumerate(at) for j, v in enumerate(r)], "sample string, factor int, value double").cache()


def test_density(scores, few):
    a, b = both(few, lambda: CL.density(scores, 1.5))
    pa, pb = (x.toPandas().sort_values("sample", ignore_index=True) for x in (a, b))
    assert pa[["sample", "rho", "denser"]].equals(pb[["sample", "rho", "denser"]])
    np.testing.assert_allclose(pa["delta"], pb["delta"])


@pytest.mark.parametrize("k", [1, 3, 5])
def test_density_peaks(scores, few, k):
    a, b = both(few, lambda: CL.density_peaks(scores, k, 1.5))
    equal(a, b, ["sample"])
    assert b.count() == 42 and b.select("cluster").distinct().count() == k


def test_mean_shift(scores, few):
    a, b = both(few, lambda: CL.mean_shift(scores, 1.2))
    equal(a, b, ["sample"])
    assert b.select("cluster").distinct().count() >= 3


@pytest.mark.parametrize("init", ["random", "++"])
def test_kmeans(scores, few, init):
    m = scores.select(F.lit("l").alias("layer"), F.col("factor").cast("string").alias("feature"), "sample", "value")
    a, share = CL.kmeans(m, 3, 12, init)
    a = core.checkpointed(a)
    few()
    b, other = CL.kmeans(m, 3, 12, init)
    equal(a, b, ["sample"])
    assert other == pytest.approx(share)


def test_spread_starts_differ(scores):
    pts = CL._score_rows(scores)
    c = CL._spread(pts, 3, 20, 1).reshape(20, 3, 3)
    far = [min(((r[i] - r[j]) ** 2).sum() for i in range(3) for j in range(i)) for r in c]
    assert min(far) > 0 and np.median(far) > 9 and len({r[0].tobytes() for r in c}) > 10


def test_silhouette(data, few, spark):
    lab = spark.createDataFrame([(f"s{j:02d}", "pqr"[j % 3] if j % 13 else None) for j in range(38)] + [("s01", "q"), ("s02", "p")], "sample string, cluster string")
    a, b = both(few, lambda: CL.silhouette(data[1], lab))
    pa, pb = (x.fillna("", ["cluster"]) for x in (a, b))
    equal(pa, pb, ["layer", "sample", "cluster"])


@pytest.mark.parametrize("var, covars", [("h", []), ("x", []), ("h", ["g", "x"]), ("x", ["g"])])
def test_interactions(data, few, var, covars):
    a, b = both(few, lambda: MO.interaction_models(data[1], data[2], "a", "b", var, covars))
    equal(a, b, CO.PAIR_KEYS)
    assert b.count() == 35


def test_interactions_without_a_fit(data, few, spark):
    m = data[1].unionByName(spark.createDataFrame([("b", "flat", f"s{j:02d}", 2.0) for j in range(40)] + [("a", "short", f"s{j:02d}", float(j)) for j in range(4)]
                                                  + [("a", "one", f"s{j:02d}", 1.0) for j in range(40)], data[1].schema))
    a, b = both(few, lambda: MO.interaction_models(m.where("feature <> 'flat'"), data[2], "a", "b", "h"))
    equal(a, b, CO.PAIR_KEYS)
    assert b.where("feature1 IN ('short', 'one')").isEmpty() and b.count() == 35


@pytest.mark.parametrize("x, outcome", [("h", "x"), ("x", "h")])
def test_mediation(data, few, x, outcome):
    m = data[1].where("feature IN ('a1', 'b2')")
    a, b = both(few, lambda: MO.mediation(m, data[2], x, outcome, 50))
    equal(a, b, ["layer", "feature", "effect"])


@pytest.mark.parametrize("gaps", [0, 1])
@pytest.mark.parametrize("kw", [{"var": "h", "block": "g"}, {"var": "x", "kind": "cont", "block": "g", "covars": ["h"]}])
def test_linear_models_with_blocks(data, few, kw, gaps):
    m = data[0].unionByName(data[1].withColumn("layer", F.lit("gaps"))) if gaps else data[0]
    a, b = both(few, lambda: DI.lm_test(m, data[2], **kw))
    equal(a, b, ["layer", "feature", "term"])


def holes(m):
    """Null, NaN and absent cells, and a feature that has no value."""
    k = F.abs(F.xxhash64("feature", "sample")) % 9
    return m.withColumn("value", F.when(k == 0, None).when(k == 1, float("nan")).otherwise(F.col("value"))).where(k != 2)


@pytest.mark.parametrize("by", ["feature", "sample"])
def test_nearest_neighbours(data, few, by):
    m = data[0] if by == "feature" else data[0].where("NOT (layer = 'a' AND sample = 's05')")
    m = m.withColumn("value", F.when(F.abs(F.xxhash64("feature", "sample")) % 5 > 0, F.col("value")))
    a, b = both(few, lambda: IM.impute_knn(m, 3, by))
    equal(a, b, core.CELL)
    assert b.where("value IS NULL OR isnan(value)").isEmpty()


def test_low_rank(data, few):
    m = holes(data[0])
    a, b = both(few, lambda: IM.impute_lowrank(m, 2, 300, 1e-7))
    pa, pb = (x.toPandas().sort_values(core.CELL, ignore_index=True) for x in (a, b))
    assert pa["converged"].all() and pb["converged"].all() and pa[core.CELL].equals(pb[core.CELL])
    np.testing.assert_allclose(pa["value"], pb["value"], rtol=1e-4)


def test_probabilistic_pca(data, few, spark):
    m = holes(data[0]).unionByName(spark.createDataFrame([("a", "none", "s03", None), ("c", "none", "s03", None)], data[0].schema))
    a, b = both(few, lambda: IM.impute_ppca(m, 2))
    pa, pb = (x.toPandas().sort_values(core.CELL, ignore_index=True) for x in (a, b))
    assert pa[core.CELL].equals(pb[core.CELL]) and pa["converged"].equals(pb["converged"])
    np.testing.assert_allclose(pa["value"], pb["value"], rtol=1e-5)
    assert pb["value"].isna().sum() == 80


@pytest.mark.parametrize("k", [2, 4])
def test_co_inertia(data, few, k):
    m = data[1].withColumn("value", F.col("value") - 9)
    was = RE.mcia(m, k)
    few()
    now = RE.mcia(m, k)
    equal(was.var_exp, now.var_exp, ["layer", "factor"])
    equal(was.scores, now.scores, ["sample", "factor"])
    equal(was.loadings, now.loadings, ["layer", "feature", "factor"])


def test_factor_model(data, few):
    was = RE.factor_model(data[1], 4, 6)
    few()
    now = RE.factor_model(data[1], 4, 6)
    equal(was.var_exp, now.var_exp, ["layer", "factor"])
    equal(was.scores, now.scores, ["sample", "factor"], True)
    equal(was.loadings, now.loadings, ["layer", "feature", "factor"], True)


def test_a_forest_in_parts_is_the_same_forest(monkeypatch):
    from lamella.operators import forest
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 4))
    y = (x[:, 0] + 0.5 * rng.normal(size=120) > 0).astype(float)
    a = forest.small_forest(x[:80], y[:80], x[80:], 30)
    sizes, was = [], forest.start
    monkeypatch.setattr(forest, "TREE_SAMPLES", 120 * 7)
    monkeypatch.setattr(forest, "start", lambda run, train, y, trees, *rest: (sizes.append(trees), was(run, train, y, trees, *rest))[1])
    b = forest.small_forest(x[:80], y[:80], x[80:], 30)
    np.testing.assert_array_equal(a[0], b[0])
    np.testing.assert_allclose(a[1], b[1])
    assert sizes == [7, 7, 7, 7, 2]


@pytest.mark.parametrize("p", [2, 5, 20])
def test_a_machine_without_a_gram_matrix(monkeypatch, p):
    from lamella.operators import biomarker as BI, margins
    rng = np.random.default_rng(p)
    x = rng.normal(size=(900, p))
    y = (x[:, 0] + rng.normal(size=900) > 0.3).astype(float)
    a = BI._svm(x[:600], y[:600], x[600:])
    held = []
    was = margins.machine
    monkeypatch.setattr(margins, "MOST", 1 << 10)
    monkeypatch.setattr(margins, "machine", lambda gram, *rest, **kw: (held.append(gram.shape), was(gram, *rest, **kw))[1])
    b = BI._svm(x[:600], y[:600], x[600:])
    assert held == [(p, 600)]
    np.testing.assert_allclose(a[0], b[0], atol=1e-6)
    np.testing.assert_allclose(a[1], b[1], atol=1e-6)
