"""Tables of more samples than a sample matrix may have: the same results as with few, which are reached by lowering the limit."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella import core
from lamella.operators import correlation as CO, differential as DI, reduction as RE, wide as WI

LONG = "layer string, feature string, sample string, value double"


@pytest.fixture
def few(monkeypatch):
    return lambda: monkeypatch.setattr(core, "MAX_SAMPLES", 10)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(3, 40))
    rows = [(lay, f"{lay}{i}", f"s{j:02d}", float(v)) for lay, n in (("a", 5), ("b", 7))
            for i, r in enumerate(rng.normal(size=(n, 3)) @ z + 0.3 * rng.normal(size=(n, 40)) + 9) for j, v in enumerate(r)]
    gaps = [(*r[:3], None if k % 11 == 0 else r[3]) for k, r in enumerate(rows)]
    meta = spark.createDataFrame([(f"s{j:02d}", "xyz"[j % 3], "hi" if z[0, j] > 0 else "lo", float(z[1, j])) for j in range(40)], "sample string, g string, h string, x double")
    return spark.createDataFrame(rows, LONG).cache(), spark.createDataFrame(gaps, LONG).cache(), meta.cache()


def rows(df, keys):
    p = df.toPandas().sort_values(keys).reset_index(drop=True)
    return p[keys].to_numpy().tolist(), p[sorted(c for c in p.columns if c not in keys)].to_numpy(float)


def equal(a, b, keys, absolute=False):
    (ka, va), (kb, vb) = rows(a, keys), rows(b, keys)
    assert ka == kb
    np.testing.assert_allclose(np.abs(va) if absolute else va, np.abs(vb) if absolute else vb, rtol=1e-6, atol=1e-8)


def test_correlations(data, few, gaps=1):
    groups = {"one": [f"s{j:02d}" for j in range(0, 40, 2)], "two": [f"s{j:02d}" for j in range(1, 40, 2)]}
    a, b, c = CO.correlate(data[gaps]), CO.correlate(data[gaps], min_abs=0.3, cross_only=True), CO.correlate(data[gaps], groups=groups)
    a, b, c = (x.cache() for x in (a, b, c))
    a.count(), b.count(), c.count()
    few()
    equal(a, CO.correlate(data[gaps]), CO.PAIR_KEYS)
    equal(b, CO.correlate(data[gaps], min_abs=0.3, cross_only=True), CO.PAIR_KEYS)
    equal(c, CO.correlate(data[gaps], groups=groups), [*CO.PAIR_KEYS, "group"])


@pytest.mark.parametrize("scale", [False, True])
def test_pca(data, few, scale):
    m = data[1]
    was = RE.pca(m, 3, scale), RE.combined_pca(m, 3, scale), RE.consensus_pca(m, 3, scale=scale)
    few()
    now = RE.pca(m, 3, scale), RE.combined_pca(m, 3, scale), RE.consensus_pca(m, 3, scale=scale)
    for a, b, keys in zip(was, now, (["layer"], [], [])):
        equal(a.scores, b.scores, [*keys, "sample", "factor"], absolute=True)
        equal(a.loadings, b.loadings, ["layer", "feature", "factor"], absolute=True)
        equal(a.var_exp, b.var_exp, ["layer", "factor"])
    for lay, v in was[2].info["contribution"].items():
        np.testing.assert_allclose(now[2].info["contribution"][lay], v, rtol=1e-6)


def test_wide_pca_and_the_cells_of_a_grid(data, few):
    from lamella.plans.catalog_models import _rebuilt
    m = data[1]
    a, g = WI.wide_pca(m, 3, True, stacked=True), core.densify(m.where("value IS NOT NULL"))
    few()
    b = WI.wide_pca(m, 3, True, stacked=True)
    equal(a.var_exp, b.var_exp, ["layer", "factor"])
    equal(g.fillna(-1.0), core.densify(m.where("value IS NOT NULL")).fillna(-1.0), core.CELL)
    x = m.where("value IS NOT NULL")
    p = x.toPandas()
    p["value"] -= p.groupby(["layer", "feature"])["value"].transform("mean")
    r = _rebuilt(x).toPandas().sort_values(core.CELL)
    np.testing.assert_allclose(r["value"], p.sort_values(core.CELL)["value"], atol=1e-6)


def test_rv(data, few):
    a = RE.rv(data[0])
    few()
    equal(a, RE.rv(data[0]), ["layer1", "layer2"])


@pytest.mark.parametrize("var", ["g", "x"])
def test_block_pls(data, few, var):
    a = RE.block_pls(data[0], data[2], var, 2)
    few()
    b = RE.block_pls(data[0], data[2], var, 2)
    equal(a.var_exp, b.var_exp, ["layer", "factor"])
    equal(a.info["raw_loadings"], b.info["raw_loadings"], ["layer", "feature", "factor"], absolute=True)
    sa, sb = rows(a.scores, ["sample", "factor"])[1], rows(b.scores, ["sample", "factor"])[1]
    for f in (0, 1):  # the sign of a component is free, and turns the scaled score about its middle
        x, y = sa[f::2, 0], sb[f::2, 0]
        assert min(np.ptp(x - y), np.ptp(x + y)) < 1e-6


@pytest.mark.parametrize("var", ["g", "h"])
def test_block_pls_cv(data, few, spark, var):
    m, meta = data[1], data[2].where("sample <> 's07'")
    order = core.shared_samples(m, meta)
    y, names = RE.outcome(meta, var, order)
    classes = spark.createDataFrame([(s, int(c)) for s, c in zip(order, y.argmax(1))], "sample string, cls int")
    dealt = {r["sample"]: r["fold"] for r in RE.dealt_folds(classes, 4, 3).collect()}
    fold = np.array([dealt[s] for s in order])
    for c in range(len(names)):
        assert np.ptp(np.bincount(fold[y.argmax(1) == c], minlength=4)) <= 1
    was = RE._cv_errors(RE.grams(core.vectors(m, order), lambda x, lay: RE.prepare(x, True, True)), y, fold, 4, 3, 0.1)
    few()
    now = RE.block_pls_cv(m, meta, var, 3, folds=4, seed=3).orderBy("ncomp").collect()
    np.testing.assert_allclose([r["error"] for r in now], was, atol=1e-9)
    assert [r["chosen"] for r in now].index(True) == int(np.argmin(was))
    assert min(was) < 0.7


def test_permutations():
    from lamella.operators import tall
    for n in (1, 2, 5, 40, 1000):
        seen = [tall.permuted(np.arange(n), n, tall.permutation_key(j, 1)) for j in range(1, 4)]
        assert all(sorted(p.tolist()) == list(range(n)) for p in seen)
    assert len({tuple(p.tolist()) for p in seen}) == 3
    p = np.array([tall.permuted(np.arange(20), 20, tall.permutation_key(j, 1)) for j in range(4000)])
    assert np.abs(np.array([np.bincount(c, minlength=20) for c in p.T]) - 200).max() < 80


@pytest.mark.parametrize("cells", [1 << 21, 100])
def test_cca_penalty(data, few, cells):
    from lamella.operators import tall
    m = data[1]
    was = RE.cca_penalty(m, "a", "b", [0.3, 0.7], nperm=5).collect()
    order = core.sample_ids(m)
    a, b = (core.checkpointed(core.vectors(m.where(F.col("layer") == l), order)) for l in "ab")
    number = {r["sample"]: r["_n"] for r in tall.numbered(m).collect()}
    assert sorted(number.values()) == list(range(40))
    no = np.array([number[s] for s in order])
    place = np.argsort(no)  # of each number, where it stands in the order
    perms = np.column_stack([np.arange(40)] + [place[np.argsort(tall.permuted(np.arange(40), 40, tall.permutation_key(j, 1)))[no]] for j in range(1, 6)])
    full, pen = np.tile(perms, (1, 2)), np.repeat([0.3, 0.7], 6)
    t = np.tile(RE._first_direction(a, b), (1, 12))
    corr = RE._cca_rounds(a, b, 5, 7, t, pen, pen, full, 3)[2].reshape(2, 6)
    few()
    np.testing.assert_allclose(RE._cca_tall(m, "a", "b", [0.3, 0.7], 5, 3, 1, cells), corr, rtol=1e-6, atol=1e-9)
    now = RE.cca_penalty(m, "a", "b", [0.3, 0.7], nperm=5).collect()
    np.testing.assert_allclose([r["correlation"] for r in now], [r["correlation"] for r in was], rtol=1e-6)


@pytest.mark.parametrize("kw", [{"var": "h", "covars": ["g", "x"]}, {"var": "x", "kind": "cont", "covars": ["h"]}, {"var": "g", "contrasts": {"kind": "pairs"}}])
def test_linear_models(data, few, kw, gaps=1):
    a = DI.lm_test(data[gaps], data[2], **kw).cache()
    a.count()
    few()
    equal(a, DI.lm_test(data[gaps], data[2], **kw), ["layer", "feature", "term"])


def test_a_design_of_lower_rank_is_refused(data, few):
    few()
    with pytest.raises(ValueError, match="rank"):
        DI.lm_test(data[0], data[2].withColumn("g2", F.col("g")), "g", covars=["g2"])
