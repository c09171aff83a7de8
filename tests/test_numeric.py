"""Operators without a SQL twin, against plain numpy, identities and planted signals."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lamella.functions.special import t_two_sided
from lamella.operators import (biomarker as BI, clustering as CL, correlation as CO, differential as DI, enrichment as EN, impute as IM, models as MO,
                               network as NE, normalize as NO, reduction as RE)
from lamella.plans import fixtures as X


def wide(m):
    p = m.toPandas()
    return p.pivot_table(index=["layer", "feature"], columns="sample", values="value", dropna=False).sort_index()


@pytest.fixture(scope="module")
def la(spark, sf):
    return X.log_a(spark, sf).persist()


@pytest.fixture(scope="module")
def meta(spark, sf):
    return X.samples(spark, sf).persist()


@pytest.fixture(scope="module")
def planted(la, meta):
    """Five brands raised by three standard deviations in the richer half."""
    d = la.join(meta.select("sample", "acct_high"), "sample")
    sd = la.groupBy("layer", "feature").agg(F.stddev_samp("value").alias("sd"))
    hit = F.col("feature").isin("Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5") & (F.col("acct_high") == "high")
    return d.join(sd, ["layer", "feature"]).withColumn("value", F.col("value") + F.when(hit, 3 * F.col("sd")).otherwise(0.0)) \
        .select("layer", "feature", "sample", "value").persist()


HITS = {f"Brand#{i}" for i in range(1, 6)}


def test_pca_matches_svd(la):
    x = wide(la).to_numpy()
    x = x - x.mean(1, keepdims=True)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    r = RE.pca(la, 4)
    got = r.scores.toPandas().pivot(index="sample", columns="factor", values="value").sort_index().to_numpy()
    np.testing.assert_allclose(np.abs(got), np.abs((vt[:4].T * s[:4])), atol=1e-8)
    load = r.loadings.toPandas().pivot(index="feature", columns="factor", values="value").sort_index().to_numpy()
    np.testing.assert_allclose(np.abs(load), np.abs(u[:, :4]), atol=1e-8)
    var = r.var_exp.toPandas().sort_values("factor")["value"].to_numpy()
    np.testing.assert_allclose(var, 100 * s[:4] ** 2 / (s ** 2).sum(), atol=1e-8)


def test_unmoderated_model_is_the_t_test(la, meta):
    a = DI.lm_test(la, meta, "acct_high", ref="low", prior=False).toPandas().set_index("feature").sort_index()
    b = DI.t_test(la, meta, "acct_high").toPandas().set_index("feature").sort_index()
    np.testing.assert_allclose(a["stat"], b["stat"], rtol=1e-9)
    np.testing.assert_allclose(a["padj"], b["padj"], rtol=1e-9)
    np.testing.assert_allclose(b["pval"], t_two_sided(b["stat"], b["df"]), rtol=1e-12)


def test_model_with_gaps_uses_own_cells(la, meta):
    gap = la.withColumn("value", F.when((F.col("feature") == "Brand#9") & (F.col("sample").cast("int") % 7 == 0), None).otherwise(F.col("value")))
    a = DI.lm_test(gap, meta, "acct_high", ref="low", prior=False).where("feature = 'Brand#9'").first()
    b = DI.t_test(gap, meta, "acct_high").where("feature = 'Brand#9'").first()
    assert a["stat"] == pytest.approx(b["stat"], rel=1e-9) and a["df"] == b["df"]


def test_covariates_match_numpy(la, meta):
    r = DI.lm_test(la, meta, "acct_high", ref="low", covars=["region"]).toPandas().set_index("feature").sort_index()
    s = meta.toPandas().set_index("sample").sort_index()
    x = np.column_stack([np.ones(len(s)), s["acct_high"] == "high", pd.get_dummies(s["region"]).iloc[:, 1:]]).astype(float)
    y = wide(la).droplevel(0).sort_index()[s.index].to_numpy()
    np.testing.assert_allclose(r["coef"], np.linalg.lstsq(x, y.T, rcond=None)[0][1], rtol=1e-8)


def test_planted_brands_are_found(planted, meta):
    r = DI.lm_test(planted, meta, "acct_high").toPandas()
    assert set(r[r["padj"] < 0.01]["feature"]) == HITS
    y = meta.select("sample", F.col("acct_high").alias("label"))
    assert set(BI.auc(planted, y).orderBy(F.desc("auc")).limit(5).toPandas()["feature"]) == HITS
    perf = BI.mccv_performance(BI.mccv(planted, y, [2, 5], 4)[0])[1].toPandas()
    assert perf["mean_auc"].max() > 0.95
    load = RE.block_pls(planted, meta, "acct_high", 1).info["raw_loadings"].toPandas()
    assert set(load.loc[load["value"].abs().nlargest(5).index, "feature"]) == HITS
    boot = BI.roc_boot(planted, y, 50).toPandas().set_index("feature")
    assert (boot.loc[sorted(HITS), "low"] > 0.8).all()


def test_block_correlation_zero_without_blocks(la, meta):
    r = DI.lm_test(la, meta, "acct_high", ref="low", block="region", prior=False).toPandas().set_index("feature").sort_index()
    b = DI.t_test(la, meta, "acct_high").toPandas().set_index("feature").sort_index()
    assert np.corrcoef(r["stat"], b["stat"])[0, 1] > 0.95


def test_contrasts():
    c, names = DI.build_contrasts(["a", "b", "c"], "pairs")
    assert names == ["b-a", "c-a", "c-b"] and (c.sum(0) == 0).all()
    c, _ = DI.build_contrasts(["a_x", "a_y", "b_x", "b_y"], "interaction")
    assert c[:, 0].tolist() == [1, -1, -1, 1]


def test_partial_correlation(la):
    x = wide(la).to_numpy()
    p = np.linalg.inv(np.corrcoef(x))
    want = -p / np.sqrt(np.outer(np.diag(p), np.diag(p)))
    names = list(wide(la).index.get_level_values(1))
    for r in CO.partial_corr(la).limit(40).collect():
        assert r["r"] == pytest.approx(want[names.index(r["feature1"]), names.index(r["feature2"])], abs=1e-8)


def test_kendall_and_blocks_agree_for_any_block_size(spark, la):
    few = la.where(F.col("feature").isin(*[f"Brand#{i}" for i in range(1, 10)]))
    a = CO.correlate(few, "kendall").toPandas().set_index(["feature1", "feature2"])["r"].sort_index()
    x = wide(few).droplevel(0)
    f1, f2 = a.index[5]
    s = np.sign(x.loc[f1].to_numpy()[:, None] - x.loc[f1].to_numpy()), np.sign(x.loc[f2].to_numpy()[:, None] - x.loc[f2].to_numpy())
    assert a.iloc[5] == pytest.approx((s[0] * s[1]).sum() / np.sqrt((s[0] ** 2).sum() * (s[1] ** 2).sum()))
    from lamella.core import sample_ids, vectors
    from lamella.operators.blocks import pair_blocks
    emit, own, tau = CO._emit, CO._unordered, CO._kendall  # functions travel to the workers, modules do not
    got = pair_blocks(vectors(few, sample_ids(few)), None, lambda lk, x, rk, y, same: emit(lk, rk, own(lk, rk, same), {"r": tau(x, y)[0]}),
                      CO.PAIR + ", r double", blocks=4).toPandas().set_index(["feature1", "feature2"])["r"].sort_index()
    assert len(got) == len(a) and np.allclose(got, a)


def test_mutual_information_of_a_copy_is_largest(la):
    two = la.where(F.col("feature").isin("Brand#1", "Brand#2"))
    copy = two.where("feature = 'Brand#1'").withColumn("feature", F.lit("copy"))
    r = CO.mutual_info(two.unionByName(copy)).toPandas()
    assert set(r.loc[r["mi"].idxmax(), ["feature1", "feature2"]]) == {"Brand#1", "copy"} and r["scaled"].max() == 1


def test_aracne_drops_the_indirect_edge(spark):
    rows = [("x", "a", "x", "b", 0.9), ("x", "b", "x", "c", 0.8), ("x", "a", "x", "c", 0.5)]
    sim = spark.createDataFrame(rows, CO.PAIR + ", mi double")
    assert {(r["feature1"], r["feature2"]) for r in CO.infer_network(sim, "aracne").collect()} == {("a", "b"), ("b", "c")}


def test_graph_measures(spark):
    # two triangles joined by the bridge c - d
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("c", "d", 1.0), ("d", "e", 1.0), ("e", "f", 1.0), ("d", "f", 1.0)], "src string, dst string, weight double")
    b = {r["node"]: r["betweenness"] for r in NE.betweenness(e).collect()}
    assert b["c"] == 6 and b["d"] == 6 and b["a"] == 0
    t = NE.topology(e).first()
    assert t["diameter"] == 3 and t["radius"] == 2 and t["triangles"] == 2
    assert NE.label_components(e.where("src <> 'c'")).select("root").distinct().count() == 2
    assert NE.shortest_paths(e, "a", "f").first()["path"] == ["a", "c", "d", "f"]
    assert NE.min_network(e, spark.createDataFrame([("a",), ("f",)], "node string")).count() == 3
    c = NE.communities(e, min_size=2).toPandas()
    assert set(c["node"]) == set("abcdef")
    assert NE.modularity(e, spark.createDataFrame([(n, int(n > "c")) for n in "abcdef"], "node string, label int")).first()[0] == pytest.approx(6 / 7 - 0.5)
    assert {r["n_edges"] for r in NE.component_stats(e, NE.components(e)).collect()} == {7}


def test_lowrank_imputation_recovers(spark):
    rng = np.random.default_rng(0)
    full = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 20)) + 5
    rows = [("l", f"f{i}", f"s{j:02d}", None if (i * 7 + j * 3) % 11 == 0 else float(full[i, j])) for i in range(60) for j in range(20)]
    m = spark.createDataFrame(rows, "layer string, feature string, sample string, value double")
    got = IM.impute_lowrank(m, 2).toPandas().set_index(["feature", "sample"])["value"]
    err = [abs(got[(f, s)] - full[int(f[1:]), int(s[1:])]) for _, f, s, v in rows if v is None]
    assert np.mean(err) < 0.3
    knn = IM.impute_knn(m, 5, "sample").toPandas()
    assert knn["value"].notna().all() and len(knn) == 1200


def test_qrilc_does_not_depend_on_partitioning(spark, sf):
    d = X.dirty(spark, sf).withColumn("value", F.when(F.col("value") > 0, F.log2("value")))
    a = wide(IM.impute_qrilc(d))
    b = wide(IM.impute_qrilc(d.repartition(3)))
    np.testing.assert_allclose(a.to_numpy(), b.to_numpy(), rtol=1e-12)
    raw = wide(d)
    assert a.to_numpy()[np.isnan(raw.to_numpy())].mean() < np.nanmean(raw.to_numpy())


def test_vsn_is_monotone_and_finite(spark, sf):
    raw, v = wide(X.layer_a(spark, sf)), wide(NO.normalize(X.layer_a(spark, sf), "vsn"))
    assert np.isfinite(v.to_numpy()).all()
    j = raw.columns[0]
    assert (raw[j].rank() == v[j].rank()).all()


def test_nmf_error_does_not_rise(spark, sf):
    for how in (RE.nmf, RE.semi_nmf):
        e = how(X.log_ab(spark, sf), 3, "concat", 6).info["rmse"]
        assert all(b <= a + 1e-6 for a, b in zip(e[1:], e[2:]))


def test_factor_model_and_mcia_explain_a_planted_factor(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=30)
    rows = [(lay, f"f{i}", f"s{j:02d}", float(w * z[j] + 0.3 * rng.normal())) for lay in ("u", "v") for i, w in enumerate(rng.normal(size=25)) for j in range(30)]
    m = spark.createDataFrame(rows, "layer string, feature string, sample string, value double")
    for r in (RE.factor_model(m, 3, 10), RE.mcia(m, 2), RE.consensus_pca(m, 2), RE.combined_pca(m, 2)):
        s = r.scores.where("factor = 1").toPandas().sort_values("sample")["value"].to_numpy()
        assert abs(np.corrcoef(s, z)[0, 1]) > 0.9
    c = RE.sparse_cca(m, "u", "v", 1, 0.5, 0.5, 3)
    assert c.info["correlation"][0] > 0.95


def test_procrustes_undoes_a_rotation(spark, la):
    r = RE.pca(la, 2).scores.drop("layer").persist()
    turn = r.groupBy("sample").pivot("factor", [1, 2]).agg(F.first("value"))
    t = turn.select("sample", (F.col("1") * 0.6 - F.col("2") * 0.8).alias("a"), (F.col("1") * 0.8 + F.col("2") * 0.6).alias("b"))
    turned = t.select("sample", F.explode(F.array(F.struct(F.lit(1).alias("factor"), F.col("a").alias("value")), F.struct(F.lit(2).alias("factor"), F.col("b").alias("value")))).alias("x")).select("sample", "x.*")
    assert RE.procrustes(r, turned)[2] < 1e-10


def test_kmeans_splits_better_than_the_given_labels(spark, sf):
    """The vectors carry next to no class signal, so the bound is the sum of squares, not the label."""
    d = X.layer_d(spark, sf)
    lab, share = CL.kmeans(d, 10, 8, "++")
    x = wide(d).droplevel(0).T
    truth = X.table(spark, sf, "embeddings").toPandas().set_index("vec_id")["label"]
    part = lambda g: ((x - x.groupby(g).transform("mean")) ** 2).to_numpy().sum()
    total = ((x - x.mean()) ** 2).to_numpy().sum()
    ours = lab.toPandas().set_index("sample")["cluster"].loc[x.index].to_numpy()
    assert share == pytest.approx(1 - part(ours) / total, abs=1e-9)
    assert share > 1 - part(truth.loc[x.index.astype(int)].to_numpy()) / total


def test_two_clear_groups(spark):
    rng = np.random.default_rng(5)
    rows = [(lay, f"f{i}", f"s{j:02d}", float(rng.normal() + (6 if j < 15 else 0))) for lay in ("u", "v") for i in range(12) for j in range(30)]
    m = spark.createDataFrame(rows, "layer string, feature string, sample string, value double")
    for lab in (CL.snf_clusters(m, 2)[0], CL.spectral_multiview(m, 2)[0], CL.perturbation(m, range(2, 4), 4)[0], CL.bisecting(m, 2)):
        p = lab.toPandas()
        assert p.assign(g=p["sample"] < "s15").groupby("g")["cluster"].nunique().max() == 1
    s = RE.pca(m, 2).scores.where("layer = 'u'").select("sample", "factor", "value")
    assert CL.density_peaks(s, 2, 3.0).select("cluster").distinct().count() == 2
    assert CL.mean_shift(s, 4.0).select("cluster").distinct().count() == 2


def test_gsea_finds_the_top_set(spark):
    ranked = spark.createDataFrame([(f"g{i}", float(200 - i)) for i in range(400)], "id string, stat double")
    sets = spark.createDataFrame([("top", "top", f"g{i}") for i in range(20)] + [("mix", "mix", f"g{i}") for i in range(0, 400, 20)], "set_id string, set_name string, member string")
    r = EN.gsea(ranked, sets, 200).toPandas().set_index("set_id")
    assert r.loc["top", "pval"] < 0.02 and r.loc["top", "es"] > 0.9 and r.loc["mix", "pval"] > r.loc["top", "pval"]


def test_mediation_of_a_chain(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, 120)
    med = 2 * x + rng.normal(size=120)
    y = 1.5 * med + rng.normal(size=120)
    meta = spark.createDataFrame([(f"s{i:03d}", "ab"[x[i]], float(y[i])) for i in range(120)], "sample string, g string, y double")
    m = spark.createDataFrame([("l", "m", f"s{i:03d}", float(med[i])) for i in range(120)] + [("l", "noise", f"s{i:03d}", float(rng.normal())) for i in range(120)],
                              "layer string, feature string, sample string, value double")
    r = MO.mediation(m, meta, "g", "y", 200).toPandas().set_index(["feature", "effect"])
    assert r.loc[("m", "acme"), "pval"] < 0.05 and r.loc[("noise", "acme"), "pval"] > 0.05
    assert r.loc[("m", "acme"), "estimate"] + r.loc[("m", "ade"), "estimate"] == pytest.approx(r.loc[("m", "total"), "estimate"])
    v = MO.variance_partition(m, meta, ["g"]).toPandas().groupby("feature")["fraction"].sum()
    np.testing.assert_allclose(v, 1)


def test_logistic_report_matches_newton(planted, meta):
    y = meta.select("sample", F.col("acct_high").alias("label"))
    t, cv = BI.logistic_report(planted, y, [("revenue", "Brand#9"), ("revenue", "Brand#10")])
    t = t.toPandas()
    p = wide(planted).droplevel(0).loc[["Brand#9", "Brand#10"]].T
    s = (meta.toPandas().set_index("sample")["acct_high"] == "low").astype(float).loc[p.index].to_numpy()
    a = np.column_stack([np.ones(len(p)), p])
    b = np.zeros(3)
    for _ in range(30):
        q = 1 / (1 + np.exp(-a @ b))
        b = b + np.linalg.solve(a.T @ (a * (q * (1 - q))[:, None]), a.T @ (s - q))
    np.testing.assert_allclose(t["coef"], b, rtol=1e-4)
    np.testing.assert_allclose(t["se"], np.sqrt(np.diag(np.linalg.inv(a.T @ (a * (q * (1 - q))[:, None])))), rtol=1e-3)
    assert cv.count() == len(p)
