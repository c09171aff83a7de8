"""Rows, draws and paths that no limit may drop, and inputs with gaps and ties."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lamella.core import LONG
from lamella.functions.special import fisher_two_sided
from lamella.operators import biomarker as BI, correlation as CO, differential as DI, enrichment as EN, mapping as MP, network as NE, normalize as NO, quality as QU


def long(spark, rows):
    return spark.createDataFrame([("l", f, s, v) for f, s, v in rows], LONG)


def test_a_layer_of_more_samples_than_the_metadata(spark):
    m = spark.range(12000).select(F.lit("l").alias("layer"), (F.col("id") % 2).cast("string").alias("feature"), F.floor(F.col("id") / 2).cast("string").alias("sample"),
                                  F.rand(1).alias("value"))
    meta = spark.range(3000).select((F.col("id") * 2).cast("string").alias("sample"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"))
    r = DI.lm_test(m, meta, "g").select("df").distinct().collect()
    assert [x.df for x in r] == [2998]


def test_quantile_normalization_with_gaps(spark):
    m = long(spark, [("f1", "s1", 1.0), ("f2", "s1", 2.0), ("f3", "s1", 3.0), ("f1", "s2", 10.0), ("f2", "s2", None), ("f3", "s2", 30.0), ("f1", "s3", None), ("f2", "s3", 7.0), ("f3", "s3", None),
                     ("f1", "s4", None), ("f2", "s4", None), ("f3", "s4", None)])
    got = {(r.feature, r["sample"]): r.value for r in NO.normalize(m, "quantile").collect()}
    x = (1 + 10 + 7) / 3, (2 + 20 + 7) / 3, (3 + 30 + 7) / 3
    assert got[("f1", "s1")] == pytest.approx(x[0]) and got[("f2", "s1")] == pytest.approx(x[1]) and got[("f3", "s1")] == pytest.approx(x[2])
    assert got[("f1", "s2")] == pytest.approx(x[0]) and got[("f3", "s2")] == pytest.approx(x[2]) and got[("f2", "s3")] == pytest.approx(x[1])
    assert len(got) == 12 and sum(v is None for v in got.values()) == 6


def test_quantile_normalization_equals_interpolation(spark):
    rng = np.random.default_rng(3)
    x = pd.DataFrame(np.round(rng.normal(size=(40, 6)), 1))
    x = x.mask(rng.random(x.shape) < 0.2)
    m = long(spark, [(f"f{i}", f"s{j}", None if np.isnan(v) else float(v)) for i, row in x.iterrows() for j, v in enumerate(row)])
    n, grid = len(x), np.arange(len(x)) / (len(x) - 1)
    read = lambda own: np.arange(len(own)) / (len(own) - 1)
    curve = np.mean([np.interp(grid, read(c.dropna()), np.sort(c.dropna())) for _, c in x.items()], axis=0)
    got = {(r.feature, r["sample"]): r.value for r in NO.normalize(m, "quantile").collect()}
    for j, c in x.items():
        own = np.sort(c.dropna())
        at = np.interp(read(own), grid, curve)
        for i, v in c.items():
            want = None if np.isnan(v) else at[own == v].mean()
            assert got[(f"f{i}", f"s{j}")] == (want if want is None else pytest.approx(want)), (i, j, n)


def test_many_quantiles_at_once(spark):
    from lamella.functions.ranking import quantile_grid
    rng = np.random.default_rng(5)
    x = {"a": np.round(rng.normal(size=700), 1), "b": np.array([3.0]), "c": np.r_[np.zeros(300), 1.0, 2.0]}
    probs = [0.0, 0.001, 0.25, 0.5, 0.501, 0.99, 1.0]
    d = spark.createDataFrame([(k, float(v)) for k, own in x.items() for v in own] + [("a", None)], "k string, v double")
    got = {r.k: r["_q"] for r in quantile_grid(d, ["k"], "v", probs).collect()}
    for k, own in x.items():
        assert got[k] == pytest.approx(list(np.quantile(own, probs)))


def test_splits_keep_every_sample(spark):
    y = spark.createDataFrame([(f"s{i}", "a" if i < 50 else "b") for i in range(400)], "sample string, label string")
    c = {(r.label, r.role): r["count"] for r in BI.mc_splits(y, runs=1).groupBy("label", "role").count().collect()}
    assert c == {("a", "train"): 33, ("a", "test"): 17, ("b", "train"): 33, ("b", "test"): 317}
    c = {(r.label, r.role): r["count"] for r in BI.mc_splits(y, runs=1, cap_train=20).groupBy("label", "role").count().collect()}
    assert c == {("a", "train"): 10, ("a", "test"): 40, ("b", "train"): 10, ("b", "test"): 340}


def test_an_inverted_model_has_an_inverted_curve(spark):
    pred = spark.createDataFrame([(1, f"s{i}", int(i < 10), float(i)) for i in range(20)], "run int, sample string, label int, prob double")
    assert BI.average_roc(pred).agg(F.avg("mean")).first()[0] < 0.05


def test_fisher_ranking(spark):
    def brute(h, k, n, d):
        from math import comb
        p = {x: comb(k, x) * comb(n - k, d - x) for x in range(max(0, k + d - n), min(k, d) + 1)}
        return sum(v for v in p.values() if v <= p[h]) / sum(p.values())
    cases = [(3, 5, 12, 6), (0, 5, 12, 6), (5, 5, 10, 5), (2, 4, 8, 4), (7, 10, 30, 9)]
    assert fisher_two_sided(*map(list, zip(*cases))) == pytest.approx([brute(*c) for c in cases])
    y = spark.createDataFrame([(f"s{i}", "b" if i % 2 else "a") for i in range(20)], "sample string, label string")
    m = long(spark, [("signal", f"s{i}", float(i % 2)) for i in range(20)] + [("noise", f"s{i}", float(i)) for i in range(20)])
    sp = BI.mc_splits(y, p=1.0, runs=1)
    s = {r.feature: r.score for r in BI.rank_features(m, sp, "fisher").collect()}
    # half of the values lie above the median only for noise; nothing lies above 0.5 but the ones
    assert s["signal"] == pytest.approx(-np.log10(brute(10, 10, 20, 10))) and s["noise"] == pytest.approx(0.0, abs=1e-6)


def test_mutual_information_with_ties_and_gaps(spark):
    v = [0.0] * 15 + [1.0, 2.0, 3.0, 4.0, 5.0]
    m = long(spark, [(f, f"s{i}", x) for f in ("a", "b") for i, x in enumerate(v)])
    assert 0 < CO.mutual_info(m).first()["mi"] < np.log(20)
    rng = np.random.default_rng(0)
    x = rng.normal(size=30)
    gap = long(spark, [("a", f"s{i}", float(x[i])) for i in range(30)] + [("b", f"s{i}", float(x[i]) if i else None) for i in range(30)])
    cut = long(spark, [(f, f"s{i}", float(x[i])) for f in ("a", "b") for i in range(1, 30)])
    assert CO.mutual_info(gap).first()["mi"] == pytest.approx(CO.mutual_info(cut).first()["mi"]) and CO.mutual_info(gap).first()["mi"] < np.log(29)


def test_names_are_unique(spark):
    names = ["a", "a!", "a.1", "a?", "a.3", "a#", "b", "b.2.1", "b.2", "b.2!"]
    d = QU.clean_names(spark.createDataFrame([(n,) for n in names], "name string"), "sample")
    got = [r.clean for r in d.collect()]
    assert len(set(got)) == len(names) and {"a", "a.1", "a.2", "a.3", "a.4", "a.5", "b.2", "b.2.1", "b.2.2"} <= set(got)


@pytest.mark.parametrize("nperm", [1, 5, 15])
def test_few_permutations_still_give_rows(spark, nperm):
    ranked = spark.createDataFrame([(f"g{i}", float(50 - i)) for i in range(100)], "id string, stat double")
    sets = spark.createDataFrame([("up", f"g{i}") for i in range(20)], "set_id string, member string")
    r = EN.gsea(ranked, sets, nperm).collect()
    assert [x.set_id for x in r] == ["up"] and r[0].pval >= 1 / (nperm + 1) - 1e-12


def test_the_first_paths_are_kept(spark):
    e = [("a", f"x{i}") for i in range(9)] + [(f"x{i}", f"y{j}") for i in range(9) for j in range(9)] + [(f"y{j}", "z") for j in range(9)] + [("a", "dead"), ("dead", "end")]
    edges = spark.createDataFrame([(s, d, 1.0) for s, d in e], "src string, dst string, weight double")
    every = sorted(["a", f"x{i}", f"y{j}", "z"] for i in range(9) for j in range(9))
    assert sorted(r.path for r in NE.shortest_paths(edges, "a", "z").collect()) == every[:50]
    assert sorted(r.path for r in NE.shortest_paths(edges, "a", "z", None).collect()) == every


def test_communities_end_stable(spark):
    e = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "abc" for i in range(6) for j in range(i)] + [("a0", "b0", 1.0), ("b1", "c1", 1.0)]
    r = NE.communities(spark.createDataFrame(e, "src string, dst string, weight double"), min_size=1).collect()
    lab = {x.node: x.label for x in r}
    assert len(lab) == 18 and all(len({lab[f"{g}{i}"] for i in range(6)}) == 1 for g in "abc") and len(set(lab.values())) == 3
    path = [(f"n{i:03d}", f"n{i + 1:03d}", 1.0) for i in range(60)]
    assert NE.communities(spark.createDataFrame(path, "src string, dst string, weight double"), min_size=1).count() == 61


def test_rank_prefixes_only_at_the_start(spark):
    d = MP.parse_taxa(spark.createDataFrame([("f", "k__Bacteria;p_Firmicutes;Clostridium_m;NA")], "feature string, lineage string"))
    assert [r.taxon for r in d.collect()][:4] == ["Bacteria", "Firmicutes", "Clostridium_m", "Not_Assigned"] or {r.taxon for r in d.collect()} >= {"Bacteria", "Firmicutes", "Clostridium_m"}


def test_moderated_statistics(spark):
    """Prior degrees of freedom and variance by the moments of log variances, then t, against plain numpy."""
    from math import lgamma, log
    psi = lambda x, h=1e-4: (lgamma(x + h) - lgamma(x - h)) / (2 * h)
    tri = lambda x, h=1e-3: (lgamma(x + h) - 2 * lgamma(x) + lgamma(x - h)) / h ** 2
    rng = np.random.default_rng(11)
    n, k = 400, 10
    sd = np.sqrt(2.0 / rng.chisquare(6, n) * 6)
    x = rng.normal(size=(n, k)) * sd[:, None] + np.r_[np.zeros(k // 2), np.ones(k // 2)]
    m = long(spark, [(f"f{i}", f"s{j}", float(x[i, j])) for i in range(n) for j in range(k)])
    meta = spark.createDataFrame([(f"s{j}", "a" if j < k // 2 else "b") for j in range(k)], "sample string, g string")
    got = {r.feature: r for r in DI.lm_test(m, meta, "g", ref="a").collect()}
    a, b = x[:, :k // 2], x[:, k // 2:]
    df = k - 2
    s2 = (a.var(1, ddof=1) * 4 + b.var(1, ddof=1) * 4) / df
    e = np.log(s2) - psi(df / 2) + log(df / 2)
    want, lo, hi = e.var(ddof=1) - tri(df / 2), 1e-3, 1e3
    for _ in range(200):
        mid = (lo * hi) ** 0.5
        lo, hi = (mid, hi) if tri(mid) > want else (lo, mid)
    d0 = 2 * lo
    s0 = np.exp(e.mean() + psi(d0 / 2) - log(d0 / 2))
    post = (d0 * s0 + df * s2) / (d0 + df)
    t = (b.mean(1) - a.mean(1)) / np.sqrt(post * 2 / (k // 2))
    for i in range(n):
        r = got[f"f{i}"]
        assert abs(r.stat) == pytest.approx(abs(t[i]), rel=2e-3, abs=1e-4) and r.df_total == pytest.approx(df + d0, rel=1e-2)
        assert r.f_stat == pytest.approx(r.stat ** 2, rel=1e-6) and r.f_pval == pytest.approx(r.pval, abs=1e-8)
