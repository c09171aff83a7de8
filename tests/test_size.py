"""Tables beyond what a sample matrix, a header or one task may hold; limits are lowered so that few rows reach them."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lamella import core
from lamella.operators import biomarker as BI


def long(spark, x, layer="a", first=0):
    """Features x samples to the long table; NaN cells are absent."""
    rows = [(layer, f"f{i}", f"s{j + first:03d}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if not np.isnan(v)]
    return spark.createDataFrame(rows, "layer string, feature string, sample string, value double")


def test_forest_is_grown_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 3))
    d = spark.createDataFrame([(f"s{i}", float(r[0] > 0), r.tolist()) for i, r in enumerate(x)], "sample string, label double, x array<double>")
    d = d.select("sample", "label", BI.array_to_vector("x").alias("features"))
    grown, real = [], BI.RandomForestClassifier
    monkeypatch.setattr(BI, "RandomForestClassifier", lambda numTrees, **kw: grown.append(numTrees) or real(numTrees=numTrees, **kw))
    monkeypatch.setattr(BI, "FOREST_ROWS", 80 * 2)
    out = BI._forest(d.limit(80), d, 1, trees=5, depth=4).collect()
    assert grown == [2, 2, 1] and len(out) == 120
    assert all(0 <= r["prob"] <= 1 for r in out) and np.mean([(r["prob"] > 0.5) == (r["label"] == 1) for r in out]) > 0.8

def test_layer_of_more_columns_than_a_frame_may_have(spark, tmp_path, monkeypatch):
    from lamella.plans import catalog_models as CM
    from lamella.sources import tables as TB
    x = np.arange(24.0).reshape(4, 6)
    x[1, 2] = x[3, 5] = np.nan
    m = long(spark, x).unionByName(spark.createDataFrame([("a", 'odd, "one"', "s001", 2.5), ("a", "back\\slash", "s003", -1.0)], "layer string, feature string, sample string, value double"))
    ids = m.select("sample").distinct()
    meta = spark.createDataFrame([("x", "#CLASS_region", "s001", "east"), ("x", "#CLASS_region", "s004", "NA"), ("x", "Label", "s002", "l")], "layer string, feature string, sample string, value string")

    def results(folder):
        out = []
        for turned in (False, True):
            w = CM._wide(m, "sample", "feature") if turned else CM._wide(m)
            p = f"{tmp_path}/{folder}{turned}"
            TB.write_wide(w, p) if isinstance(w, TB.Wide) else w.write.csv(p, header=True)
            out.append(TB.read_layer(spark, p, "a", ids))
        out.append(TB.split_embedded_meta(CM._wide(m.withColumn("value", F.col("value").cast("string")).unionByName(meta)))[1])
        return [sorted(map(tuple, r.collect()), key=str) for r in out]

    narrow = results("n")
    monkeypatch.setattr(TB, "MAX_COLUMNS", 3)
    assert isinstance(CM._wide(m), TB.Wide) and results("w") == narrow


def test_runs_hold_a_row_for_each_sample(spark):
    x = np.random.default_rng(1).normal(size=(4, 30))
    x[2, 5] = x[0, 7] = np.nan
    x[:, 11] = np.nan
    m = long(spark, x).unionByName(spark.createDataFrame([("a", "f1", "s011", None)], "layer string, feature string, sample string, value double"))
    y = spark.createDataFrame([(f"s{j:03d}", "hi" if j % 2 else "lo") for j in range(30)], "sample string, label string")
    sp = BI.mc_splits(y, runs=2)
    own = spark.createDataFrame([(1, 2, "a", "f1", 0), (1, 2, "a", "f2", 1), (2, 1, "a", "f0", 0)], "run int, size int, layer string, feature string, _i int")
    rows = BI.run_rows(m, sp, own, "lo").collect()
    at = {(r["run"], r["sample"]): r for r in rows}
    assert len(rows) == len(at) == 30 + 28  # f0 has no cell of two samples
    for (run, s), r in at.items():
        j = int(s[1:])
        assert np.nan_to_num(r["x"]).tolist() == np.nan_to_num(x[[1, 2] if run == 1 else [0], j]).tolist() and r["one"] == (j % 2 == 0)
    bare = spark.createDataFrame([("a", None, f"s{j:03d}", 1.0 * j) for j in range(30)], m.schema)
    pred, imp = BI.mccv(m.unionByName(bare), y, [2, 5], 2)
    assert imp.where("feature is null").isEmpty()
    assert imp.groupBy("size").count().orderBy("size").collect() == [(2, n2 := imp.where('size = 2').count()), (5, 8)] and 2 <= n2 <= 4 and pred.count() > 0
    with pytest.raises(Exception, match="cell twice"):
        BI.mccv(m.unionByName(m), y, [2], 1)


def test_sums_over_parts_of_a_matrix():
    from lamella.operators import logistic
    rng = np.random.default_rng(2)
    x, y, fold, beta = rng.normal(size=(50, 3)), rng.integers(0, 2, 50).astype(float), np.arange(50) % 5, rng.normal(size=(6, 7, 4))
    for fn, arg in ((logistic.batch_sums, beta), (logistic.batch_errors, beta), (logistic.batch_moments, 6)):
        one, parts = logistic.over_arrays(x, y, fold)(fn, arg), logistic.over_arrays(x, y, fold, rows=16)(fn, arg)
        assert all(np.allclose(one[k], parts[k]) for k in one)


def three_groups(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4, 60)) + 8 * np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 0]])[:, np.arange(60) % 3]
    x[1, 4] = x[2, 9] = np.nan
    return long(spark, x).unionByName(long(spark, x[:2] ** 2, "b"))


def test_affinity_of_many_samples(spark, monkeypatch):
    from lamella.operators import clustering as CL
    m = three_groups(spark)
    few = {tuple(r)[:3]: r["weight"] for r in CL.affinity(m, 5).collect()}
    dist = {tuple(r)[:3]: r["dist"] for r in CL.distance_table(m).collect()}
    monkeypatch.setattr(core, "MAX_SAMPLES", 20)
    many = {tuple(r)[:3]: r["weight"] for r in CL.affinity(m, 5).collect()}
    assert few.keys() == many.keys() and np.allclose([few[k] for k in few], [many[k] for k in few])
    assert {tuple(r)[:3]: round(r["dist"], 6) for r in CL.distance_table(m).collect()} == {k: round(v, 6) for k, v in dist.items()}


def test_clusters_of_many_samples(spark, monkeypatch):
    from lamella.operators import clustering as CL
    m = three_groups(spark)
    scores = m.where("layer = 'a'").select("sample", F.substring("feature", 2, 1).cast("int").alias("factor"), "value")
    meta = m.select("sample").distinct().select("sample", F.when(F.col("sample") < "s054", "g").when(F.col("sample") < "s058", "few").alias("grp"))
    sets = lambda d: {frozenset(r["s"]) for r in d.groupBy("cluster").agg(F.collect_list("sample").alias("s")).collect()}
    few, k = CL.auto_k(m)
    few = sorted(map(tuple, few.collect()))
    monkeypatch.setattr(core, "MAX_SAMPLES", 20)
    many, k2 = CL.auto_k(m)
    assert k == k2 == 3 and sorted(map(tuple, many.collect())) == few
    cut = sets(CL.bisecting(m, 3))  # a top-down split may leave a few samples on the wrong side
    assert len(cut) == 3 and sum(map(len, cut)) == 60 and sum(max(sum(int(s[1:]) % 3 == g for s in own) for g in range(3)) for own in cut) >= 55
    by = CL.cluster_by(scores, meta, "grp").collect()
    assert len(by) == 58 and {r["cluster"] for r in by if r["group"] == "few"} == {None}
    assert all(r["cluster"] == int(r["sample"][1:]) % 3 + 1 for r in by if r["group"] == "g")
    assert CL.cluster_chosen(scores, meta.where("sample < 's030'")).count() == 30


def test_rollup_tasks_get_a_bounded_number_of_cells(spark, monkeypatch, capsys):
    import collections

    from lamella.operators import mapping as MP
    rows = [("p", f"f{i % 13}" if i % 29 else None, f"s{i % 7}", float(i)) for i in range(91)]  # cells may repeat
    taxa = MP.parse_taxa(spark.createDataFrame([(f"f{i}", f"k__K{i % 2};p__P{i % 5};{'c__C' if i % 3 else ''}") for i in range(12)], "feature string, lineage string"))
    want = collections.Counter()
    for _, f, s, v in rows:
        if f not in (None, "f12"):
            i = int(f[1:])
            for key in (("Kingdom", f"K{i % 2}", s), ("Phylum", f"P{i % 5}", s), ("Class", "C" if i % 3 else "Not_Assigned", s)):
                want[key] += v
    monkeypatch.setattr(MP, "CELLS_PER_TASK", 5)
    out = MP.rollup_taxa(spark.createDataFrame(rows, "layer string, feature string, sample string, value double"), taxa)
    assert {(r["rank"], r["feature"], r["sample"]): r["value"] for r in out.collect()} == dict(want)
    out.explain()
    plan = capsys.readouterr().out
    assert "REPARTITION_BY_NUM" in plan and "SortMergeJoin [feature" in plan  # 91 cells, 19 tasks; no table of taxa for every task
