"""Scores by projection, overall F and clusters of chosen samples against numpy."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.operators import clustering as CL, differential as DI, reduction as RE
from lamella.plans import fixtures as X

LONG = "layer string, feature string, sample string, value double"


def test_projection_with_gaps(spark):
    rng = np.random.default_rng(3)
    x, w = rng.normal(size=(6, 5)), rng.normal(size=(6, 2))
    gaps = {(0, 1), (3, 1), (5, 4)}
    cells = [("l", f"f{i}", f"s{j}", None if (i, j) in gaps else float(x[i, j])) for i in range(6) for j in range(5)]
    load = [("l", f"f{i}", k + 1, float(w[i, k])) for i in range(6) for k in range(2)] + [("l", "other", 1, 1.0), ("l", "f0", 3, 0.0)]
    got = {(r["sample"], r["factor"]): r["value"] for r in RE.project(spark.createDataFrame(cells, LONG), spark.createDataFrame(load, "layer string, feature string, factor int, value double")).collect()}
    for i, j in gaps:
        x[i, j] = np.nan
    y = x - np.nanmean(x, axis=1, keepdims=True)
    want = {(f"s{j}", k + 1): np.nansum(y[:, j] * w[:, k]) / (w[~np.isnan(y[:, j]), k] ** 2).sum() for j in range(5) for k in range(2)}
    assert got.keys() == want.keys()  # factor 3 has no loading but 0
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-12)


def test_projection_of_nothing(spark):
    empty = spark.createDataFrame([], LONG)
    assert RE.project(empty, spark.createDataFrame([], "layer string, feature string, factor int, value double")).count() == 0


def test_overall_f_is_one_row_per_feature(spark, sf):
    m, meta = X.log_a(spark, sf), X.samples(spark, sf)
    r = DI.overall_f(m, meta, "region").toPandas()
    assert len(r) == m.select("feature").distinct().count() and r["feature"].is_unique
    p = r["f_pval"].to_numpy()
    o = np.argsort(p)
    q = np.minimum.accumulate((p[o] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    np.testing.assert_allclose(r["f_padj"].to_numpy()[o], np.minimum(q, 1), rtol=1e-9)


def test_small_groups_are_marked(spark):
    rng = np.random.default_rng(5)
    sc = [(f"s{i:02d}", k + 1, float(rng.normal() + 8 * (i % 2))) for i in range(20) for k in range(2)]
    scores = spark.createDataFrame(sc, "sample string, factor int, value double")
    meta = spark.createDataFrame([(f"s{i:02d}", "big" if i < 16 else ("tiny" if i < 19 else None)) for i in range(20)], "sample string, g string")
    r = {x["sample"]: (x["group"], x["cluster"]) for x in CL.cluster_by(scores, meta, "g").collect()}
    assert len(r) == 19 and all(r[f"s{i}"] == ("tiny", None) for i in (16, 17, 18))
    assert len({r[f"s{i:02d}"][1] for i in range(0, 16, 2)}) == 1 and r["s00"][1] != r["s01"][1]
    few = CL.cluster_chosen(scores, meta.where("g = 'big'").unionByName(meta.where("g = 'big'")))
    assert few.count() == 16 and few.where(F.col("cluster").isNull()).count() == 0
    assert [x["cluster"] for x in CL.cluster_chosen(scores, meta.where("g = 'tiny'")).collect()] == [None] * 3
