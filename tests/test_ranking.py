"""Exact ranks and quantiles on groups with a hot value and a hot group, against pandas."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lamella.functions.ranking import bh, quantiles, row_numbers, value_ranks


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    n = 24000
    g = np.where(np.arange(n) < 16000, "hot", np.where(np.arange(n) < 16500, "b", "c"))
    v = rng.normal(size=n).round(3)
    v[rng.random(n) < 1 / 3] = 0.0
    pdf = pd.DataFrame({"g": g, "v": v, "id": [f"f{i}" for i in range(n)]})
    return pdf, spark.createDataFrame(pdf).repartition(7)


def test_quantiles_match_type_7(frame):
    pdf, df = frame
    probs = {"a": 0.0, "b": 0.013, "c": 0.25, "d": 0.5, "e": 0.913, "f": 1.0}
    got = quantiles(df, ["g"], "v", probs).toPandas().set_index("g").sort_index()
    for name, p in probs.items():
        want = pdf.groupby("g")["v"].quantile(p).sort_index()
        np.testing.assert_allclose(got[name].to_numpy(float), want.to_numpy(), atol=1e-12)


def test_row_numbers_are_a_permutation_in_order(frame):
    pdf, df = frame
    got = row_numbers(df, ["g"], "v", "id", descending=True).toPandas()
    assert len(got) == len(pdf)
    for _, x in got.groupby("g"):
        x = x.sort_values("rn")
        assert (x["rn"].to_numpy() == np.arange(1, len(x) + 1)).all()
        assert (np.diff(x["v"].to_numpy()) <= 0).all()


def test_row_numbers_do_not_depend_on_partitioning(frame):
    _, df = frame
    a = row_numbers(df, ["g"], "v", "id").toPandas().set_index("id")["rn"].sort_index()
    b = row_numbers(df.repartition(3), ["g"], "v", "id", buckets=5).toPandas().set_index("id")["rn"].sort_index()
    assert (a == b).all()


def test_value_ranks(frame):
    pdf, df = frame
    got = df.join(value_ranks(df, ["g"], "v"), ["g", "v"]).select("id", "avg_rank").toPandas().set_index("id")["avg_rank"].sort_index()
    want = pdf.assign(r=pdf.groupby("g")["v"].rank()).set_index("id")["r"].sort_index()
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy())


def test_bh(frame):
    pdf, df = frame
    got = bh(df.withColumn("p", F.least(F.abs("v"), F.lit(1.0))), "p", ["g"]).toPandas()
    for _, x in got.groupby("g"):
        x = x.sort_values("p").reset_index(drop=True)
        n = len(x)
        q = np.minimum.accumulate((x["p"] * n / (np.arange(n) + 1))[::-1])[::-1].clip(upper=1)
        np.testing.assert_allclose(x["padj"], q, atol=1e-12)
