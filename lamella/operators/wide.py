"""PCA where samples are too many for a sample matrix: block power iteration over cells.

Samples and features both stay distributed: a block is a table with one row of ``b`` numbers for each sample or feature, a
round is two joins of the cells with a block, and only b x b products of blocks reach the driver.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lamella.core import FEATURE, checkpointed, with_stats
from lamella.operators import tall
from lamella.operators.blocks import fold_rows
from lamella.operators.reduction import Reduction, _pca_tall, _var_df

#: A direction whose length, or share of the block, is below this is taken as rounding; so is an eigenvalue below ``EIGEN_TOL`` of the largest.
RANK_TOL, EIGEN_TOL = 1e-10, 1e-13


def _cells(m: DataFrame, scale: bool, stacked: bool) -> DataFrame:
    """``grp, layer, feature, sample, x``: centred (and scaled) cells; missing ones are absent, which means the row mean."""
    c = m.where(F.col("value").isNotNull() & ~F.isnan("value"))
    c = with_stats(c, FEATURE, F.avg("value").alias("_m"), F.stddev_samp("value").alias("_sd"))
    x = F.col("value") - F.col("_m")
    if scale:
        x = x / F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    return c.select((F.lit("all") if stacked else F.col("layer")).alias("grp"), *FEATURE, "sample", x.alias("x"))


def _product(cells: DataFrame, block: DataFrame, on: list[str], keys: list[str], b: int) -> DataFrame:
    """One row for each of ``keys``: the cells times the block rows found by ``on``, summed (map-side first)."""
    d = cells.join(block, ["grp", *on]).groupBy("grp", *keys).agg(*[F.sum(F.col("x") * F.col("row")[j]).alias(f"_{j}") for j in range(b)])
    return d.select("grp", *keys, F.array(*[f"_{j}" for j in range(b)]).alias("row"))


def _gram(block: DataFrame, by: str = "grp") -> dict[str, np.ndarray]:
    def fn(pdf):
        return {g: (lambda x: x.T @ x)(np.vstack(p["row"].to_numpy())) for g, p in pdf.groupby(by, sort=False)}
    return fold_rows(block.select(by, "row"), fn)


def _turned(block: DataFrame, mats: dict[str, np.ndarray]) -> DataFrame:
    """The block with its rows multiplied by the matrix of their group."""
    def run(it):
        for pdf in it:
            for g, p in pdf.groupby("grp", sort=False):
                yield p.assign(row=list(np.vstack(p["row"].to_numpy()) @ mats[g]))
    return block.mapInPandas(run, block.schema)


def _whiten(s: np.ndarray) -> np.ndarray:
    """Matrix that makes a block with products ``s`` orthonormal; columns of lost directions are 0."""
    d = np.sqrt(np.maximum(np.diag(s), 0))
    inv = np.where(d > RANK_TOL * max(d.max(), 1e-300), 1 / np.where(d > 0, d, 1), 0.0)
    e, u = np.linalg.eigh(s * inv[:, None] * inv)
    return inv[:, None] * u * np.where(e > RANK_TOL, 1 / np.sqrt(np.where(e > RANK_TOL, e, 1)), 0.0)


def _long(block: DataFrame, keys: list[str], k: int) -> DataFrame:
    d = block.select(*keys, F.posexplode(F.slice("row", 1, k)).alias("_j", "value"))
    return d.select(*keys, (F.col("_j") + 1).alias("factor"), "value")


def _signs(u: DataFrame, k: int) -> dict[str, np.ndarray]:
    """The entry of largest magnitude of each column is to be positive."""
    at = [F.max_by(F.signum(F.col("row")[j]), F.struct(F.abs(F.col("row")[j]), F.col("sample"))).alias(f"_{j}") for j in range(k)]
    return {r[0]: np.array([-1.0 if v == -1.0 else 1.0 for v in r[1:]]) for r in u.groupBy("grp").agg(*at).collect()}


def wide_pca(m: DataFrame, k: int = 5, scale: bool = False, stacked: bool = False, extra: int = 15, tol: float = 1e-6,
             rounds: int = 100, seed: int = 1) -> Reduction:
    """PCA of samples in each layer, or of all layers ``stacked``, for any number of samples and features.

    Same tables as ``pca`` and ``combined_pca``.  Block power iteration on k + ``extra`` columns runs until every wanted
    column x has |Gx - ex| <= ``tol`` x the largest eigenvalue e of the implied sample matrix G, which bounds the error of its
    square root by about ``tol`` squared over the gap; ``info`` holds ``converged`` and ``residual`` for each layer.  Missing cells count
    as the feature's mean; a sample without cells in a layer has score 0; factors beyond the rank are 0.  An empty table
    gives empty tables.  Of more than ``MAX_SAMPLES`` samples and at most ``tall.MAX_FEATURES`` features the products of features
    are summed once and solved exactly, without rounds.
    """
    if tall.many_samples(m) and m.select(*FEATURE).distinct().limit(tall.MAX_FEATURES + 1).count() <= tall.MAX_FEATURES:
        r = _pca_tall(m, k, scale, stacked)
        return Reduction(r.scores, r.loadings, r.var_exp, {"converged": {g: True for g in r.info["values"]}, "residual": {g: np.zeros(k) for g in r.info["values"]}, **r.info})
    spark, b = m.sparkSession, k + extra
    cells = checkpointed(_cells(m, scale, stacked))
    by_sample = cells.repartition("grp", "sample").persist()  # rounds shuffle the blocks, not the cells
    by_feature = cells.repartition("grp", *FEATURE).persist()
    total = {r[0]: r[1] for r in cells.groupBy("grp").agg(F.sum(F.col("x") ** 2)).collect()}
    draw = [F.xxhash64(F.lit(seed), F.lit(j), "sample") / F.lit(2.0 ** 63) for j in range(b)]
    z = checkpointed(by_sample.select("grp", "sample").distinct().select("grp", "sample", F.array(*draw).alias("row")))
    s, done, res = _gram(z), {}, {}
    for _ in range(rounds):
        q = _turned(z, {g: _whiten(v) for g, v in s.items()})
        w = checkpointed(_product(by_sample, q, ["sample"], FEATURE, b))
        eig = {g: np.linalg.eigh(t) for g, t in _gram(w).items()}
        val = {g: np.where(e > EIGEN_TOL * max(e[-1], 0), e, 0.0)[::-1] for g, (e, _) in eig.items()}
        vec = {g: v[:, ::-1] for g, (_, v) in eig.items()}
        last, w = z, _turned(w, vec)
        basis = {g: _whiten(s[g]) @ vec[g] for g in vec}
        z = checkpointed(_product(by_feature, w, FEATURE, ["sample"], b))
        s = _gram(z)
        res = {g: np.sqrt(np.maximum(np.diag(s[g])[:k] - val[g][:k] ** 2, 0)) / max(val[g][0], 1e-300) for g in s}
        done = {g: bool((r <= tol).all()) for g, r in res.items()}
        if all(done.values()):
            break
    if not total:
        val, basis, last, w = {}, {}, z, z.select("grp", F.lit("").alias("layer"), F.lit("").alias("feature"), "row")
    u = checkpointed(_turned(last, basis))
    sign = _signs(u, b) if total else {}
    root = {g: np.sqrt(v) for g, v in val.items()}
    everyone = m.select("sample").distinct().withColumn("grp", F.explode(F.array(*[F.lit(g) for g in sorted(total)]).cast("array<string>")))
    own = _turned(u, {g: np.diag(root[g] * sign[g]) for g in root})
    scores = everyone.join(own, ["grp", "sample"], "left").withColumn("row", F.coalesce("row", F.array_repeat(F.lit(0.0), b)))
    scores = checkpointed(_long(scores, ["grp", "sample"], k).withColumnRenamed("grp", "layer"))
    w = checkpointed(w)
    unit = {g: np.diag(sign[g] * np.where(v > 0, 1 / np.where(v > 0, root[g], 1), 0)) for g, v in val.items()}
    load = checkpointed(_long(_turned(w, unit), FEATURE, k))
    ve = [(g, 100 * val[g][:k] / (total[g] or 1.0)) for g in sorted(val)]
    if stacked and total:
        part = cells.groupBy("layer").agg(F.sum(F.col("x") ** 2)).collect()
        own_part = {g: np.diag(t)[:k] for g, t in _gram(w, "layer").items()}
        ve += [(r[0], 100 * own_part[r[0]] / (r[1] or 1.0)) for r in sorted(part)]
    by_sample.unpersist()
    by_feature.unpersist()
    return Reduction(scores.drop("layer") if stacked else scores, load, _var_df(spark, ve), {"converged": done, "residual": res, "values": {g: v[:k] for g, v in val.items()}})
