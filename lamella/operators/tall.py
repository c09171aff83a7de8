"""Many samples, few features: a sample is one short row, and what is summed over samples is a matrix of features.

The operators take this way when a table has more than ``core.MAX_SAMPLES`` samples.  No list of samples and no sample
matrix is ever made: tasks add up products of features, and what a sample gets is a linear map of its own row.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lamella import core
from lamella.core import FEATURE, bounded, checkpointed
from lamella.functions.ranking import row_numbers
from lamella.operators.blocks import BLOCK, fold_rows

#: Features whose products a task can hold.
MAX_FEATURES = 2000
#: Cells of one dense matrix inside a task.
CELLS = 1 << 20
#: Samples of one block when all pairs of samples are looked at.
BLOCK_ROWS = 8192


def many_samples(m: DataFrame) -> bool:
    """More samples than a sample matrix may have."""
    return m.select("sample").distinct().limit(core.MAX_SAMPLES + 1).count() > core.MAX_SAMPLES


@dataclass
class Rows:
    """Features in order with mean and standard deviation, and ``sample, i, x``: place and centred value of each cell a sample has."""
    keys: list[tuple[str, str]]
    mean: np.ndarray
    sd: np.ndarray
    n: np.ndarray
    rows: DataFrame

    def layers(self) -> dict[str, np.ndarray]:
        """Places of the features of each layer."""
        return {lay: np.array([j for j, k in enumerate(self.keys) if k[0] == lay]) for lay in sorted({k[0] for k in self.keys})}

    def unit(self) -> np.ndarray:
        return np.where(self.sd > 0, self.sd, 1.0)


def sample_rows(m: DataFrame) -> Rows:
    """The cells of each sample as one row; features without a value are left out, more than ``MAX_FEATURES`` are refused."""
    c = m.where(F.col("value").isNotNull() & ~F.isnan("value") & F.col("sample").isNotNull() & F.col("layer").isNotNull() & F.col("feature").isNotNull())
    stats = sorted(tuple(r) for r in bounded(c.groupBy(*FEATURE).agg(F.avg("value"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)), F.count("*")),
                                             MAX_FEATURES, f"features of a table of more than {core.MAX_SAMPLES} samples"))
    place = m.sparkSession.createDataFrame([(r[0], r[1], j, r[2]) for j, r in enumerate(stats)], "layer string, feature string, _i int, _m double")
    c = c.join(F.broadcast(place), FEATURE).groupBy("sample").agg(F.collect_list(F.struct("_i", (F.col("value") - F.col("_m")).alias("_x"))).alias("_c"))
    col = lambda k: np.array([r[k] for r in stats], float)
    return Rows([(r[0], r[1]) for r in stats], col(2), col(3), col(4), checkpointed(c.select("sample", F.col("_c._i").alias("i"), F.col("_c._x").alias("x"))))


def matrices(pdf: pd.DataFrame, p: int):
    """``part, x``: samples x features pieces of a batch of rows, NaN where a sample has no cell."""
    step = max(1, CELLS // max(p, 1))
    for a in range(0, len(pdf), step):
        part = pdf.iloc[a:a + step]
        x = np.full((len(part), p), np.nan)
        x[np.repeat(np.arange(len(part)), part["i"].str.len()), np.concatenate(part["i"].to_numpy())] = np.concatenate(part["x"].to_numpy())
        yield part, x


def products(t: Rows, by: str | None = None, pairwise: bool = False) -> dict[str, np.ndarray]:
    """``xy``: sums over samples of products of the centred features, missing cells at the mean; with ``pairwise`` also, of each pair's
    common samples, ``n``, ``sx`` and ``sxx`` of the first feature.  ``by`` names a column of the rows whose value goes before the name."""
    p = len(t.keys)

    def fn(pdf):
        out: dict[str, np.ndarray] = {}
        for g, own in (pdf.groupby(by, sort=False) if by else [("", pdf)]):
            for _, x in matrices(own, p):
                x0 = np.nan_to_num(x)
                add = {"xy": x0.T @ x0}
                if pairwise:
                    f = (~np.isnan(x)).astype(float)
                    add |= {"n": f.T @ f, "sx": x0.T @ f, "sxx": (x0 ** 2).T @ f}
                for k, v in add.items():
                    k = f"{g}:{k}" if by else k
                    out[k] = out[k] + v if k in out else v
        return out

    out = fold_rows(t.rows, fn)
    return out if by or out else {k: np.zeros((p, p)) for k in ("xy", "n", "sx", "sxx")}


def numbered(m: DataFrame) -> DataFrame:
    """``sample, _n``: the samples numbered from 0."""
    d = m.where(F.col("sample").isNotNull()).select("sample").distinct()
    d = d.select("sample", F.lit(0).alias("_all"), F.pmod(F.xxhash64("sample"), F.lit(1 << 50)).cast("double").alias("_v0"))
    return row_numbers(d, ["_all"], "_v0", "sample").select("sample", (F.col("rn") - 1).alias("_n"))


def block(n: int) -> int:
    """Features whose vectors over ``n`` samples a block task may hold."""
    return max(1, min(BLOCK, 2 * CELLS // max(n, 1)))


def feature_vectors(m: DataFrame, numbers: DataFrame, n: int) -> DataFrame:
    """``layer, feature, vec``: as ``core.vectors``, over the ``n`` samples as numbered; a task holds one feature at a time."""
    def one(key, pdf):
        v = np.full(n, np.nan)
        v[pdf["_n"].to_numpy()] = pdf["value"].to_numpy()
        return pd.DataFrame({"layer": [key[0]], "feature": [key[1]], "vec": [v]})

    d = m.join(numbers, "sample").select(*FEATURE, "_n", F.coalesce("value", F.lit(float("nan"))).alias("value"))
    d = d.groupBy(*FEATURE).applyInPandas(one, "layer string, feature string, vec array<double>")
    return d.select(*FEATURE, F.transform("vec", lambda x: F.coalesce(x, F.lit(float("nan")))).alias("vec"))  # NaN comes back from a task as null


def numbering(m: DataFrame) -> tuple[DataFrame, int]:
    """:func:`numbered`, written once, and how many samples there are."""
    d = checkpointed(numbered(m))
    return d, d.count()


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Places of ``x`` in the permutation of 0 to n - 1 named by ``key``: Feistel rounds, walked until they stay below n."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = np.random.default_rng([key >> 32 & 0xFFFFFFFF, key & 0xFFFFFFFF]).integers(0, 1 << 63, 8).astype(np.uint64)
    y = np.asarray(x).astype(np.uint64)
    todo = np.arange(len(y))
    while len(todo):
        l, r = y[todo] >> half, y[todo] & mask
        for k in keys:
            h = (r ^ k) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            l, r = r, l ^ (h >> np.uint64(32) & mask)
        y[todo] = l << half | r
        todo = todo[y[todo] >= n]
    return y.astype(np.int64)


def permutation_key(j: int, seed: int) -> int:
    return seed << 32 | j


def permuted_rows(rows: DataFrame, n: int, some: range, seed: int) -> DataFrame:
    """The rows once for each permutation ``_j`` of ``some``, with their place ``_at``; permutation 0 leaves them where they are."""
    some = list(some)

    def places(no: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({f"_{j}": permuted(no.to_numpy(), n, permutation_key(j, seed)) if j else no for j in some})

    place = F.pandas_udf(places, ", ".join(f"_{j} long" for j in some))
    d = rows.withColumn("_p", place("_n"))
    return d.select("i", "x", F.explode(F.array(*[F.struct(F.lit(j).alias("_j"), F.col(f"_p._{j}").alias("_at")) for j in some])).alias("_e")).select("i", "x", "_e._j", "_e._at")


def mapped(t: Rows, basis: np.ndarray) -> DataFrame:
    """``sample, row``: each sample's centred cells times ``basis`` (features x columns)."""
    p = len(t.keys)

    def run(it):
        for pdf in it:
            for part, x in matrices(pdf, p):
                yield pd.DataFrame({"sample": part["sample"], "row": list(np.nan_to_num(x) @ basis)})

    return t.rows.mapInPandas(run, "sample string, row array<double>")


def signs(rows: DataFrame, k: int) -> np.ndarray:
    """1 or -1 for each column: the sign of its entry of largest magnitude."""
    at = [F.max_by(F.signum(F.col("row")[j]), F.struct(F.abs(F.col("row")[j]), F.col("sample"))).alias(f"_{j}") for j in range(k)]
    return np.array([-1.0 if v == -1.0 else 1.0 for v in rows.agg(*at).first()])


def long_scores(rows: DataFrame, everyone: DataFrame, k: int, start: int = 0) -> DataFrame:
    """``sample, factor, value`` of columns ``start`` to ``start + k``; 0 for those of ``everyone`` (``sample``) who have no cell."""
    d = everyone.join(rows, "sample", "left").withColumn("row", F.coalesce("row", F.array_repeat(F.lit(0.0), start + k)))
    return d.select("sample", F.posexplode(F.slice("row", start + 1, k)).alias("_j", "value")).select("sample", (F.col("_j") + 1).alias("factor"), "value")


def axes(c: np.ndarray, k: int, tol: float = 1e-13) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues and vectors, padded with zeros up to ``k``; eigenvalues below ``tol`` of the largest are 0."""
    if not len(c):
        return np.zeros(k), np.zeros((0, k))
    w, v = np.linalg.eigh(c)
    w, v = w[::-1][:k], v[:, ::-1][:, :k]
    ok = w > tol * max(w[0], 0)
    w, v = np.where(ok, w, 0.0), v * ok
    return np.pad(w, (0, k - len(w))), np.pad(v, ((0, 0), (0, k - v.shape[1])))


def feature_table(spark, keys: list[tuple[str, str]], w: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(*f, j + 1, float(w[i, j])) for i, f in enumerate(keys) for j in range(w.shape[1])], "layer string, feature string, factor int, value double")


def coordinates(c: np.ndarray, tol: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """``a, back`` for products ``c`` of columns z over samples: z = q a and q = z back, where the columns of q are orthonormal.

    Whatever uses only inner products over samples gives the same with columns of ``a`` in place of sample vectors.
    """
    w, u = np.linalg.eigh(c)
    keep = w > tol * max(w[-1], 0)
    root = np.sqrt(w[keep])
    return root[:, None] * u[:, keep].T, u[:, keep] / root
