"""All-pairs association and its selections (inventory section I).

Pairs are computed inside block tasks (see :mod:`lamella.operators.blocks`) and
thresholded there; only the rows asked for leave a task.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from lamella.core import FEATURE, bounded, keep_features, sample_ids, vectors
from lamella.functions.ranking import row_numbers, value_ranks
from lamella.functions.special import corr_pvalue, digamma, normal_two_sided, t_pvalue
from lamella.operators import tall
from lamella.operators.blocks import BLOCK, pair_blocks

PAIR = "layer1 string, feature1 string, layer2 string, feature2 string"
PAIR_KEYS = ["layer1", "feature1", "layer2", "feature2"]
MAX_DENSE = 2000


def avg_ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks per row; NaN stays NaN."""
    return pd.DataFrame(x).rank(axis=1).to_numpy()


def _pearson(x, y):
    mx, my = ~np.isnan(x), ~np.isnan(y)
    if mx.all() and my.all():
        zx, zy = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            zx, zy = zx / np.sqrt((zx ** 2).sum(1, keepdims=True)), zy / np.sqrt((zy ** 2).sum(1, keepdims=True))
        return zx @ zy.T, np.full((len(x), len(y)), x.shape[1])
    # centre on the row means first: the pairwise sums then lose little precision
    fx, fy = mx.astype(float), my.astype(float)
    x0 = np.where(mx, x - np.nanmean(x, 1, keepdims=True), 0)
    y0 = np.where(my, y - np.nanmean(y, 1, keepdims=True), 0)
    n = fx @ fy.T
    with np.errstate(divide="ignore", invalid="ignore"):
        sx, sy = x0 @ fy.T, fx @ y0.T
        cov = x0 @ y0.T - sx * sy / n
        vx, vy = (x0 ** 2) @ fy.T - sx ** 2 / n, fx @ (y0 ** 2).T - sy ** 2 / n
        return cov / np.sqrt(vx * vy), n


def _spearman(x, y):
    if not (np.isnan(x).any() or np.isnan(y).any()):
        return _pearson(avg_ranks(x), avg_ranks(y))
    r, n = np.empty((len(x), len(y))), np.empty((len(x), len(y)))
    for i in range(len(x)):
        ok = ~np.isnan(x[i]) & ~np.isnan(y)
        xr, yr = avg_ranks(np.where(ok, x[i], np.nan)), avg_ranks(np.where(ok, y, np.nan))
        n[i] = ok.sum(1)
        xc, yc = xr - np.nanmean(xr, 1, keepdims=True), yr - np.nanmean(yr, 1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            r[i] = np.nansum(xc * yc, 1) / np.sqrt(np.nansum(xc ** 2, 1) * np.nansum(yc ** 2, 1))
    return r, n


def _kendall(x, y):
    """tau-b: one matrix product per sample over the signs of the differences to it."""
    num, d1, d2 = (np.zeros((len(x), len(y))) for _ in range(3))
    mx, my = ~np.isnan(x), ~np.isnan(y)
    for i in range(x.shape[1]):
        sx, sy = np.nan_to_num(np.sign(x - x[:, [i]])), np.nan_to_num(np.sign(y - y[:, [i]]))
        num += sx @ sy.T
        d1 += np.abs(sx) @ (my & my[:, [i]]).T.astype(float)
        d2 += (mx & mx[:, [i]]).astype(float) @ np.abs(sy).T
    with np.errstate(divide="ignore", invalid="ignore"):
        return num / np.sqrt(d1 * d2), mx.astype(float) @ my.T.astype(float)


def _inversions(a: np.ndarray) -> int:
    """Pairs of whole numbers from 0 whose first is the larger: bit after bit, ones before zeros among numbers that agree so far."""
    out = 0
    for b in range(int(a.max(initial=0)).bit_length() - 1, -1, -1):
        bit, group = a >> b & 1, a >> b + 1
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        ones = np.cumsum(bit)
        before = np.repeat((ones - bit)[start], np.diff(np.r_[start, len(a)]))
        out += int((ones - before)[bit == 0].sum())
        a = a[np.argsort(a >> b, kind="stable")]
    return out


def _tau(x: np.ndarray, y: np.ndarray) -> tuple[float, int]:
    """tau-b of two vectors and their common samples, by sorting."""
    ok = ~(np.isnan(x) | np.isnan(y))
    x, y = x[ok], y[ok]
    n = len(x)
    if n < 2:
        return np.nan, n
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    pairs = lambda new: (lambda c: int((c * (c - 1) // 2).sum()))(np.diff(np.r_[np.flatnonzero(np.r_[True, new]), n]))
    nx, ny = x[1:] != x[:-1], y[1:] != y[:-1]
    tx, both, z = pairs(nx), pairs(nx | ny), np.sort(y)
    ty, every = pairs(z[1:] != z[:-1]), n * (n - 1) // 2
    num = every - tx - ty + both - 2 * _inversions(np.unique(y, return_inverse=True)[1].ravel())
    return (num / np.sqrt(float(every - tx) * float(every - ty)) if tx < every and ty < every else np.nan), n


def _kendall_long(x, y, own):
    """The same for vectors of many samples; pairs that are not ``own`` are left out."""
    r, n = np.full(own.shape, np.nan), np.zeros(own.shape)
    for i, j in zip(*np.nonzero(own)):
        r[i, j], n[i, j] = _tau(x[i], y[j])
    return r, n


METHODS = {"pearson": _pearson, "spearman": _spearman, "kendall": _kendall}


def _emit(lk, rk, keep, cols):
    a, b = np.nonzero(keep)
    l, r = [lk[i] for i in a], [rk[i] for i in b]
    swap = [p > q for p, q in zip(l, r)]
    l, r = [q if s else p for p, q, s in zip(l, r, swap)], [p if s else q for p, q, s in zip(l, r, swap)]
    out = {"layer1": [k[0] for k in l], "feature1": [k[1] for k in l], "layer2": [k[0] for k in r], "feature2": [k[1] for k in r]}
    out.update({name: v[a, b] for name, v in cols.items()})
    return pd.DataFrame(out)


def _unordered(lk, rk, same):
    """Mask of the pairs a block task owns."""
    m = np.ones((len(lk), len(rk)), bool)
    return np.triu(m, 1) if same else m


def correlate(m: DataFrame, method: str = "pearson", min_abs: float = 0.0, cross_only: bool = False,
              groups: dict[str, list[str]] | None = None) -> DataFrame:
    """r, n and p of every unordered feature pair (pairwise complete), or of each sample group.

    Pairs under ``min_abs`` and, with ``cross_only``, pairs of one layer never leave
    the block task.  Of more than ``MAX_SAMPLES`` samples the sums of pairs are added up
    over samples (Pearson), or blocks hold fewer features (the rank correlations).
    """
    many = tall.many_samples(m)
    if method == "pearson" and many:
        d = _correlate_tall(m, min_abs, cross_only, groups).withColumn("pval", corr_pvalue(F.col("r"), F.col("n")))
        return d if groups else d.drop("group")
    if many:
        numbers, n = tall.numbering(m)
        vecs, block = tall.feature_vectors(m, numbers, n), tall.block(n)
        pos = {r["sample"]: r["_n"] for r in numbers.collect()} if groups else {}
        every = slice(None)
    else:
        order = sample_ids(m)
        vecs, block = vectors(m, order), BLOCK
        pos = {s: i for i, s in enumerate(order)}
        every = list(range(len(order)))
    sets = {g: [pos[s] for s in ids if s in pos] for g, ids in groups.items()} if groups else {"": every}
    stat = METHODS[method]

    def fn(lk, x, rk, y, same):
        own = _unordered(lk, rk, same)
        if cross_only:
            own &= np.array([k[0] for k in lk])[:, None] != np.array([k[0] for k in rk])[None, :]
        parts = []
        for g, ix in sets.items():
            r, n = _kendall_long(x[:, ix], y[:, ix], own) if many and method == "kendall" else stat(x[:, ix], y[:, ix])
            keep = own & ~np.isnan(r) & (np.abs(r) >= min_abs)
            parts.append(_emit(lk, rk, keep, {"r": np.clip(r, -1, 1), "n": n}).assign(group=g))
        return pd.concat(parts)

    d = pair_blocks(vecs, None, fn, PAIR + ", r double, n double, group string", block)
    if method == "kendall":
        n = F.col("n")
        d = d.withColumn("pval", normal_two_sided(F.col("r") / F.sqrt(2 * (2 * n + 5) / (9 * n * (n - 1)))))
    else:
        d = d.withColumn("pval", corr_pvalue(F.col("r"), F.col("n")))
    return d if groups else d.drop("group")


def _correlate_tall(m: DataFrame, min_abs: float, cross_only: bool, groups: dict[str, list[str]] | None) -> DataFrame:
    """``PAIR``, r, n, group from pairwise sums over samples; a task holds the pairs of some first features."""
    spark = m.sparkSession
    t = tall.sample_rows(m)
    if groups:
        of = spark.createDataFrame([(s, g) for g, ids in groups.items() for s in ids], "sample string, group string")
        t.rows = t.rows.join(of, "sample")
    sums = tall.products(t, "group" if groups else None, True)
    shared = spark.sparkContext.broadcast((t.keys, sums, sorted(groups) if groups else [""]))

    def run(it):
        keys, s, names = shared.value
        for pdf in it:
            ix = pdf["id"].to_numpy()
            own = np.arange(len(keys))[None, :] > ix[:, None]
            if cross_only:
                own &= np.array([[k[0] != keys[i][0] for k in keys] for i in ix])
            for g in names:
                if (f"{g}:n" if groups else "n") not in s:
                    continue
                at = lambda k: s[f"{g}:{k}" if groups else k]
                n, xy = at("n")[ix], at("xy")[ix]
                sx, sy, sxx, syy = at("sx")[ix], at("sx").T[ix], at("sxx")[ix], at("sxx").T[ix]
                with np.errstate(divide="ignore", invalid="ignore"):
                    r = (xy - sx * sy / n) / np.sqrt(np.maximum(sxx - sx ** 2 / n, 0) * np.maximum(syy - sy ** 2 / n, 0))
                keep = own & np.isfinite(r) & (np.abs(r) >= min_abs)
                if keep.any():
                    yield _emit([keys[i] for i in ix], keys, keep, {"r": np.clip(r, -1, 1), "n": n}).assign(group=g)

    return spark.range(len(t.keys)).repartition(16).mapInPandas(run, PAIR + ", r double, n double, group string")


def dense(pairs: DataFrame, value: str, limit: int = MAX_DENSE) -> tuple[np.ndarray, list[tuple[str, str]]]:
    """Symmetric matrix of a pair table over at most ``limit`` features (checked)."""
    rows = bounded(pairs.select(*PAIR_KEYS, value), limit * (limit - 1) // 2, "pair table")
    keys = sorted({(r[0], r[1]) for r in rows} | {(r[2], r[3]) for r in rows})
    if len(keys) > limit:
        raise ValueError(f"more than {limit} features; select some first")
    ix = {k: i for i, k in enumerate(keys)}
    a = np.zeros((len(keys), len(keys)))
    for r in rows:
        i, j = ix[(r[0], r[1])], ix[(r[2], r[3])]
        a[i, j] = a[j, i] = r[4]
    return a, keys


def partial_corr(m: DataFrame, method: str = "pearson") -> DataFrame:
    """Correlation of each pair given all other features (at most MAX_DENSE)."""
    r, keys = dense(correlate(m, method), "r")
    np.fill_diagonal(r, 1.0)
    n = len(sample_ids(m))
    prec = np.linalg.inv(r) if np.linalg.cond(r) < 1e12 else np.linalg.pinv(r)
    d = np.sqrt(np.abs(np.diag(prec)))
    pr = -prec / np.outer(d, d)
    g = len(keys) - 2
    rows = [(*keys[i], *keys[j], float(pr[i, j])) for i in range(len(keys)) for j in range(i + 1, len(keys))]
    out = m.sparkSession.createDataFrame(rows, PAIR + ", r double")
    if method == "kendall":
        k = n - g
        return out.withColumn("pval", normal_two_sided(F.col("r") / F.sqrt(F.lit(2 * (2 * k + 5) / (9 * k * (k - 1))))))
    df = n - 2 - g
    return out.withColumn("pval", t_pvalue(F.col("r") * F.sqrt(df / (1 - F.col("r") * F.col("r"))), F.lit(float(df)))
                          if df > 0 else F.lit(None).cast("double"))


def mutual_info(m: DataFrame, k: int = 5) -> DataFrame:
    """Nearest-neighbour mutual information of each pair (nats) over the samples both have, and scaled by the largest.

    NaN for a pair that shares fewer than two samples.
    """
    order = sample_ids(m)
    n = len(order)
    psi = np.array([0.0] + [digamma(i) for i in range(1, n + 2)])

    def one(dx, dy):
        """``dx``, ``dy``: distances of all pairs of samples. A sample with ``k`` others at distance 0 counts those instead."""
        n = len(dx)
        kk = min(k, n - 1)
        if kk < 1:
            return np.nan
        z = np.maximum(dx, dy)
        eps = np.partition(z, kk, axis=1)[:, [kk]]
        tied = eps[:, 0] == 0
        nx, ny = (dx < eps).sum(1), (dy < eps).sum(1)
        at = np.full(n, psi[kk])
        if tied.any():
            at[tied] = psi[(z[tied] == 0).sum(1) - 1]
            nx[tied], ny[tied] = (dx[tied] == 0).sum(1) - 1, (dy[tied] == 0).sum(1) - 1
        return (at - psi[nx] - psi[ny]).mean() + psi[n]

    def fn(lk, x, rk, y, same):
        own = _unordered(lk, rk, same)
        mi = np.zeros(own.shape)
        for i in range(len(x)):
            if own[i].any():
                dx = np.abs(x[i][:, None] - x[i][None, :])
                for j in np.flatnonzero(own[i]):
                    ok = ~(np.isnan(x[i]) | np.isnan(y[j]))
                    v = y[j][ok]
                    own_dx = dx if ok.all() else dx[np.ix_(ok, ok)]
                    mi[i, j] = np.maximum(0.0, one(own_dx, np.abs(v[:, None] - v[None, :])))
        return _emit(lk, rk, own, {"mi": mi})

    from lamella.core import checkpointed
    d = checkpointed(pair_blocks(vectors(m, order), None, fn, PAIR + ", mi double", block=64)).withColumn("_one", F.lit(1))
    return d.join(d.groupBy("_one").agg(F.max(F.nanvl("mi", F.lit(None))).alias("_mx")), "_one").withColumn("scaled", F.col("mi") / F.nullif(F.col("_mx"), F.lit(0.0))) \
        .drop("_one", "_mx")


def _both_ways(pairs: DataFrame, value: str) -> DataFrame:
    a = pairs.select("layer1", "feature1", "layer2", "feature2", value)
    return a.unionByName(pairs.select(F.col("layer2").alias("layer1"), F.col("feature2").alias("feature1"),
                                      F.col("layer1").alias("layer2"), F.col("feature1").alias("feature2"), value))


def infer_network(sim: DataFrame, how: str = "aracne", value: str = "mi", eps: float = 0.0) -> DataFrame:
    """aracne (data-processing inequality), clr (background z) or mrnet over a similarity of at most MAX_DENSE features."""
    if how == "clr":
        s = _both_ways(sim, value).groupBy("layer1", "feature1").agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
        z = lambda side: F.greatest(F.lit(0.0), (F.col(value) - F.col(f"_m{side}")) / F.nullif(F.col(f"_s{side}"), F.lit(0.0)))
        d = sim
        for side in (1, 2):
            d = d.join(s.select(F.col("layer1").alias(f"layer{side}"), F.col("feature1").alias(f"feature{side}"),
                                F.col("_m").alias(f"_m{side}"), F.col("_s").alias(f"_s{side}")), [f"layer{side}", f"feature{side}"])
        return d.select(*PAIR_KEYS, F.sqrt(F.coalesce(z(1) ** 2, F.lit(0.0)) + F.coalesce(z(2) ** 2, F.lit(0.0))).alias("weight"))
    a, keys = dense(sim, value)
    spark = sim.sparkSession
    nodes = spark.createDataFrame([(l, f, i) for i, (l, f) in enumerate(keys)], "layer string, feature string, i int")
    shared = spark.sparkContext.broadcast(a)

    def aracne(it):
        w = shared.value
        for pdf in it:
            for l, f, i in pdf.itertuples(index=False):
                through = np.minimum(w[i][None, :], w)  # row j: min over k of (i,k), (j,k)
                through[:, i] = 0
                np.fill_diagonal(through, 0)
                keep = [j for j in range(i + 1, len(keys)) if w[i, j] > 0 and w[i, j] >= through[j].max() - eps]
                if keep:
                    yield pd.DataFrame({"layer1": l, "feature1": f, "layer2": [keys[j][0] for j in keep],
                                        "feature2": [keys[j][1] for j in keep], "weight": [w[i, j] for j in keep]})

    def mrnet(it):
        w = shared.value
        for pdf in it:
            for l, f, i in pdf.itertuples(index=False):
                left, picked, red, out = [j for j in range(len(keys)) if j != i], [], np.zeros(len(keys)), {}
                while left:
                    score = w[i, left] - (red[left] / len(picked) if picked else 0)
                    b = int(np.argmax(score))
                    if score[b] <= 0:
                        break
                    j = left.pop(b)
                    out[j] = score[b]
                    picked.append(j)
                    red += w[j]
                if out:
                    lo = [(keys[min(i, j)], keys[max(i, j)], s) for j, s in out.items()]
                    yield pd.DataFrame({"layer1": [a[0] for a, _, _ in lo], "feature1": [a[1] for a, _, _ in lo],
                                        "layer2": [b[0] for _, b, _ in lo], "feature2": [b[1] for _, b, _ in lo], "weight": [s for *_, s in lo]})

    d = nodes.repartition(8).mapInPandas(aracne if how == "aracne" else mrnet, PAIR + ", weight double")
    return d if how == "aracne" else d.groupBy(*PAIR_KEYS).agg(F.max("weight").alias("weight"))


# ---- selections ----------------------------------------------------------------------------

def select_features(m: DataFrame, sig: DataFrame | None = None, custom: DataFrame | None = None, by: str = "pval", limit: int | None = None) -> DataFrame:
    """The ``limit`` most significant features per layer (None: all that have a statistic), or a custom list (``feature``)."""
    if custom is not None:
        return m.join(custom.select("feature"), "feature", "left_semi")
    if limit is None:
        return keep_features(m, sig.where(F.col(by).isNotNull()))
    return keep_features(m, row_numbers(sig, ["layer"], by, "feature").where(F.col("rn") <= limit))


def select_by_loading(m: DataFrame, loadings: DataFrame, n: int, c: int) -> DataFrame:
    """Top ``n`` features by absolute loading on each of the first ``c`` factors."""
    l = loadings.where(F.col("factor") <= c).withColumn("_a", F.abs("value"))
    return keep_features(m, row_numbers(l, ["layer", "factor"], "_a", "feature", descending=True).where(F.col("rn") <= n))


def strongest(edges: DataFrame, n: int | None, value: str = "r") -> DataFrame:
    """Edges whose absolute value is among the ``n`` largest distinct ones; all with ``n`` None."""
    if n is None:
        return edges
    a = F.round(F.abs(value), 10)
    d = edges.withColumn("_a", a)
    top = d.select("_a").distinct().orderBy(F.desc("_a")).limit(n).agg(F.min("_a").alias("_cut"))
    return d.withColumn("_one", F.lit(1)).join(top.withColumn("_one", F.lit(1)), "_one").where(F.col("_a") >= F.col("_cut")).drop("_a", "_one", "_cut")


def filter_edges(edges: DataFrame, inter: float, intra: float, sign: str = "both", cross_only: bool = False, keep: int | None = None) -> DataFrame:
    """Thresholds between and within layers, sign, cross-layer only, and the strongest ``keep`` distinct values."""
    r = F.col("r")
    cross = F.col("layer1") != F.col("layer2")
    val = {"both": F.abs(r), "positive": r, "negative": -r}[sign]
    d = edges.where(val > F.when(cross, F.lit(inter)).otherwise(F.lit(intra)))
    if cross_only:
        d = d.where(cross)
    return strongest(d, keep) if keep else d


def need_edges(edges: DataFrame, n: int = 3) -> DataFrame:
    """The edges themselves, or an error when there are fewer than ``n``."""
    ok = edges.agg(F.count("*").alias("_n")).select(F.when(F.col("_n") >= n, F.lit(1)).otherwise(
        F.raise_error(F.lit("too few edges")).cast("int")).alias("_one"))
    return edges.withColumn("_one", F.lit(1)).join(ok, "_one").drop("_one")


def pairs(edges: DataFrame, kind: str = "all") -> DataFrame:
    """Pairs of a class: all, inter or intra."""
    cross = F.col("layer1") != F.col("layer2")
    return {"all": edges, "inter": edges.where(cross), "intra": edges.where(~cross)}[kind]


def network_edges(edges: DataFrame, value: str = "r") -> DataFrame:
    """``src, dst, weight`` with node ids ``layer:feature``."""
    return edges.select(F.concat_ws(":", "layer1", "feature1").alias("src"), F.concat_ws(":", "layer2", "feature2").alias("dst"), F.col(value).alias("weight"))


def sample_groups(meta: DataFrame, var: str, more_than: int = 4) -> dict[str, list[str]]:
    rows = bounded(meta.where(F.col(var).isNotNull()).groupBy(var).agg(F.collect_list("sample").alias("s")).where(F.size("s") > more_than), 1000, var)
    return {str(r[0]): sorted(r[1]) for r in rows}


def diff_correlate(m: DataFrame, meta: DataFrame, var: str, method: str = "pearson", cross_only: bool = False) -> DataFrame:
    """r and p of each pair in every group of more than four samples."""
    return correlate(m, method, cross_only=cross_only, groups=sample_groups(meta, var))


def diff_network(dc: DataFrame, r: float, p: float, n: int) -> DataFrame:
    """Pairs passing in any group; then the top ``n`` of each group by |r|, then p."""
    ok = dc.where((F.abs("r") >= r) & (F.col("pval") <= p)).select(*PAIR_KEYS).distinct()
    order = [F.desc(F.round(F.abs("r"), 10)), "feature1", "feature2", "layer1", "layer2"]
    d = dc.join(ok, PAIR_KEYS, "left_semi").withColumn("_part", F.pmod(F.xxhash64(*PAIR_KEYS), F.lit(64)))
    # the top n of each part of a group hold the group's top n
    d = d.withColumn("rank", F.row_number().over(W.partitionBy("group", "_part").orderBy(*order))).where(F.col("rank") <= n).drop("_part")
    return d.withColumn("rank", F.row_number().over(W.partitionBy("group").orderBy(*order))).where(F.col("rank") <= n)


def chord(edges: DataFrame, t: float, p: float, n: int) -> DataFrame:
    """Strongest cross-layer pairs."""
    return (edges.where((F.col("layer1") != F.col("layer2")) & (F.abs("r") > t) & (F.col("pval") < p))
            .orderBy(F.desc(F.round(F.abs("r"), 10)), *PAIR_KEYS).limit(n))


def cross_block(m: DataFrame, cutoff: float, n: int | None = None) -> DataFrame:
    """Cross-layer pairs of at least ``cutoff``; the ``n`` strongest if asked."""
    d = correlate(m, "pearson", cutoff, cross_only=True)
    if n is not None:
        d = d.orderBy(F.desc(F.round(F.abs("r"), 10)), *PAIR_KEYS).limit(n)
    return d.select(*PAIR_KEYS, F.round("r", 4).alias("r"))


def corr_distribution(edges: DataFrame, t: float, bins: int = 20) -> tuple[DataFrame, DataFrame]:
    """Counts beyond the threshold by sign and class; histogram of r over [-1, 1]."""
    cls = F.when(F.col("layer1") != F.col("layer2"), "inter").otherwise("intra").alias("class")
    a = edges.groupBy(cls).agg(F.count_if(F.col("r") > t).alias("positive"), F.count_if(F.col("r") < -t).alias("negative"), F.count("*").alias("n"))
    b = edges.groupBy(cls, F.least(F.lit(bins), F.floor((F.col("r") + 1) / 2 * bins) + 1).alias("bin")).agg(F.count("*").alias("n"))
    return a, b


def pair_values(m: DataFrame, meta: DataFrame, var: str, f1: tuple[str, str], f2: tuple[str, str]) -> DataFrame:
    pick = lambda f, c: m.where((F.col("layer") == f[0]) & (F.col("feature") == f[1])).select("sample", F.col("value").alias(c))
    return pick(f1, "x").join(pick(f2, "y"), "sample").join(meta.select("sample", F.col(var).alias("group")), "sample")
