"""Normalization and scaling (inventory section E).

Sample-wise factors come from mergeable aggregates or exact bracketed quantiles
per (layer, sample); feature-wise ones from the bounded (layer, feature) group.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lamella.core import CELL, FEATURE, SAMPLE, checkpointed, sample_ids, vectors, with_stats
from lamella.functions.ranking import quantile_grid, quantiles, value_ranks
from lamella.operators.blocks import fold_rows
from lamella.operators.impute import _unpack, drop_incomplete, log_qrilc


def _v():
    return F.col("value")


def _pos():
    return F.when(_v() > 0, _v())




def _out(d: DataFrame, value) -> DataFrame:
    return d.select(*CELL, value.alias("value"))


def library_sizes(m: DataFrame) -> DataFrame:
    return m.groupBy(*SAMPLE).agg(F.sum("value").alias("lib"))


def sample_quantile(m: DataFrame, p: float, name: str, value: str = "value") -> DataFrame:
    return quantiles(m, SAMPLE, value, {name: p})


def _sum(m):
    return _out(with_stats(m, SAMPLE, F.sum("value").alias("_s")), 1000 * _v() / F.col("_s"))


def _median(m):
    return _out(m.join(sample_quantile(m, 0.5, "_m"), SAMPLE, "left"), _v() / F.col("_m"))


def _pqn(m):
    ref = m.groupBy(*FEATURE).agg(F.percentile("value", 0.5).alias("_ref"))
    q = m.join(ref, FEATURE).withColumn("_q", F.when((F.col("_ref") > 0) & (_v() > 0), _v() / F.col("_ref")))
    f = sample_quantile(q, 0.5, "_f", "_q")
    return _out(m.join(f, SAMPLE, "left"), _v() / F.coalesce("_f", F.lit(1.0)))


def _log2(m):
    return _out(with_stats(m, ["layer"], (F.min(_pos()) / 10).alias("_c")),
                F.log2(F.when(_v() <= 0, F.col("_c")).otherwise(_v())))


def _glog10(m):
    c = F.min(F.when(_v() != 0, F.abs(_v()))) / 10
    return _out(with_stats(m, ["layer"], c.alias("_c")), F.log10((_v() + F.sqrt(_v() * _v() + F.col("_c") * F.col("_c"))) / 2))


def _cuberoot(m):
    return _out(m, F.signum(_v()) * F.pow(F.abs(_v()), F.lit(1.0 / 3)))


def _each(lo, hi, out: str, size: int = 1 << 16):
    """Rows for ``lo`` .. ``hi``, in pieces, so that no row ever holds a long array."""
    def add(d):
        d = d.withColumn("_from", F.explode(F.when(lo <= hi, F.sequence(lo, hi, F.lit(size)))))
        return d.withColumn(out, F.explode(F.sequence("_from", F.least(F.col("_from") + size - 1, hi)))).drop("_from")
    return add


def _quantile(m):
    """Each value becomes the mean, over samples, of the order statistics at its rank; missing stays missing.

    A sample with gaps has fewer order statistics: they are stretched (linearly) over the ranks of the layer's features, and
    its values are read off the mean curve at the stretched ranks.  Ranks come per distinct value; ties take the mean of the
    curve over the ranks they span.
    """
    m = checkpointed(m)
    r = value_ranks(m, SAMPLE, "value")
    own = m.groupBy(*SAMPLE).agg((F.count("value") - 1).alias("_n1"))
    grid = m.select(*FEATURE).distinct().groupBy("layer").agg((F.count("*") - 1).alias("_g1"))
    r = checkpointed(r.join(own, SAMPLE).join(grid, "layer"))
    n1, g1 = F.col("_n1"), F.col("_g1")
    # grid rank k (from 0) lies at k * n1 / g1 of the sample's own ranks: between floor and the next
    first = lambda j: F.when(n1 == 0, F.when(j <= 0, 0).otherwise(g1 + 1)).otherwise(F.ceil(j * F.greatest(g1, F.lit(1)) / F.greatest(n1, F.lit(1)))).cast("long")
    part = None
    for shift in (0, 1):
        lo = F.greatest(first(F.col("n_less") - shift), F.lit(0))
        hi = F.least(first(F.col("n_leq") - shift) - 1, g1)
        frac = F.pmod(F.col("_k") * n1, F.greatest(g1, F.lit(1))) / F.greatest(g1, F.lit(1))
        d = _each(lo, hi, "_k")(r).select("layer", "_k", (F.col("value") * (frac if shift else 1 - frac)).alias("_x"))
        part = d if part is None else part.unionByName(d)
    count = own.where("_n1 >= 0").groupBy("layer").agg(F.count("*").alias("_samples"))
    curve = checkpointed(part.groupBy("layer", "_k").agg(F.sum("_x").alias("_s")).join(count, "layer").select("layer", "_k", (F.col("_s") / F.col("_samples")).alias("_os")))
    at = _each(F.col("n_less"), F.col("n_leq") - 1, "_j")(r)
    den = F.greatest(n1, F.lit(1))
    at = at.withColumn("_k", F.floor(F.col("_j") * g1 / den)).withColumn("_frac", F.pmod(F.col("_j") * g1, den) / den)
    # a single value stands for its sample's middle
    at = at.withColumn("_k", F.when(n1 == 0, F.floor(g1 / 2)).otherwise(F.col("_k"))).withColumn("_frac", F.when(n1 == 0, (g1 % 2) / 2).otherwise(F.col("_frac")))
    up = curve.select("layer", F.col("_k").alias("_k2"), F.col("_os").alias("_os2"))
    at = at.withColumn("_k2", F.least(F.col("_k") + 1, g1)).join(curve, ["layer", "_k"]).join(up, ["layer", "_k2"])
    target = at.groupBy(*SAMPLE, "value").agg(F.avg(F.col("_os") * (1 - F.col("_frac")) + F.col("_os2") * F.col("_frac")).alias("_t"))
    return _out(m.join(target, [*SAMPLE, "value"], "left"), F.col("_t"))


def _colsum(m):
    return _out(with_stats(m, SAMPLE, F.sum("value").alias("_s")), _v() / F.col("_s") * 1e7)


def _clr(m):
    """Proportions; zeros to half the sample's smallest nonzero proportion; log2 over the geometric mean."""
    d = with_stats(m, SAMPLE, F.sum("value").alias("_s"), F.min(_pos()).alias("_min"))
    d = _out(d, F.when(_v() > 0, _v() / F.col("_s")).otherwise(F.when(_v().isNotNull(), F.col("_min") / F.col("_s") / 2)))
    d = d.withColumn("value", F.log2("value"))
    return _out(with_stats(d, SAMPLE, F.avg("value").alias("_g")), _v() - F.col("_g"))


def norm_factors(m: DataFrame, how: str = "tmm") -> DataFrame:
    """Size factors ``layer, sample, lib, factor`` (product 1 within a layer).

    The result is one row per sample; it is checkpointed, since every cell of the
    layer is scaled by it afterwards.
    """
    d = with_stats(m, FEATURE, F.max("value").alias("_mx")).where(F.col("_mx") > 0).drop("_mx")
    lib = checkpointed(library_sizes(d))
    if how == "uq":
        f = sample_quantile(d.join(lib, SAMPLE).withColumn("_x", _v() / F.col("lib")), 0.75, "_f", "_x")
    elif how == "rle":
        g = d.groupBy(*FEATURE).agg(F.avg(F.log(_pos())).alias("_lg"), F.min("value").alias("_mn"))
        q = d.join(g.where(F.col("_mn") > 0), FEATURE).withColumn("_q", _v() / F.exp("_lg"))
        f = sample_quantile(q, 0.5, "_f", "_q").join(lib, SAMPLE).withColumn("_f", F.col("_f") / F.col("lib")).drop("lib")
    elif how == "tmm":
        f = _tmm(d, lib)
    else:
        raise ValueError(how)
    f = with_stats(checkpointed(f), ["layer"], F.avg(F.log("_f")).alias("_g"))
    return lib.join(f, SAMPLE).select(*SAMPLE, "lib", (F.col("_f") / F.exp("_g")).alias("factor"))


def reference_sample(d: DataFrame, lib: DataFrame) -> DataFrame:
    """Sample of each layer whose upper quartile is closest to the mean one."""
    q = sample_quantile(d.join(lib, SAMPLE).withColumn("_x", _v() / F.col("lib")), 0.75, "_uq", "_x")
    q = with_stats(q, ["layer"], F.avg("_uq").alias("_mean"))
    return q.groupBy("layer").agg(F.min_by("sample", F.struct(F.round(F.abs(F.col("_uq") - F.col("_mean")), 14), "sample")).alias("_ref"))


def _tmm(d: DataFrame, lib: DataFrame, m_trim: float = 0.3, a_trim: float = 0.05) -> DataFrame:
    ref = checkpointed(reference_sample(d, lib))
    r = (d.join(ref, "layer").where(F.col("sample") == F.col("_ref"))
         .join(lib, SAMPLE).select(*FEATURE, _v().alias("_r"), F.col("lib").alias("_nr")))
    x = d.join(lib, SAMPLE).join(r, FEATURE).where((_v() > 0) & (F.col("_r") > 0))
    y, yr = _v() / F.col("lib"), F.col("_r") / F.col("_nr")
    x = (x.withColumn("_m", F.round(F.log2(y / yr), 12)).withColumn("_a", F.round((F.log2(y) + F.log2(yr)) / 2, 12))
         .withColumn("_w", 1 / ((F.col("lib") - _v()) / F.col("lib") / _v() + (F.col("_nr") - F.col("_r")) / F.col("_nr") / F.col("_r"))))
    x = checkpointed(x.select(*SAMPLE, "_m", "_a", "_w"))
    rm = value_ranks(x, SAMPLE, "_m").select(*SAMPLE, "_m", F.col("avg_rank").alias("_rm"))
    ra = value_ranks(x, SAMPLE, "_a").select(*SAMPLE, "_a", F.col("avg_rank").alias("_ra"))
    n = x.groupBy(*SAMPLE).agg(F.count("*").alias("_n"), F.max(F.abs("_m")).alias("_mm"))
    k = x.join(rm, [*SAMPLE, "_m"]).join(ra, [*SAMPLE, "_a"]).join(n, SAMPLE)
    lm, la = F.floor(F.col("_n") * m_trim) + 1, F.floor(F.col("_n") * a_trim) + 1
    k = k.where((F.col("_rm") >= lm) & (F.col("_rm") <= F.col("_n") + 1 - lm) & (F.col("_ra") >= la) & (F.col("_ra") <= F.col("_n") + 1 - la))
    f = k.groupBy(*SAMPLE).agg((F.sum(F.col("_m") * F.col("_w")) / F.sum("_w")).alias("_lf"))
    return n.join(f, SAMPLE, "left").select(
        *SAMPLE, F.when(F.col("_mm") < 1e-6, 1.0).otherwise(F.coalesce(F.pow(F.lit(2.0), "_lf"), F.lit(1.0))).alias("_f"))


def counts(m: DataFrame) -> DataFrame:
    """Rounded, negatives to zero."""
    return m.withColumn("value", F.greatest(F.bround("value"), F.lit(0.0)))


def _logcpm(m, prior: float = 2.0):
    m = counts(m)
    f = norm_factors(m, "tmm").withColumn("_el", F.col("lib") * F.col("factor"))
    f = with_stats(f, ["layer"], F.avg("_el").alias("_mean"))
    d = m.join(f, SAMPLE)
    pc = F.col("_el") / F.col("_mean") * prior
    return _out(d, F.log2((_v() + pc) / (F.col("_el") + 2 * pc) * 1e6))


def voom(m: DataFrame, how: str | None = None) -> DataFrame:
    """log2((count + 0.5) / (lib * factor + 1) * 1e6); ``how`` None uses factor 1."""
    if how is None:
        f = library_sizes(m).withColumn("factor", F.lit(1.0))
    else:
        f = norm_factors(m, how)
    return _out(m.join(f, SAMPLE), F.log2((_v() + 0.5) / (F.col("lib") * F.col("factor") + 1) * 1e6))


def _vst(m):
    """Variance-stabilizing transform of counts.

    Size factors by median ratio, dispersion trend a0 + a1/mean by least squares on
    per-feature moment estimates (weights 1), then the closed form for that trend.
    """
    d = counts(m)
    f = norm_factors(d, "rle").withColumn("_sf", F.col("lib") * F.col("factor"))
    f = with_stats(f, ["layer"], F.avg(F.log("_sf")).alias("_g")).select(*SAMPLE, (F.col("_sf") / F.exp("_g")).alias("_sf"))
    d = d.join(f, SAMPLE).withColumn("_q", _v() / F.col("_sf"))
    mom = d.groupBy(*FEATURE).agg(F.avg("_q").alias("_mu"), F.var_samp("_q").alias("_var"), F.avg(1 / F.col("_sf")).alias("_xi"))
    disp = mom.where((F.col("_mu") > 0) & (F.col("_var") > 0)).withColumn("_d", (F.col("_var") - F.col("_xi") * F.col("_mu")) / F.col("_mu") ** 2) \
        .where(F.col("_d") > 1e-8).withColumn("_im", 1 / F.col("_mu"))
    trend = disp.groupBy("layer").agg(F.regr_slope("_d", "_im").alias("_a1"), F.regr_intercept("_d", "_im").alias("_a0"),
                                      F.avg("_d").alias("_ad"))
    d = d.join(trend, "layer", "left")
    a1 = F.greatest(F.coalesce("_a1", F.lit(0.0)), F.lit(0.0))
    a0 = F.greatest(F.coalesce("_a0", "_ad", F.lit(0.01)), F.lit(1e-4))
    q = F.col("_q")
    z = (1 + a1 + 2 * a0 * q + 2 * F.sqrt(a0 * q * (1 + a1 + a0 * q))) / (4 * a0)
    return _out(d, F.log2(z))


def _css(m, rel: float = 0.1):
    """Cumulative-sum scaling.

    Positive-value quantiles on a 0.01 grid per sample; the first grid level whose
    change of the median absolute deviation from the reference curve exceeds ``rel``
    (at least the median) is the scaling quantile of the layer.
    """
    grid = [i / 100 for i in range(1, 101)]
    pos = m.where(_v() > 0)
    q = checkpointed(quantile_grid(checkpointed(pos), SAMPLE, "value", grid))
    e = q.select(*SAMPLE, F.posexplode("_q").alias("_i", "_x"))
    e = with_stats(e, ["layer", "_i"], F.avg("_x").alias("_ref")).withColumn("_dev", F.abs(F.col("_x") - F.col("_ref")))
    dev = quantiles(e, ["layer", "_i"], "_dev", {"_d": 0.5})
    from pyspark.sql import Window as W
    w = W.partitionBy("layer").orderBy("_i")
    dev = dev.withColumn("_rel", F.abs(F.lead("_d").over(w) - F.col("_d")) / F.nullif(F.lead("_d").over(w), F.lit(0.0)))
    lev = dev.groupBy("layer").agg(F.min(F.when((F.col("_rel") > rel) & (F.col("_i") >= 49), F.col("_i"))).alias("_lev"))
    cut = q.join(lev, "layer").select(*SAMPLE, F.col("_q")[F.coalesce("_lev", F.lit(49))].alias("_cut"))
    s = pos.join(cut, SAMPLE).groupBy(*SAMPLE).agg(F.sum(F.when(_v() <= F.col("_cut"), _v())).alias("_s"))
    s = s.join(quantiles(s, ["layer"], "_s", {"_med": 0.5}), "layer")
    return _out(m.join(s, SAMPLE), _v() / F.col("_s") * F.col("_med"))


def _vsn(m, iterations: int = 16, keep: float = 0.9):
    """Affine calibration per sample and arsinh, by profile likelihood on the least-residual features.

    Two numbers per sample live on the driver; one pass over the features returns
    the objective and its gradient.  Result on the glog2 scale.
    """
    out = None
    for lay in [r[0] for r in m.select("layer").distinct().collect()]:
        one = m.where(F.col("layer") == lay)
        part = _vsn_layer(one, iterations, keep)
        out = part if out is None else out.unionByName(part)
    return out


def _vsn_layer(m, iterations, keep):
    order = sample_ids(m)
    n = len(order)
    vecs = checkpointed(vectors(m, order))
    st = m.groupBy("sample").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd")).collect()
    sd = {r["sample"]: r["sd"] or 1.0 for r in st}
    base = np.array([np.log(1.0 / sd[s]) for s in order])
    par = np.concatenate([np.zeros(n), base])
    cut = np.inf

    def passes(p, cut, want_q=False):
        a, b = p[:n], np.exp(p[n:])

        def fn(pdf):
            x = np.vstack(pdf["vec"].to_numpy())
            ok = ~np.isnan(x)
            x = np.where(ok, x, 0.0)
            z = a + b * x
            h = np.where(ok, np.arcsinh(z), 0.0)
            cnt = np.maximum(ok.sum(1, keepdims=True), 1)
            r = np.where(ok, h - h.sum(1, keepdims=True) / cnt, 0.0)
            var = (r ** 2).sum(1) / cnt[:, 0]
            w = (var <= cut).astype(float)[:, None] * ok
            s1 = np.sqrt(1 + z * z)
            dz, dj = 1 / s1, z / (1 + z * z)
            out = {"ss": (w * r * r).sum(), "n": w.sum(), "lj": (w * (np.log(b) - np.log(s1))).sum(),
                   "ga": (w * r * dz).sum(0), "gb": (w * r * dz * b * x).sum(0),
                   "ja": -(w * dj).sum(0), "jb": (w * (1 - dj * b * x)).sum(0)}
            if want_q:
                edges = np.concatenate([[-np.inf], np.logspace(-12, 3, 3000), [np.inf]])
                out["hist"] = np.histogram(var, edges)[0].astype(float)
            return out

        return {k: v for k, v in fold_rows(vecs, fn).items()}

    def value(s):
        f = 0.5 * np.log(s["ss"] / s["n"]) - s["lj"] / s["n"]
        g = np.concatenate([s["ga"] / s["ss"] - s["ja"] / s["n"], s["gb"] / s["ss"] - s["jb"] / s["n"]])
        return float(f), g

    for rnd in range(2):
        s = passes(par, cut)
        f, g = value(s)
        hist: list = []
        for _ in range(iterations // 2):
            d = -g
            alphas = []
            for y, dx, rho in reversed(hist):
                al = rho * dx @ d
                alphas.append(al)
                d = d - al * y
            if hist:
                y, dx, rho = hist[-1]
                d = d * ((dx @ y) / (y @ y))
            else:
                d = d / max(1.0, np.abs(d).max()) * 0.1
            for (y, dx, rho), al in zip(hist, reversed(alphas)):
                d = d + dx * (al - rho * (y @ d))
            step, done = 1.0, True
            for _ in range(8):
                s2 = passes(par + step * d, cut)
                f2, g2 = value(s2)
                if np.isfinite(f2) and f2 < f + 1e-4 * step * (g @ d):
                    done = False
                    break
                step /= 2
            if done:
                break
            dx, y = step * d, g2 - g
            if dx @ y > 1e-12:
                hist = (hist + [(y, dx, 1 / (dx @ y))])[-6:]
            small = abs(f - f2) < 1e-5
            par, f, g = par + dx, f2, g2
            if small or g @ g < 1e-10:
                break
        if rnd == 0:
            h = passes(par, np.inf, True)["hist"]
            edges = np.concatenate([np.logspace(-12, 3, 3000), [np.inf]])
            cut = edges[np.searchsorted(np.cumsum(h), keep * h.sum())]
    a, b = par[:n], np.exp(par[n:])
    shift = np.log2(2 * np.median(b))

    def out(it):
        for pdf in it:
            if len(pdf):
                x = np.vstack(pdf["vec"].to_numpy())
                yield pdf.assign(vec=list(np.arcsinh(a + b * x) / np.log(2) - shift))

    d = _unpack(vecs.mapInPandas(out, "layer string, feature string, vec array<double>"), order)
    return d.withColumn("value", F.when(F.isnan("value"), None).otherwise(F.col("value")))


NORMALIZERS = {
    "none": lambda m: m, "sum": _sum, "median": _median, "pqn": _pqn, "log2": _log2, "glog10": _glog10,
    "cuberoot": _cuberoot, "quantile": _quantile, "vsn": _vsn, "vsn_quantile": lambda m: _quantile(_vsn(m)),
    "logcpm": _logcpm, "voom": voom, "tmm": lambda m: voom(m, "tmm"), "rle": lambda m: voom(m, "rle"),
    "uq": lambda m: voom(m, "uq"), "vst": _vst, "css": _css, "clr": _clr, "colsum": _colsum,
    "vsn_qrilc": lambda m: _qrilc_after(_vsn(m)), "pqn_log_qrilc": lambda m: log_qrilc(_pqn(m)),
}


def _qrilc_after(m):
    from lamella.operators.impute import impute_qrilc
    return impute_qrilc(m)


def normalize(m: DataFrame, how: str) -> DataFrame:
    return NORMALIZERS[how](m)


def scale(m: DataFrame, how: str) -> DataFrame:
    """Feature-wise center / auto / pareto / range, or sample-wise colsum."""
    if how == "colsum":
        return _colsum(m)
    d = with_stats(m, FEATURE, F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"),
                   F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    c = _v() - F.col("_m")
    rng = F.col("_hi") - F.col("_lo")
    return _out(d, {"center": c, "auto": c / F.nullif(F.col("_s"), F.lit(0.0)),
                    "pareto": c / F.nullif(F.sqrt("_s"), F.lit(0.0)),
                    "range": F.when(rng == 0, _v()).otherwise(c / F.nullif(rng, F.lit(0.0)))}[how])


def complete_features(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Complete features, and how many were removed per layer."""
    kept = drop_incomplete(m)
    a = m.select(*FEATURE).distinct().groupBy("layer").agg(F.count("*").alias("n_before"))
    b = kept.select(*FEATURE).distinct().groupBy("layer").agg(F.count("*").alias("n_after"))
    rep = a.join(b, "layer", "left").na.fill(0).withColumn("n_removed", F.col("n_before") - F.col("n_after"))
    return kept, rep


def plan_for(kind: str, whole_share: float | None) -> str:
    """Which normalization a layer type gets."""
    k = kind.lower()
    if k.startswith("generic"):
        return "vsn"
    if k.startswith("mic"):
        return "clr"
    if any(w in k for w in ("rna", "seq", "count", "gene")):
        return "logcpm" if (whole_share or 0) > 0.95 else "log2"
    if k.startswith("prot"):
        return "vsn_qrilc"
    if k.startswith("met"):
        return "pqn_log_qrilc"
    return "log2"


def auto_normalize(m: DataFrame, layers: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Normalize each raw layer by its type (``layers``: ``layer, type, state``); the plan is returned too."""
    from lamella.operators.quality import layer_state
    known = {r["layer"]: r for r in layers.collect()}
    chosen, out = {}, None
    for r in layer_state(m, layers.where(F.col("state").isNotNull()).select("layer", "state")).collect():
        lay = r["layer"]
        chosen[lay] = plan_for(known[lay]["type"], r["whole_share"]) if r["state"] == "raw" else "none"
        one = m.where(F.col("layer") == lay)
        part = normalize(one, chosen[lay]).select(*CELL, "value")
        out = part if out is None else out.unionByName(part)
    return out, chosen


def unit_scale(scores: DataFrame, keys: list[str] = ["factor"]) -> DataFrame:
    """z-score per column, then divide by the largest absolute value of all."""
    d = with_stats(scores, keys, F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    d = d.withColumn("value", (_v() - F.col("_m")) / F.col("_s")).drop("_m", "_s").withColumn("_one", F.lit(1))
    return d.join(d.groupBy("_one").agg(F.max(F.abs("value")).alias("_x")), "_one") \
        .withColumn("value", _v() / F.col("_x")).drop("_one", "_x")


def rescale(df: DataFrame, a: float, b: float, col: str = "value") -> DataFrame:
    """Linear map onto [a, b]: zeros become 1 first, the lower bound doubles under 50 items, constants give 8."""
    d = df.withColumn(col, F.when(F.col(col) == 0, 1.0).otherwise(F.col(col))).withColumn("_one", F.lit(1))
    s = d.groupBy("_one").agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"), F.count("*").alias("_n"))
    lo = F.when(F.col("_n") < 50, 2.0 * a).otherwise(float(a))
    out = F.when(F.col("_hi") == F.col("_lo"), 8.0).otherwise(
        lo + (F.col(col) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * (b - lo))
    return d.join(s, "_one").withColumn(col, out).drop("_one", "_lo", "_hi", "_n")
