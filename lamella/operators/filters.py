"""Feature filtering (inventory section F).  Each returns the rows of the kept features."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lamella.core import FEATURE, SAMPLE, checkpointed, keep_features, layer_sample_counts, with_stats
from lamella.functions.ranking import quantiles, row_numbers
from lamella.operators.impute import impute


def _v():
    return F.col("value")


MAD_CONSTANT = 1.4826


def feature_count(m: DataFrame) -> DataFrame:
    return m.select(*FEATURE).distinct().groupBy("layer").agg(F.count("*").alias("n_features"))


def ranked(stats: DataFrame, col: str, descending: bool = True) -> DataFrame:
    """Feature statistics with ``rn`` per layer (ties by the md5 of the feature id) and ``n_features``."""
    stats = checkpointed(stats)
    n = stats.groupBy("layer").agg(F.count("*").alias("n_features"))
    return row_numbers(stats, ["layer"], col, "feature", descending=descending).join(n, "layer")


def guarded(m: DataFrame, kept: DataFrame, keep: int = 10, min_samples: int = 5) -> DataFrame:
    """Apply a cut per layer unless the layer has few samples or too little would remain."""
    n = (kept.groupBy("layer").agg(F.count("*").alias("_k"))
         .join(layer_sample_counts(m), "layer").join(feature_count(m), "layer"))
    cut = n.where((F.col("_k") >= keep) & (F.col("n_samples") >= min_samples) & (F.col("n_features") > keep)).select("layer")
    whole = m.select(*FEATURE).distinct().join(cut, "layer", "left_anti")
    return keep_features(m, checkpointed(kept.select(*FEATURE).join(cut, "layer", "left_semi").unionByName(whole)))


def filter_abundance(m: DataFrame, how: str = "pct", t: float = 2.0) -> DataFrame:
    if how == "cpm":
        d = with_stats(m, SAMPLE, F.sum("value").alias("_lib"))
        s = d.groupBy(*FEATURE).agg(F.avg(_v() / F.col("_lib") * 1e6).alias("_s"))
        return keep_features(m, s.where(F.col("_s") >= t))
    s = m.groupBy(*FEATURE).agg(F.sum("value").alias("_s"))
    if how == "sum":
        return keep_features(m, s.where(F.col("_s") >= t))
    r = ranked(s, "_s", descending=False)
    return keep_features(m, r.where(F.col("rn") > F.bround(t / 100 * F.col("n_features"))))


def iqr(m: DataFrame) -> DataFrame:
    q = m.groupBy(*FEATURE).agg(F.percentile("value", [0.25, 0.75]).alias("_q"))
    return q.select(*FEATURE, (F.col("_q")[1] - F.col("_q")[0]).alias("iqr"))


def filter_iqr(m: DataFrame, v: float = 15.0) -> DataFrame:
    r = checkpointed(ranked(iqr(m), "iqr").select(*FEATURE, (F.col("rn") < F.col("n_features") * (100 - v) / 100).alias("_in")))
    share = r.groupBy("layer").agg((F.count_if("_in") / F.count("*")).alias("_k"))
    share = share.select("layer", F.when(1 - F.col("_k") > 0.8, F.raise_error(F.lit("over 80% of features removed")).cast("boolean")).otherwise(F.lit(True)).alias("_ok"))
    return keep_features(m, r.where("_in").join(share.where("_ok"), "layer"))


def feature_stats(m: DataFrame) -> DataFrame:
    """mean, sd, median, mad, iqr, rsd and nrsd per feature."""
    s = m.groupBy(*FEATURE).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
                                F.percentile("value", [0.25, 0.5, 0.75]).alias("_q"))
    s = s.select(*FEATURE, "mean", "sd", F.col("_q")[1].alias("median"), (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"))
    dev = m.join(s.select(*FEATURE, "median"), FEATURE).groupBy(*FEATURE).agg(
        (F.percentile(F.abs(_v() - F.col("median")), 0.5) * MAD_CONSTANT).alias("mad"))
    return (s.join(dev, FEATURE).withColumn("rsd", F.abs(F.col("sd") / F.col("mean")))
            .withColumn("nrsd", F.abs(F.col("mad") / F.col("median"))))


def filter_rank(m: DataFrame, stat: str = "iqr", c: float = 10.0, limit: int | None = None) -> DataFrame:
    """Keep the top (100 - c)% by a statistic, and at most ``limit`` if given."""
    r = ranked(feature_stats(m).where(F.col(stat).isNotNull()), stat)
    r = r.where(F.col("rn") <= F.col("n_features") * (1 - c / 100))
    return keep_features(m, r if limit is None else r.where(F.col("rn") <= limit))


def variances(m: DataFrame) -> DataFrame:
    return m.groupBy(*FEATURE).agg(F.var_samp("value").alias("variance"))


def filter_variance(m: DataFrame, c: float = 10.0) -> DataFrame:
    """Above the c% quantile of feature variance; pass through where the variances hardly differ."""
    s = variances(m).where(F.col("variance") > 0)
    lim = quantiles(s, ["layer"], "variance", {"_t": c / 100}).join(
        s.groupBy("layer").agg(F.var_samp("variance").alias("_vv")), "layer")
    ok = F.col("_vv").isNull() | (F.col("_vv") < 0.001) | (F.col("variance") > F.col("_t"))
    return keep_features(m, s.join(lim, "layer").where(ok))


def top_iqr(m: DataFrame, n: int) -> DataFrame:
    return keep_features(m, ranked(iqr(m).where("iqr > 0"), "iqr").where(F.col("rn") <= n))


def top_variance(m: DataFrame, k: int | None) -> DataFrame:
    """The ``k`` most variable features of each layer; None: all."""
    if k is None:
        return m
    return keep_features(m, ranked(variances(m).where(F.col("variance").isNotNull()), "variance").where(F.col("rn") <= k))


def _share(m: DataFrame, cond) -> DataFrame:
    return (m.groupBy(*FEATURE).agg(F.count_if(cond).alias("_c")).join(layer_sample_counts(m), "layer")
            .withColumn("share", F.col("_c") / F.col("n_samples")))


def filter_prevalence(m: DataFrame, p: float = 0.2, c: float = 2.0, keep: int = 10) -> DataFrame:
    return guarded(m, _share(m, _v() >= c).where(F.col("share") >= p), keep)


def filter_prevalence_rel(m: DataFrame, p: float = 0.1, rel: float = 1e-4, keep: int = 10) -> DataFrame:
    d = with_stats(m, SAMPLE, F.sum("value").alias("_lib"))
    return guarded(m, _share(d, (F.col("_lib") > 0) & (_v() / F.col("_lib") > rel)).where(F.col("share") >= p), keep)


def filter_by_expr(m: DataFrame, min_count: float = 10, min_total: float = 15, keep: int = 10) -> DataFrame:
    """CPM above ``min_count`` per median library in enough samples, and a minimum total."""
    lib = m.groupBy(*SAMPLE).agg(F.sum("value").alias("_lib"))
    cut = quantiles(lib, ["layer"], "_lib", {"_med": 0.5}).join(layer_sample_counts(m), "layer") \
        .withColumn("_cpm", min_count / F.col("_med") * 1e6) \
        .withColumn("_need", F.when(F.col("n_samples") > 10, 10 + 0.7 * (F.col("n_samples") - 10)).otherwise(F.col("n_samples")) - 1e-14)
    d = m.join(lib, SAMPLE).join(cut, "layer")
    s = d.groupBy(*FEATURE).agg(F.count_if(_v() / F.col("_lib") * 1e6 >= F.col("_cpm")).alias("_c"), F.sum("value").alias("_t"),
                                F.first("_need").alias("_need"))
    return guarded(m, s.where((F.col("_c") >= F.col("_need")) & (F.col("_t") >= min_total - 1e-14)), keep, 1)


def filter_present(m: DataFrame, meta: DataFrame | None = None, var: str | None = None, p: float = 0.8, keep: int = 10) -> DataFrame:
    """Present (> 0) in a share p of the samples of any group, or of all samples without groups."""
    if var is None:
        return guarded(m, _share(m, _v() > 0).where(F.col("share") >= p), keep)
    g = m.join(meta.select("sample", F.col(var).alias("_g")), "sample")
    size = m.select("layer", "sample").distinct().join(meta.select("sample", F.col(var).alias("_g")), "sample") \
        .groupBy("layer", "_g").agg(F.count("*").alias("_n"))
    r = (g.groupBy(*FEATURE, "_g").agg(F.count_if(_v() > 0).alias("_c")).join(size, ["layer", "_g"])
         .groupBy(*FEATURE).agg(F.max(F.col("_c") / F.col("_n")).alias("_best")))
    return guarded(m, r.where(F.col("_best") >= p), keep)


def filter_missing(m: DataFrame, p: float = 0.5, keep: int = 10) -> DataFrame:
    """Drop features whose null-or-zero share is above p."""
    s = _share(m, _v().isNotNull() & (_v() != 0))
    return guarded(m, s.where(1 - F.col("share") <= p), keep, 1)


def prefilter(m: DataFrame, layers: DataFrame, meta: DataFrame | None = None, var: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Type-driven filter of raw layers, constants dropped, residual nulls filled; counts before and after."""
    from lamella.operators.normalize import plan_for
    from lamella.operators.quality import layer_state
    known = {r["layer"]: r for r in layers.collect()}
    m = checkpointed(m.select(*FEATURE, "sample", "value"))  # every layer is read several times: what makes the table is shuffled once
    parts = []
    for r in layer_state(m, layers.where(F.col("state").isNotNull()).select("layer", "state")).collect():
        lay, kind = r["layer"], known[r["layer"]]["type"].lower()
        x = m.where(F.col("layer") == lay)
        raw = r["state"] == "raw"
        if raw:
            if "generic" in kind:
                x = filter_missing(x)
            elif "mic" in kind:
                x = filter_prevalence_rel(x)
            elif any(w in kind for w in ("rna", "seq", "count", "gene")):
                x = filter_by_expr(x)
            elif "met" in kind or "prot" in kind:
                x = filter_present(x, meta, var, 0.8 if "met" in kind else 0.7)
            else:
                x = filter_missing(x)
        live = variances(x).where("variance > 0").select(*FEATURE)
        x = keep_features(x, checkpointed(live))
        if not (raw and plan_for(kind, r["whole_share"]) in ("pqn_log_qrilc", "vsn_qrilc")):
            x = impute(x, "halfmin_pos")
        parts.append(x.select("layer", "feature", "sample", "value"))
    out = checkpointed(reduce(DataFrame.unionByName, parts))
    report = (feature_count(m).withColumnRenamed("n_features", "n_before")
              .join(feature_count(out).withColumnRenamed("n_features", "n_after"), "layer", "left").na.fill(0))
    return out, report
