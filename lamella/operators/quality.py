"""Shape and quality of the long table (inventory section B)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lamella.core import (CELL, FEATURE, SAMPLE, checkpointed, keep_features, layer_sample_counts, layer_sizes, with_stats)
from lamella.functions.ranking import quantiles

COLLAPSE = {
    "mean": lambda c: F.avg(c),
    "median": lambda c: F.percentile(c, 0.5),
    "max": lambda c: F.max(c),
    "sum": lambda c: F.sum(c),
}


def to_numeric(m: DataFrame) -> DataFrame:
    """Parse text values; thousands commas go only where that removes every failure of a layer."""
    v = F.trim("value")
    plain, bare = v.try_cast("double"), F.regexp_replace(v, ",", "").try_cast("double")
    given = F.col("value").isNotNull() & (v != "") & (F.upper(v) != "NA")
    verdict = m.groupBy("layer").agg(
        F.count_if(given & plain.isNull()).alias("_f0"), F.count_if(given & bare.isNull()).alias("_f1"))
    return (m.join(verdict, "layer")
            .withColumn("value", F.when((F.col("_f0") > 0) & (F.col("_f1") == 0), bare).otherwise(plain))
            .drop("_f0", "_f1"))


def non_numeric(m: DataFrame) -> DataFrame:
    """Values of each layer that stay unparsed once commas are stripped."""
    v = F.trim("value")
    given = F.col("value").isNotNull() & (v != "") & (F.upper(v) != "NA")
    return m.groupBy("layer").agg(
        F.count_if(given & F.regexp_replace(v, ",", "").try_cast("double").isNull()).alias("n_bad"))


def collapse_features(m: DataFrame, how: str = "mean") -> DataFrame:
    """One row per cell; duplicates reduced, nulls skipped."""
    return m.groupBy(*CELL).agg(COLLAPSE[how]("value").alias("value"))


def merge_samples(m: DataFrame) -> DataFrame:
    """Mean of duplicate columns."""
    return collapse_features(m, "mean")


def drop_constant(m: DataFrame, eps: float = 0.0) -> DataFrame:
    """Drop features whose variance is null or not above ``eps``."""
    s = m.groupBy(*FEATURE).agg(F.var_samp("value").alias("_var"))
    return keep_features(m, s.where(F.col("_var") > eps))


def missing_summary(m: DataFrame) -> DataFrame:
    """Present and missing cells per layer (absent rows count as missing)."""
    return (layer_sizes(m).join(m.groupBy("layer").agg(F.count("value").alias("n_present")), "layer")
            .withColumn("n_missing", F.col("n_samples") * F.col("n_features") - F.col("n_present"))
            .withColumn("missing_fraction", F.col("n_missing") / (F.col("n_samples") * F.col("n_features"))))


def quality_gate(m: DataFrame, sample_limit: float = 0.6, feature_limit: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Drop samples, then features, with too much missing; second frame is the verdict per layer."""
    size = layer_sizes(m)
    s = (m.groupBy(*SAMPLE).agg(F.count("value").alias("_n")).join(size, "layer")
         .where(1 - F.col("_n") / F.col("n_features") < sample_limit))
    m1 = m.join(s.select(*SAMPLE), SAMPLE, "left_semi")
    ns = s.groupBy("layer").agg(F.count("*").alias("kept_samples"))
    f = (m1.groupBy(*FEATURE).agg(F.count("value").alias("_n")).join(ns, "layer")
         .where(1 - F.col("_n") / F.col("kept_samples") < feature_limit))
    nf = f.groupBy("layer").agg(F.count("*").alias("kept_features"))
    report = (size.join(ns, "layer", "left").join(nf, "layer", "left").na.fill(0)
              .withColumn("passed", (F.col("kept_features") >= 0.25 * F.col("n_features"))
                          & (F.col("kept_samples") >= 0.5 * F.col("n_samples"))))
    return keep_features(m1, f), report


def clean_text(c: Column, kind: str) -> Column:
    if kind == "sample":
        return F.regexp_replace(c, r"[^A-Za-z0-9./_\-]", "")
    return F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0e-\x1f\x7f]|[^\x00-\x7f]", "_"),
                            r"[^A-Za-z0-9\s,'./_\-]", "")


def clean_names(df: DataFrame, kind: str, name: str = "name") -> DataFrame:
    """Cleaned, then made unique by ``.n`` (original order = order of the raw name); suffixes that make a taken name are passed over."""
    d = df.withColumn("clean", clean_text(F.col(name), kind))
    w = W.partitionBy("clean").orderBy(name)
    d = d.withColumn("_i", F.row_number().over(w) - 1)
    form = r"(?s)^(.*)\.([1-9][0-9]{0,8})$"
    taken = (d.select("clean").distinct().where(F.col("clean").rlike(form))
             .groupBy(F.regexp_extract("clean", form, 1).alias("clean")).agg(F.sort_array(F.collect_set(F.regexp_extract("clean", form, 2).cast("int"))).alias("_taken")))
    d = d.join(taken, "clean", "left").withColumn("_taken", F.coalesce("_taken", F.array().cast("array<int>")))
    # the i-th free suffix: as many taken ones lie below it as fit
    free = F.col("_i") + F.size(F.filter("_taken", lambda t, j: t - j <= F.col("_i")))
    return d.withColumn("clean", F.when(F.col("_i") == 0, F.col("clean")).otherwise(F.concat_ws(".", "clean", free.cast("string")))).select(*df.columns, "clean")


def check_type(m: DataFrame) -> DataFrame:
    """Negatives, share of values under 30, decimals; verdict for count data."""
    v = F.col("value")
    return (m.groupBy("layer").agg(
        (F.min(v) < 0).alias("has_negative"),
        F.avg((v < 30).cast("double")).alias("share_below_30"),
        F.max(F.pmod(v, F.lit(1.0)) != 0).alias("has_decimal"))
        .withColumn("log_like", F.col("share_below_30") > 0.85)
        .withColumn("count_ok", ~F.col("has_negative") & ~F.col("has_decimal")))


def drop_sparse(m: DataFrame, p: float = 0.5, zero_p: float | None = None) -> DataFrame:
    """Drop features with missing fraction >= p or zero fraction >= zero_p (p unless given)."""
    zero_p = p if zero_p is None else zero_p
    s = (m.groupBy(*FEATURE).agg(F.count("value").alias("_n"), F.count_if(F.col("value") == 0).alias("_z"))
         .join(layer_sample_counts(m), "layer"))
    return keep_features(m, s.where((1 - F.col("_n") / F.col("n_samples") < p) & (F.col("_z") / F.col("n_samples") < zero_p)))


def layer_state(m: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """raw / normalized / scaled per layer; a declared state (``layer, state``) wins."""
    v = F.col("value")
    per = (m.groupBy(*FEATURE).agg(F.avg(v).alias("_mean"), F.stddev_samp(v).alias("_sd"))
           .where(F.col("_sd").isNotNull()))
    usable = per.groupBy("layer").agg(F.count("*").alias("n_usable"))
    med_mean = quantiles(per.withColumn("_am", F.abs("_mean")), ["layer"], "_am", {"med_mean": 0.5})
    med_sd = quantiles(per, ["layer"], "_sd", {"med_sd": 0.5})
    whole = (F.abs(v - F.rint(v)) < 1e-6) & (v > 0)
    tot = m.groupBy("layer").agg(
        F.avg((v < 0).cast("double")).alias("negative_share"), F.max(v).alias("max"), F.min(v).alias("min"),
        (F.count_if(whole) / F.count_if(v > 0)).alias("whole_share"))
    d = tot.join(usable, "layer", "left").join(med_mean, "layer", "left").join(med_sd, "layer", "left")
    ints = (F.col("whole_share") > 0.95) & (F.col("min") >= 0)
    state = (F.when((F.col("n_usable") >= 5) & (F.col("med_mean") < 0.15) & (F.abs(F.col("med_sd") - 1) < 0.25), "scaled")
             .when(F.col("negative_share") > 0.10, "normalized")
             .when(F.col("max") < 20, F.when(F.coalesce(ints, F.lit(False)), "raw").otherwise("normalized"))
             .when((F.col("max") <= 50) & ~F.coalesce(ints, F.lit(False)), "normalized")
             .otherwise("raw"))
    d = d.withColumn("state", state)
    if declared is not None:
        d = (d.join(declared.select("layer", F.col("state").alias("_given")), "layer", "left")
             .withColumn("state", F.coalesce("_given", "state")).drop("_given"))
    return d.select("layer", "state", "max", "negative_share", "whole_share", "med_mean", "med_sd")


def common_samples(m: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Rows of samples present in every layer (and in the metadata); needs two at least."""
    ls = checkpointed(m.select("layer", "sample").distinct())
    layers = ls.select("layer").distinct().count()
    if meta is not None:
        ls = ls.join(meta.select("sample"), "sample", "left_semi")
    keep = checkpointed(ls.groupBy("sample").agg(F.count("*").alias("_in")).where(F.col("_in") == layers).select("sample"))
    if len(keep.take(2)) < 2:
        raise ValueError("fewer than 2 common samples")
    return m.join(keep, "sample", "left_semi").select(*CELL, "value")


def check_integrity(m: DataFrame) -> DataFrame:
    """Every pair of layers: sizes, shared samples, and whether the sets are equal."""
    ls = m.select("layer", "sample").distinct()
    n = ls.groupBy("layer").agg(F.count("*").alias("n"))
    shared = (ls.withColumnRenamed("layer", "layer1").join(ls.withColumnRenamed("layer", "layer2"), "sample")
              .where("layer1 < layer2").groupBy("layer1", "layer2").agg(F.count("*").alias("shared")))
    pairs = (n.select(F.col("layer").alias("layer1"), F.col("n").alias("n1"))
             .join(n.select(F.col("layer").alias("layer2"), F.col("n").alias("n2")), F.expr("layer1 < layer2")))
    return (pairs.join(shared, ["layer1", "layer2"], "left").na.fill(0, ["shared"])
            .withColumn("same", (F.col("n1") == F.col("shared")) & (F.col("n2") == F.col("shared"))))


def clean_inf(df: DataFrame, col: str = "value", limit: float = 999999.0) -> DataFrame:
    c = F.col(col)
    return df.withColumn(col, F.when(c == float("inf"), limit).when(c == float("-inf"), -limit).otherwise(c))


def select_samples(m: DataFrame, meta: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Restrict layers and metadata to ``keep`` (column ``sample``); three must remain."""
    left = meta.join(keep.select("sample"), "sample", "left_semi")
    ok = left.agg(F.count("*").alias("_c")).select(
        F.when(F.col("_c") >= 3, F.lit(True)).otherwise(F.raise_error(F.lit("fewer than 3 samples remain")).cast("boolean")).alias("_ok"))
    left = left.join(ok, F.col("_ok")).drop("_ok")
    return m.join(left.select("sample"), "sample", "left_semi"), left


def rename_sample(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumn("sample", F.when(F.col("sample") == old, new).otherwise(F.col("sample")))


def set_meta(meta: DataFrame, sample: str, var: str, value) -> DataFrame:
    return meta.withColumn(var, F.when(F.col("sample") == sample, F.lit(value)).otherwise(F.col(var)))


def summarize(m: DataFrame, meta: DataFrame | None = None, var: str | None = None) -> DataFrame:
    """Dimensions, missing cells and, with a variable, the number of groups per layer."""
    out = missing_summary(m).drop("missing_fraction")
    if meta is not None and var:
        g = (m.select("layer", "sample").distinct().join(meta.select("sample", var), "sample")
             .groupBy("layer").agg(F.count_distinct(var).alias("n_groups")))
        out = out.join(g, "layer", "left")
    return out


def distribution(m: DataFrame, by: list[str] = SAMPLE) -> DataFrame:
    """Five-number summary per group, exact for groups of any size."""
    q = quantiles(m, by, "value", {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q100": 1.0})
    return q.join(m.groupBy(*by).agg(F.count("value").alias("n"), F.avg("value").alias("mean")), by)


def histogram(m: DataFrame, bins: int = 20, by: list[str] = ["layer"]) -> DataFrame:
    """Equal-width counts between the minimum and maximum of each group."""
    d = with_stats(m.where(F.col("value").isNotNull()), by, F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    b = F.least(F.lit(bins), F.floor((F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins) + 1)
    return d.withColumn("bin", F.coalesce(b, F.lit(1)).cast("bigint")).groupBy(*by, "bin").agg(F.count("*").alias("n"))
