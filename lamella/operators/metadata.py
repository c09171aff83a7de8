"""Sample metadata (inventory section C).  Wide ``samples`` frame: ``sample`` plus one column per variable."""
from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lamella.core import bounded
from lamella.functions import special

CLEAN_LABEL = r"^[A-Za-z0-9][A-Za-z0-9_\-]*$"


def variables(meta: DataFrame) -> list[str]:
    return [c for c in meta.columns if c != "sample"]


def meta_long(meta: DataFrame) -> DataFrame:
    """``sample, var, value`` with NA and blank text as null."""
    cols = variables(meta)
    d = meta.select("sample", *[F.col(c).cast("string").alias(c) for c in cols])
    d = d.unpivot(["sample"], cols, "var", "value")
    return d.withColumn("value", F.when(F.trim("value").isin("", "NA"), None).otherwise(F.col("value")))


def infer_meta(meta: DataFrame) -> DataFrame:
    """``var, kind``: disc, cont or rejected."""
    d = meta_long(meta).where(F.col("value").isNotNull())
    cnt = d.groupBy("var", "value").agg(F.count("*").alias("_n"))
    s = cnt.groupBy("var").agg(F.min("_n").alias("min_count"), F.count("*").alias("n_levels"), F.sum("_n").alias("n"),
                               F.count_if(F.expr("try_cast(value as double)").isNull()).alias("_bad"))
    kind = (F.when((F.col("n") > F.col("n_levels")) & (F.col("min_count") >= 2), "disc")
            .when(F.col("_bad") == 0, "cont").otherwise("rejected"))
    return s.select("var", "n", "n_levels", "min_count", kind.alias("kind"))


def clean_levels(long: DataFrame) -> DataFrame:
    """Valid labels stay; others become syntactic names; a common X prefix goes."""
    made = F.regexp_replace("value", r"[^A-Za-z0-9._]", ".")
    made = F.when(F.col("value").rlike(r"^([A-Za-z]|\.([^0-9]|$))"), made).otherwise(F.concat(F.lit("X"), made))
    d = long.withColumn("value", F.when(F.col("value").isNull() | F.col("value").rlike(CLEAN_LABEL), F.col("value")).otherwise(made))
    all_x = d.groupBy("var").agg(F.min(F.col("value").startswith("X")).alias("_x"))
    return (d.join(all_x, "var")
            .withColumn("value", F.when(F.col("_x"), F.expr("substring(value, 2)")).otherwise(F.col("value"))).drop("_x"))


def meta_diagnostics(meta: DataFrame) -> DataFrame:
    """Group sizes per variable, QC and blank samples aside, and the resulting status."""
    d = meta_long(meta).where(F.col("value").isNotNull() & ~F.lower("value").isin("qc", "blank"))
    g = (d.groupBy("var", "value").agg(F.count("*").alias("_n")).groupBy("var")
         .agg(F.count("*").alias("n_groups"), F.min("_n").alias("min_size"), F.sum("_n").alias("n")))
    status = (F.when(F.col("n") < 4, "too few samples")
              .when((F.col("n_groups") / F.col("min_size") > 3) & ~F.lower("var").isin("subject", "time"), "too many groups")
              .when((F.col("min_size") < 3) | (F.col("n_groups") < 2), "low replicates").otherwise("ok"))
    return g.withColumn("status", status)


def meta_missing(meta: DataFrame) -> DataFrame:
    return meta_long(meta).groupBy("var").agg(
        F.count_if(F.col("value").isNull()).alias("n_missing"), F.count("*").alias("n"))


def edit_meta(meta: DataFrame, rename: dict[str, str] | None = None, drop: list[str] | None = None,
              to: dict[str, str] | None = None, primary: str | None = None) -> DataFrame:
    """Rename, delete, retype (``{"var": "double"}``) and move the primary column first."""
    d = meta.drop(*(drop or []))
    for var, typ in (to or {}).items():
        d = d.withColumn(var, F.col(var).try_cast(typ))
    d = d.withColumnsRenamed(rename or {})
    if primary:
        d = d.select("sample", primary, *[c for c in variables(d) if c != primary])
    return d


def order_levels(meta: DataFrame, var: str, levels: list[str]) -> DataFrame:
    """Attach the ordinal of each level as ``<var>_rank``."""
    o = meta.sparkSession.createDataFrame([(v, i) for i, v in enumerate(levels)], f"`{var}` string, `{var}_rank` int")
    return meta.join(F.broadcast(o), var, "left")


def encode_meta(meta: DataFrame, types: dict[str, str]) -> DataFrame:
    """Long ``sample, column, value``: continuous mean-imputed z-scores, discrete one-hot indicators."""
    cont = [v for v, k in types.items() if k == "cont"]
    disc = [v for v, k in types.items() if k == "disc"]
    parts = []
    if cont:
        c = meta.select("sample", *[F.col(v).cast("double") for v in cont]).unpivot(["sample"], cont, "column", "value")
        mean = c.groupBy("column").agg(F.avg("value").alias("_m"))
        c = c.join(mean, "column").withColumn("value", F.coalesce("value", "_m"))
        sd = c.groupBy("column").agg(F.stddev_samp("value").alias("_s"))
        parts.append(c.join(sd, "column").select("sample", "column", ((F.col("value") - F.col("_m")) / F.col("_s")).alias("value")))
    for v in disc:
        levels = meta.where(F.col(v).isNotNull()).select(F.lit(1).alias("_one"), F.col(v).alias("_level")).distinct() \
            .groupBy("_one").agg(F.collect_list("_level").alias("_levels"))
        parts.append(meta.select("sample", v, F.lit(1).alias("_one")).join(levels, "_one")
                     .select("sample", v, F.explode("_levels").alias("_l"))
                     .select("sample", F.concat_ws("_", F.lit(v), "_l").alias("column"),
                             F.coalesce((F.col(v) == F.col("_l")).cast("double"), F.lit(0.0)).alias("value")))
    return reduce(DataFrame.unionByName, parts)


def code_meta(meta: DataFrame) -> DataFrame:
    """Long numeric metadata: numbers as they are, text as the 1-based position of its level."""
    kinds = dict(meta.dtypes)
    d = meta_long(meta).where(F.col("value").isNotNull())
    text = [v for v in variables(meta) if kinds[v] == "string"]
    code = (d.where(F.col("var").isin(text)).select("var", "value").distinct()
            .withColumn("_code", F.row_number().over(W.partitionBy("var").orderBy("value"))))
    return d.join(code, ["var", "value"], "left").select(
        "sample", "var", F.when(F.col("var").isin(text), F.col("_code").cast("double")).otherwise(F.expr("try_cast(value as double)")).alias("value"))


def meta_corr(meta: DataFrame, method: str = "pearson", partial: bool = False, digits: int = 3) -> DataFrame:
    """Correlation of every pair of metadata variables, rounded."""
    from lamella.operators import correlation as C
    m = code_meta(meta).select(F.lit("meta").alias("layer"), F.col("var").alias("feature"), "sample", "value")
    r = C.partial_corr(m, method) if partial else C.correlate(m, method)
    return r.select(F.col("feature1").alias("var1"), F.col("feature2").alias("var2"), F.round("r", digits).alias("r"))


def contingency(meta: DataFrame, a: str, b: str) -> DataFrame:
    return meta.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))


def _fisher_table(t: np.ndarray, draws: int = 2000, seed: int = 1) -> float:
    """Exact for 2 x 2; otherwise the share of random tables with the same margins that are as unlikely."""
    r, c, n = t.sum(1), t.sum(0), t.sum()
    lf = lambda x: special.lgamma(np.asarray(x, float) + 1)
    if t.shape == (2, 2):
        x = np.arange(max(0, r[0] - c[1]), min(r[0], c[0]) + 1)
        lp = lf(c[0]) - lf(x) - lf(c[0] - x) + lf(c[1]) - lf(r[0] - x) - lf(c[1] - r[0] + x) - (lf(n) - lf(r[0]) - lf(n - r[0]))
        p = np.exp(lp)
        return float(min(1.0, p[p <= p[x == t[0, 0]][0] * (1 + 1e-7)].sum()))
    rng = np.random.default_rng(seed)
    seen = -lf(t).sum()
    hit = 0
    for _ in range(draws):
        # row after row from what the columns still have: the cost does not depend on how many samples there are
        left, s = c.astype(np.int64), []
        for own in r.astype(np.int64):
            s.append(rng.multivariate_hypergeometric(left, own, method="marginals"))
            left = left - s[-1]
        hit += -lf(np.array(s)).sum() <= seen + 1e-7
    return float((hit + 1) / (draws + 1))


def meta_pair_test(meta: DataFrame, a: str, b: str, kind_a: str, kind_b: str, distinct: bool = False) -> DataFrame:
    """Association of two variables: ``test, stat, df1, df2, pval``."""
    d = meta.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    if distinct:
        d = d.distinct()
    if kind_a == kind_b == "cont":
        s = d.agg(F.corr(a, b).alias("stat"), F.count("*").alias("n"))
        return s.select(F.lit("pearson").alias("test"), "stat", F.lit(1.0).alias("df1"), (F.col("n") - 2.0).alias("df2"),
                        special.corr_pvalue(F.col("stat"), F.col("n")).alias("pval"))
    if kind_a != kind_b:
        g, y = (a, b) if kind_a == "disc" else (b, a)
        s = d.groupBy(g).agg(F.count(y).alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v"))
        t = s.agg(F.sum("n").alias("N"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("v")).alias("ssw"),
                  F.sum(F.col("n") * F.col("m")).alias("s1"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"))
        t = t.withColumn("df1", F.col("k") - 1.0).withColumn("df2", (F.col("N") - F.col("k")).cast("double")) \
            .withColumn("stat", (F.col("s2") - F.col("s1") ** 2 / F.col("N")) / F.col("df1") / (F.col("ssw") / F.col("df2")))
        return t.select(F.lit("anova").alias("test"), "stat", "df1", "df2", special.f_pvalue("stat", "df1", "df2").alias("pval"))
    cells = bounded(d.groupBy(a, b).agg(F.count("*").alias("n")), 100000, "contingency table")
    t = pd.DataFrame([r.asDict() for r in cells]).pivot(index=a, columns=b, values="n").fillna(0).to_numpy(int)
    p = _fisher_table(t)
    return meta.sparkSession.createDataFrame([("fisher", None, float(t.shape[0] - 1), float(t.shape[1] - 1), p)],
                                             "test string, stat double, df1 double, df2 double, pval double")


def combine_factors(meta: DataFrame, a: str, b: str, out: str = "combined") -> DataFrame:
    """``a_b`` with its rank in lexicographic level order; incomplete rows dropped."""
    d = meta.dropna(subset=[a, b]).withColumn(out, F.concat_ws("_", a, b))
    lev = d.select(out).distinct().select(out, F.lit(1).alias("_one"))
    lev = lev.withColumn(f"{out}_rank", F.row_number().over(W.partitionBy("_one").orderBy(out))).drop("_one")
    return d.join(lev, out)


def group_listing(meta: DataFrame, var: str) -> DataFrame:
    return meta.groupBy(var).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("sample")).alias("samples"))


def subset_contrast(m: DataFrame, meta: DataFrame, var: str, groups: list[str]) -> DataFrame:
    """Layer rows of the samples in the named groups, with the group attached."""
    return m.join(meta.where(F.col(var).isin(groups)).select("sample", F.col(var).alias("group")), "sample")


def scale_meta(meta: DataFrame, how: str = "zscore") -> DataFrame:
    """Long coded metadata as z-scores, or min-max to [0, 1] (0.5 when constant)."""
    d = code_meta(meta)
    s = d.groupBy("var").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"),
                             F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    d = d.join(s, "var")
    if how == "zscore":
        out: Column = (F.col("value") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))
    else:
        out = F.when(F.col("_hi") == F.col("_lo"), 0.5).otherwise((F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return d.select("sample", "var", out.alias("value"))
