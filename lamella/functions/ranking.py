"""Exact ranks and quantiles of groups that may be too big for one task.

A mergeable quantile sketch per group gives value bounds; rows are then split by
those bounds, so no task ever sees a whole hot group.  The sketch only steers the
split - the ranks and quantiles themselves are exact.

Ranks read their input more than once, and a float sum may differ in its last bit
between two evaluations, so their inputs (feature-sized tables) are checkpointed.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lamella.core import checkpointed

BUCKETS = 32
BUCKET_ROWS = 500_000


def tie_key(tie: Column) -> Column:
    """Deterministic uniform tie-break: the md5 text of the id."""
    return F.md5(tie.cast("string"))


def _bounds(df: DataFrame, keys: list[str], value: str, buckets: int) -> DataFrame:
    probs = [i / buckets for i in range(1, buckets)]
    return df.groupBy(*keys).agg(F.percentile_approx(value, probs, buckets * 8).alias("_b"))


def _attach(df: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    if keys:
        return df.join(small, keys, how)
    one = F.lit(1).alias("_one")
    return df.select("*", one).join(small.select("*", one), "_one", how).drop("_one")


def _split(df: DataFrame, keys: list[str], value: str, buckets: int) -> DataFrame:
    """``_k`` counts the bounds below the value, ``_t`` is 1 where the value is itself a bound."""
    v = F.col(value)
    return (_attach(df, _bounds(df, keys, value, buckets), keys)
            .withColumn("_k", F.size(F.filter("_b", lambda b: b < v)))
            .withColumn("_t", F.array_contains("_b", v).cast("int"))
            .drop("_b"))


def row_numbers(df: DataFrame, keys: list[str], value: str, tie: str, out: str = "rn",
                descending: bool = False, buckets: int | None = None) -> DataFrame:
    """Exact ``row_number`` by (value, md5(tie), tie) per group, in bounded tasks.

    The number of buckets grows with the table, by default one for every ``BUCKET_ROWS`` rows.
    Values that are bounds (heavy ties among them) form their own buckets and are
    split further by the leading hex digit of the tie key.
    """
    sign = -1 if descending else 1
    d = checkpointed(df)
    buckets = buckets or max(BUCKETS, -(-d.count() // BUCKET_ROWS))
    d = d.withColumn("_v", F.col(value) * sign).withColumn("_h", tie_key(F.col(tie)))
    d = _split(d, keys, "_v", buckets)
    d = d.withColumn("_s", F.when(F.col("_t") == 1, F.substring("_h", 1, 1)).otherwise(F.lit("")))
    cell = [*keys, "_k", "_t", "_s"]
    w_off = W.partitionBy(*keys).orderBy("_k", "_t", "_s").rowsBetween(W.unboundedPreceding, -1)
    offs = (d.groupBy(*cell).agg(F.count("*").alias("_n"))
            .withColumn("_off", F.coalesce(F.sum("_n").over(w_off), F.lit(0))).drop("_n"))
    w = W.partitionBy(*cell).orderBy("_v", "_h", tie)
    return (d.withColumn("_r", F.row_number().over(w)).join(offs, cell)
            .withColumn(out, (F.col("_r") + F.col("_off")).cast("bigint"))
            .drop("_v", "_h", "_k", "_t", "_s", "_r", "_off"))


def value_ranks(df: DataFrame, keys: list[str], value: str, buckets: int = BUCKETS) -> DataFrame:
    """Per distinct value of each group: ``n_less``, ``n_leq``, ``n_eq`` and average rank ``avg_rank``.

    Equal values are counted before the shuffle, so a value that fills a third of
    the table is one row here.
    """
    d = _split(df.where(F.col(value).isNotNull()).select(*keys, value), keys, value, buckets)
    cell = [*keys, "_k", "_t"]
    dist = d.groupBy(*cell, value).agg(F.count("*").alias("n_eq"))
    offs = (dist.groupBy(*cell).agg(F.sum("n_eq").alias("_n"))
            .withColumn("_off", F.coalesce(F.sum("_n").over(
                W.partitionBy(*keys).orderBy("_k", "_t").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
            .drop("_n"))
    run = W.partitionBy(*cell).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    return (dist.withColumn("_c", F.sum("n_eq").over(run)).join(offs, cell)
            .select(*keys, value, "n_eq",
                    (F.col("_off") + F.col("_c") - F.col("n_eq")).alias("n_less"),
                    (F.col("_off") + F.col("_c")).alias("n_leq"))
            .withColumn("avg_rank", (F.col("n_less") + F.col("n_leq") + 1) / 2.0))


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
              accuracy: int = 1000) -> DataFrame:
    """Exact linear-interpolated quantiles (type 7) per group of any size.

    A sketch brackets each wanted order statistic.  Rows inside a bracket (about
    ``8/accuracy`` of a big group) are shuffled as counts per value, the rows below
    it as one count, so the order statistics fall out of a short running sum.
    """
    v = F.col("_v")
    src = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    names = list(probs)
    eps = 4.0 / accuracy
    sk = src.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.percentile_approx("_v", [max(0.0, probs[n] - eps) for n in names], accuracy).alias("_lo"),
        F.percentile_approx("_v", [min(1.0, probs[n] + eps) for n in names], accuracy).alias("_hi"))
    small = F.col("_n") < 1500
    brackets = sk.select(*keys, F.array(*[F.struct(
        F.lit(i).alias("q"),
        F.when(small | F.lit(probs[n] <= eps), float("-inf")).otherwise(F.col("_lo")[i]).alias("lo"),
        F.when(small | F.lit(probs[n] >= 1 - eps), float("inf")).otherwise(F.col("_hi")[i]).alias("hi"),
        ((F.col("_n") - 1) * F.lit(float(probs[n]))).alias("pos")) for i, n in enumerate(names)]).alias("_br"))
    # a null _x stands for "below the bracket"
    hit = (_attach(src, brackets, keys)
           .select(*keys, "_v", F.explode(F.filter("_br", lambda b: v <= b["hi"])).alias("_b"))
           .select(*keys, F.col("_b.q").alias("_q"), F.col("_b.pos").alias("_pos"),
                   F.when(v >= F.col("_b.lo"), v).alias("_x"))
           .groupBy(*keys, "_q", "_pos", "_x").agg(F.count("*").alias("_c")))
    run = W.partitionBy(*keys, "_q").orderBy(F.asc_nulls_first("_x")).rowsBetween(W.unboundedPreceding, 0)
    hit = hit.withColumn("_z", F.sum("_c").over(run) - 1).withColumn("_a", F.col("_z") - F.col("_c") + 1)
    k = F.floor("_pos")
    at = lambda i, ix: F.max(F.when((F.col("_q") == i) & (F.col("_a") <= ix) & (ix <= F.col("_z")), F.col("_x")))
    cols = []
    for i, n in enumerate(names):
        frac = F.max(F.when(F.col("_q") == i, F.col("_pos") - k))
        lo, hi = at(i, k), at(i, F.ceil("_pos"))
        cols.append(F.when(frac == 0, lo).otherwise(lo + frac * (hi - lo)).alias(n))
    return hit.groupBy(*keys).agg(*cols)


def quantile_grid(df: DataFrame, keys: list[str], value: str, probs: list[float], out: str = "_q") -> DataFrame:
    """``keys`` and an array of the exact quantiles (type 7) at many ``probs``: the distinct values that hold a wanted order
    statistic are picked from their rank runs, so a value gives a row for each probability that falls on it."""
    r = value_ranks(df, keys, value)
    n = df.where(F.col(value).isNotNull()).groupBy(*keys).agg((F.count("*") - 1).alias("_n1"))
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    inside = lambda x: (x >= F.col("n_less")) & (x < F.col("n_leq"))
    pos = lambda g: g["p"] * F.col("_n1")
    d = r.join(n, keys).withColumn("_g", F.explode(F.filter(grid, lambda g: inside(F.floor(pos(g))) | inside(F.ceil(pos(g))))))
    at = F.col("_g.p") * F.col("_n1")
    d = d.groupBy(*keys, F.col("_g.i").alias("_i")).agg(F.max(F.when(inside(F.floor(at)), F.col(value))).alias("_lo"), F.max(F.when(inside(F.ceil(at)), F.col(value))).alias("_hi"),
                                                       F.max(at - F.floor(at)).alias("_frac"))
    d = d.select(*keys, "_i", F.when(F.col("_frac") == 0, F.col("_lo")).otherwise(F.col("_lo") + F.col("_frac") * (F.col("_hi") - F.col("_lo"))).alias("_x"))
    return d.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias(out))


def bh(df: DataFrame, p: str = "pval", keys: list[str] | None = None, out: str = "padj") -> DataFrame:
    """Benjamini-Hochberg adjusted p per group.  Ties share a value, so it works on distinct p."""
    keys = keys or []
    df = checkpointed(df)
    src = df
    if not keys:
        src = df.withColumn("_all", F.lit(1))
        keys = ["_all"]
    ranks = _split(src.where(F.col(p).isNotNull()).select(*keys, p), keys, p, BUCKETS)
    cell = [*keys, "_k", "_t"]
    dist = ranks.groupBy(*cell, p).agg(F.count("*").alias("_c"))
    tot = dist.groupBy(*cell).agg(F.sum("_c").alias("_n"))
    offs = tot.withColumn("_off", F.coalesce(F.sum("_n").over(
        W.partitionBy(*keys).orderBy("_k", "_t").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))) \
        .withColumn("_all_n", F.sum("_n").over(W.partitionBy(*keys))).drop("_n")
    run = W.partitionBy(*cell).orderBy(p).rowsBetween(W.unboundedPreceding, 0)
    adj = dist.withColumn("_cum", F.sum("_c").over(run)).join(offs, cell) \
        .withColumn("_raw", F.col(p) * F.col("_all_n") / (F.col("_off") + F.col("_cum")))
    # suffix minimum: inside the bucket, then over the later buckets
    later = adj.groupBy(*cell).agg(F.min("_raw").alias("_m")) \
        .withColumn("_later", F.min("_m").over(
            W.partitionBy(*keys).orderBy("_k", "_t").rowsBetween(1, W.unboundedFollowing))).drop("_m")
    back = W.partitionBy(*cell).orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, 0)
    adj = adj.withColumn("_in", F.min("_raw").over(back)).join(later, cell) \
        .select(*keys, p, F.least(F.col("_in"), F.coalesce("_later", "_in"), F.lit(1.0)).alias(out))
    return src.join(adj, [*keys, p], "left").drop("_all")
