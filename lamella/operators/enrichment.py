"""Set enrichment (inventory section M).  ``sets``: ``set_id, set_name, member``; ``ids``: ``id``."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from lamella.core import FEATURE, bounded
from lamella.functions.ranking import bh, row_numbers
from lamella.functions.special import hyper_pvalue, normal_quantile, normal_upper

MAX_RANKED = 2_000_000


def set_hits(ids: DataFrame, sets: DataFrame) -> DataFrame:
    """Per set: size, hits, universe, drawn and expected hits; counts only, members are not gathered."""
    s = sets.select("set_id", "set_name", "member").distinct()
    uni = s.select("member").distinct()
    q = ids.select(F.col("id").alias("member")).distinct().join(uni, "member", "left_semi").withColumn("_hit", F.lit(1))
    one = F.lit(1).alias("_one")
    n = uni.agg(F.count("*").alias("universe")).select("*", one).join(q.agg(F.count("*").alias("drawn")).select("*", one), "_one")
    g = s.join(q, "member", "left").groupBy("set_id", "set_name").agg(F.count("*").alias("total"), F.count("_hit").alias("hits"))
    return g.select("*", one).join(n, "_one").drop("_one").withColumn("expected", F.col("total") * F.col("drawn") / F.col("universe"))


def ora(ids: DataFrame, sets: DataFrame, min_size: int = 1, exclude: list[str] | None = None, select: bool = False) -> DataFrame:
    """Over-representation: P(X >= hits), BH over all sets, sets without hits dropped.

    ``select`` applies the reporting rule: the sets at p <= 0.05 (at most 120), or the
    top ten when fewer than ten pass.
    """
    if exclude:
        sets = sets.where(~F.col("set_id").isin(exclude))
    if min_size > 1:
        big = sets.groupBy("set_id").agg(F.count_distinct("member").alias("_n")).where(F.col("_n") >= min_size)
        sets = sets.join(big, "set_id", "left_semi")
    d = set_hits(ids, sets)
    d = bh(d.withColumn("pval", hyper_pvalue("hits", "total", "universe", "drawn"))).where("hits > 0")
    if not select:
        return d
    r = row_numbers(d.withColumn("_one", F.lit(1)), ["_one"], "pval", "set_id", "rank")
    n = r.groupBy("_one").agg(F.count_if(F.col("pval") <= 0.05).alias("_sig"))
    r = r.join(n, "_one")
    return r.where(F.when(F.col("_sig") < 10, F.col("rank") <= 10).otherwise((F.col("pval") <= 0.05) & (F.col("rank") <= 120))).drop("_one", "_sig")


def ora_joint(a: DataFrame, b: DataFrame) -> DataFrame:
    """Weighted Stouffer combination of two over-representation results; one p alone where the other has no hit.

    The weight of a side is its hits over its universe.
    """
    pick = lambda d, i: d.select("set_id", F.col("pval").alias(f"p{i}"), F.col("hits").alias(f"hits{i}"), (F.col("hits") / F.col("universe")).alias(f"w{i}"))
    j = pick(a, 1).join(pick(b, 2), "set_id", "full")
    clip = lambda c: F.greatest(F.lit(1e-300), F.least(F.lit(1 - 1e-16), F.col(c)))
    z = (F.col("w1") * -normal_quantile(clip("p1")) + F.col("w2") * -normal_quantile(clip("p2"))) / F.sqrt(F.col("w1") ** 2 + F.col("w2") ** 2)
    j = j.withColumn("pval", F.when(F.col("p1").isNull(), F.col("p2")).when(F.col("p2").isNull(), F.col("p1")).otherwise(normal_upper(z)))
    return bh(j)


# ---- preranked -----------------------------------------------------------------------------

def ranking(df: DataFrame, id_col: str, value: str) -> DataFrame:
    """``id, stat``: duplicates resolved by the largest absolute value."""
    return df.where(F.col(value).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max_by(value, F.abs(value)).alias("stat"))


def enrichment_scores(ranked: DataFrame, sets: DataFrame, min_size: int = 15, max_size: int = 500, score: str = "std") -> DataFrame:
    """Running-sum score of each set, from its hits only (a set holds at most ``max_size``)."""
    r = row_numbers(ranked.withColumn("_one", F.lit(1)), ["_one"], "stat", "id", "pos", descending=True)
    n = r.groupBy("_one").agg(F.count("*").alias("N"))
    h = r.join(n, "_one").join(sets.select("set_id", F.col("member").alias("id")).distinct(), "id")
    size = h.groupBy("set_id").agg(F.count("*").alias("size"), F.sum(F.abs("stat")).alias("nr")).where((F.col("size") >= min_size) & (F.col("size") <= max_size))
    w = W.partitionBy("set_id").orderBy("pos")
    h = h.join(size, "set_id").withColumn("i", F.row_number().over(w)).withColumn("cum", F.sum(F.abs("stat")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    miss = (F.col("pos") - F.col("i")) / (F.col("N") - F.col("size"))
    h = h.withColumn("up", F.col("cum") / F.col("nr") - miss).withColumn("down", (F.col("cum") - F.abs("stat")) / F.col("nr") - miss)
    g = h.groupBy("set_id").agg(F.first("size").alias("size"), F.max("up").alias("_u"), F.min("down").alias("_d"))
    es = {"std": F.when(F.col("_u") >= -F.col("_d"), F.col("_u")).otherwise(F.col("_d")), "pos": F.col("_u"), "neg": F.col("_d")}[score]
    return g.select("set_id", "size", es.alias("es"))


def gsea(ranked: DataFrame, sets: DataFrame, nperm: int = 1000, min_size: int = 15, max_size: int = 500, score: str = "std", seed: int = 1) -> DataFrame:
    """NES, p and BH.  Null scores depend on the set size only: (size, permutation block) pairs are the distributed work."""
    es = enrichment_scores(ranked, sets, min_size, max_size, score)
    for lower in (5, 1):
        if min_size > lower and es.isEmpty():
            es = enrichment_scores(ranked, sets, lower, max_size, score)
    spark = ranked.sparkSession
    stats = np.sort(np.array([r[0] for r in bounded(ranked.select("stat"), MAX_RANKED, "ranked list")], float))[::-1]
    shared = spark.sparkContext.broadcast(np.abs(stats))
    sizes = sorted(r[0] for r in es.select("size").distinct().collect())
    blocks = min(10, nperm)
    tasks = spark.createDataFrame([(s, b) for s in sizes for b in range(blocks)], "size int, block int").repartition(32)

    def run(it):
        w = shared.value
        n = len(w)
        for pdf in it:
            rows = []
            for size, block in pdf.itertuples(index=False):
                rng = np.random.default_rng([seed, size, block])
                for _ in range(nperm * (block + 1) // blocks - nperm * block // blocks):
                    pos = np.sort(rng.choice(n, size, replace=False))
                    x = w[pos]
                    cum = np.cumsum(x)
                    miss = (pos - np.arange(size)) / max(n - size, 1)
                    nr = cum[-1] or 1.0
                    u, d = (cum / nr - miss).max(), ((cum - x) / nr - miss).min()
                    rows.append((size, {"std": u if u >= -d else d, "pos": u, "neg": d}[score]))
            yield pd.DataFrame(rows, columns=["size", "null"])

    null = tasks.mapInPandas(run, "size int, null double")
    j = es.join(null, "size")
    same = F.signum("null") * F.signum("es") >= 0
    j = j.groupBy("set_id", "size", "es").agg(F.count_if(same).alias("_n"), F.count_if(same & (F.abs("null") >= F.abs("es"))).alias("_x"),
                                              F.avg(F.when(same, F.abs("null"))).alias("_m"))
    d = j.select("set_id", "size", "es", (F.col("es") / F.col("_m")).alias("nes"), ((F.col("_x") + 1) / (F.col("_n") + 1)).alias("pval"))
    return bh(d)


def select_gsea(res: DataFrame, p: float = 0.05, top: int = 20) -> DataFrame:
    """Significant sets, or the ``top`` by p when fewer than that many are."""
    r = row_numbers(res.withColumn("_one", F.lit(1)), ["_one"], "pval", "set_id", "rank")
    n = r.groupBy("_one").agg(F.count_if(F.col("pval") <= p).alias("_s"))
    return r.join(n, "_one").where(F.when(F.col("_s") < top, F.col("rank") <= top).otherwise(F.col("pval") <= p)).drop("_one", "_s")


def normalize_ids(df: DataFrame, maps: list[DataFrame], col: str = "id") -> DataFrame:
    """KEGG-like ids lose their prefix; otherwise the first map (``id, target``) that knows the id decides; else the id."""
    bare = F.regexp_extract(col, r"^(?:cpd:|ko:|[a-z]{3}:)?(.+)$", 1)
    d = df.withColumn("_b", bare)
    hits = []
    for i, mp in enumerate(maps):
        one = mp.groupBy(F.lower("id").alias("_k")).agg(F.min("target").alias(f"_t{i}"))
        d = d.join(one, F.lower("_b") == F.col("_k"), "left").drop("_k")
        hits.append(F.col(f"_t{i}"))
    kegg = F.when(F.col("_b").rlike(r"^[CDGK]\d{5}$"), F.col("_b"))
    return d.withColumn("mapped", F.coalesce(kegg, *hits, F.col("_b"))).drop("_b", *[f"_t{i}" for i in range(len(maps))])


def set_network(sets: DataFrame, hits: DataFrame, how: str = "mixed", t: float = 0.3) -> DataFrame:
    """Overlap of the reported sets (``hits``: set_id, at most 120): edges at or above ``t``."""
    few = hits.select("set_id").distinct()
    m = sets.join(few, "set_id", "left_semi").select("set_id", "member").distinct()
    n = m.groupBy("set_id").agg(F.count("*").alias("n"))
    both = (m.withColumnRenamed("set_id", "set1").join(m.withColumnRenamed("set_id", "set2"), "member").where("set1 < set2")
            .groupBy("set1", "set2").agg(F.count("*").alias("shared")))
    d = both.join(n.toDF("set1", "n1"), "set1").join(n.toDF("set2", "n2"), "set2")
    sh, n1, n2 = F.col("shared"), F.col("n1"), F.col("n2")
    w = {"mixed": (sh / n1 + sh / n2) / 2, "overlap": sh / F.least(n1, n2), "jaccard": sh / (n1 + n2 - sh)}[how]
    return d.select("set1", "set2", "shared", w.alias("weight")).where(F.col("weight") >= t)


def bipartite(sets: DataFrame, hits: DataFrame, ids: DataFrame) -> DataFrame:
    """Set-member edges of the reported sets and the query."""
    return sets.join(hits.select("set_id"), "set_id", "left_semi").join(ids.select(F.col("id").alias("member")), "member", "left_semi") \
        .select("set_id", "member").distinct()


def query_list(sig: DataFrame | None = None, load: DataFrame | None = None, layers: list[str] | None = None, factor: int = 1, percent: float = 10.0) -> DataFrame:
    """Significant ids of the chosen layers, or the top x% by absolute loading on a factor."""
    if sig is not None:
        d = sig if layers is None else sig.where(F.col("layer").isin(layers))
        return d.select("layer", F.col("feature").alias("id")).distinct()
    d = load.where(F.col("factor") == factor)
    if layers is not None:
        d = d.where(F.col("layer").isin(layers))
    r = row_numbers(d.withColumn("_a", F.abs("value")), ["layer"], "_a", "feature", descending=True)
    n = r.groupBy("layer").agg(F.count("*").alias("_n"))
    return r.join(n, "layer").where(F.col("rn") <= F.ceil(F.col("_n") * percent / 100)).select("layer", F.col("feature").alias("id"))


def hit_table(comp: DataFrame, sets: DataFrame) -> DataFrame:
    """Hits of each set and layer with the sign of the coefficient."""
    return (comp.join(sets.select("set_id", F.col("member").alias("feature")).distinct(), "feature").groupBy("set_id", "layer")
            .agg(F.count("*").alias("hits"), F.count_if(F.col("coef") > 0).alias("up"), F.count_if(F.col("coef") < 0).alias("down")))
