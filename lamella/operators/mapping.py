"""Identifier mapping and roll-up (inventory section G).

Dimension tables are joined by equality; the engine decides from their measured
size whether to broadcast them.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lamella.core import CELL, FEATURE
from lamella.operators.quality import collapse_features

RANKS_7 = ["Kingdom", "Phylum", "Class", "Order", "Family", "Genus", "Species"]
RANKS_6 = RANKS_7[1:]
#: Cells that one task of a roll-up takes, about.
CELLS_PER_TASK = 200_000


def first_match(id_map: DataFrame, key: str = "id", target: str = "target", order: str | None = None) -> DataFrame:
    """One target per key: the first by ``order`` (or by target)."""
    return id_map.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(target, order or target).alias(target))


def bare_accession(c: Column) -> Column:
    """Accession without its version suffix."""
    return F.regexp_replace(c, r"\.\d+$", "")


def map_ids(m: DataFrame, id_map: DataFrame, source: str, how: str = "max", versioned: bool = False,
            min_share: float = 0.3) -> DataFrame:
    """Replace feature ids by mapped ids, drop the unmapped, collapse duplicates on the mapped id.

    ``id_map``: ``source, id, target``.  Fails when under ``min_share`` of the features map.
    """
    one = first_match(id_map.where(F.col("source") == source).select("id", "target"))
    f = m.select(*FEATURE).distinct().withColumn("id", bare_accession(F.col("feature")) if versioned else F.col("feature"))
    f = f.join(one, "id", "left")
    share = f.groupBy("layer").agg((F.count("target") / F.count("*")).alias("_s")).select(
        "layer", F.when(F.col("_s") < min_share, F.raise_error(F.lit("too few ids mapped")).cast("boolean")).otherwise(F.lit(True)).alias("_ok"))
    f = f.where(F.col("target").isNotNull()).join(share.where("_ok"), "layer")
    d = m.join(f.select(*FEATURE, "target"), FEATURE).select("layer", F.col("target").alias("feature"), "sample", "value")
    return collapse_features(d, how)


def label_ids(df: DataFrame, id_map: DataFrame, col: str = "feature", out: str = "label") -> DataFrame:
    """Attach the label of an id, the id itself where there is none."""
    one = first_match(id_map.select(F.col("id").alias(col), F.nullif(F.col("target"), F.lit("")).alias("_t")), col, "_t")
    return df.join(one, col, "left").withColumn(out, F.coalesce("_t", F.col(col))).drop("_t")


def short_hmdb(c: Column) -> Column:
    """The five-digit form of an HMDB accession."""
    return F.concat(F.lit("HMDB"), F.right(F.regexp_replace(c, "^HMDB", ""), F.lit(5)))


def _lookup(df: DataFrame, db: DataFrame, key: Column, i: int) -> DataFrame:
    k = db.select(F.lower(key).alias("_k"), F.struct("idx", "name").alias("_hit")).where(F.col("_k").isNotNull()) \
        .groupBy("_k").agg(F.min("_hit").alias(f"_h{i}"))
    return df.join(k, F.lower("query") == F.col("_k"), "left").drop("_k")


def map_compounds(df: DataFrame, db: DataFrame, kind: str) -> DataFrame:
    """Case-insensitive exact match of ``query``; ``db``: ``idx, name, hmdb, kegg, pubchem, chebi, metlin``."""
    keys = {"hmdb": [F.col("hmdb"), short_hmdb(F.col("hmdb"))], "pubchem": [F.col("pubchem")], "chebi": [F.col("chebi")],
            "metlin": [F.col("metlin")], "kegg": [F.col("kegg")], "name": [F.col("name")]}.get(kind, [F.col("hmdb"), F.col("kegg")])
    for i, k in enumerate(keys):
        df = _lookup(df, db, k, i)
    hit = F.coalesce(*[F.col(f"_h{i}") for i in range(len(keys))])
    return df.withColumn("idx", hit["idx"]).withColumn("match", hit["name"]).drop(*[f"_h{i}" for i in range(len(keys))]) \
        .withColumn("state", F.col("idx").isNotNull().cast("int"))


def map_synonyms(df: DataFrame, syn: DataFrame) -> DataFrame:
    """First compound in table order that lists the query as a synonym; ``syn``: ``idx, name, synonym``."""
    s = syn.groupBy(F.lower("synonym").alias("_k")).agg(F.min(F.struct("idx", "name")).alias("_h"))
    return (df.join(s, F.lower("query") == F.col("_k"), "left")
            .select(*df.columns, F.col("_h.idx").alias("idx"), F.col("_h.name").alias("match")))


def fuzzy_match(df: DataFrame, syn: DataFrame, k: int = 10) -> DataFrame:
    """Closest names at edit tolerance 0, 0.1 or 0.2 of the query length (whole names, not substrings).

    A query allowing d edits is cut into d + 1 pieces, one of which a match must hold
    unchanged within d positions; pieces are the equi-join key, so no candidate is
    lost and no all-pairs comparison happens.  The lowest tolerance that finds any
    candidate counts, the best ``k`` are kept.
    """
    q = df.select("query").distinct().withColumn("_q", F.lower("query")).withColumn("_n", F.length("_q")) \
        .withColumn("_d", F.ceil(F.col("_n") * 0.2).cast("int")).where("_n > 0")
    seg = q.withColumn("_i", F.explode(F.expr("sequence(0, _d)"))) \
        .withColumn("_a", F.expr("cast(floor(_i * _n / (_d + 1)) as int)")) \
        .withColumn("_z", F.expr("cast(floor((_i + 1) * _n / (_d + 1)) as int)")) \
        .withColumn("_p", F.expr("substring(_q, _a + 1, _z - _a)"))
    lens = q.select("_n", "_d").distinct()
    t = syn.select("idx", "name", "synonym").distinct().withColumn("_t", F.lower("synonym")).withColumn("_l", F.length("_t"))
    t = (t.withColumn("_n", F.explode(F.expr("sequence(cast(greatest(1, floor(_l / 1.2) - 1) as int), cast(ceil(_l / 0.8) + 1 as int))")))
         .join(lens, "_n").where(F.abs(F.col("_n") - F.col("_l")) <= F.col("_d"))
         .withColumn("_i", F.explode(F.expr("sequence(0, _d)")))
         .withColumn("_a", F.expr("cast(floor(_i * _n / (_d + 1)) as int)"))
         .withColumn("_w", F.expr("cast(floor((_i + 1) * _n / (_d + 1)) as int) - _a"))
         .withColumn("_s", F.explode(F.expr("sequence(greatest(0, _a - _d), greatest(0, least(_a + _d, _l - _w)))")))
         .withColumn("_p", F.expr("substring(_t, _s + 1, _w)")).where(F.length("_p") == F.col("_w"))
         .select("idx", "name", "synonym", "_t", "_l", "_n", "_i", "_p").distinct())
    c = seg.join(t, ["_n", "_i", "_p"]).select("query", "_q", "_n", "_d", "idx", "name", "_t", "_l").distinct()
    dist = F.expr("levenshtein(_q, _t)")
    c = c.withColumn("distance", dist).where(F.col("distance") <= F.col("_d"))
    tol = F.when(F.col("distance") == 0, 0.0).when(F.col("distance") <= F.ceil(F.col("_n") * 0.1), 0.1).otherwise(0.2)
    pre = F.substring("_q", 1, 2) == F.substring("_t", 1, 2)
    c = c.withColumn("_tol", tol).withColumn(
        "score", F.col("_tol") + F.abs(F.col("_l") - F.col("_n")) / (10 * F.col("_n")) - F.when(pre, 0.05).otherwise(0.0))
    best = c.groupBy("query").agg(F.min("_tol").alias("_best"))
    c = c.join(best, "query").where(F.col("_tol") == F.col("_best")).groupBy("query", "idx", "name").agg(F.min("score").alias("score"))
    w = W.partitionBy("query").orderBy("score", "idx")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mapping_report(df: DataFrame, col: str = "idx") -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count(col).alias("mapped")) \
        .withColumn("over_half_unmatched", (F.col("n") - F.col("mapped")) / F.col("n") > 0.5) \
        .withColumn("over_15_unmatched", (F.col("n") - F.col("mapped")) > 15)


def parse_taxa(df: DataFrame, ranks: list[str] | None = None) -> DataFrame:
    """``feature, rank, taxon`` from ``a;b;c`` lineages (column ``lineage``); ranks with no value at all are dropped."""
    ranks = ranks or RANKS_7
    parts = F.split(F.regexp_replace("lineage", r";\s;", ";"), ";")
    d = df.select("feature", F.explode(F.arrays_zip(
        F.array(*[F.lit(r) for r in ranks]).alias("rank"),
        F.array(*[F.get(parts, F.lit(i)) for i in range(len(ranks))]).alias("raw"))).alias("_x")).select("feature", "_x.rank", "_x.raw")
    used = d.where(F.col("raw").isNotNull()).select("rank").distinct()
    # fixed value: the rank prefixes of the format, "k__" or "k_"
    t = F.regexp_replace("raw", r"^\s*[a-z]__?", "")
    return d.join(used, "rank", "left_semi").select(
        "feature", "rank", F.when(t.isNull() | t.isin("", "NA"), "Not_Assigned").otherwise(t).alias("taxon"))


def rollup_taxa(m: DataFrame, taxa: DataFrame) -> DataFrame:
    """Counts summed to each rank: ``layer, rank, feature (taxon), sample, value``.

    Taxa of one sample lie in features of all tasks, so what a task sums before the shuffle is nearly as long as its input times
    the ranks; tasks therefore get a bounded number of cells.  There the taxa are joined by a merge: a row for each feature and rank
    is many times what the engine expects from the size of a lineage file, and would be sent to every task.
    """
    cells = m.count()
    if cells > CELLS_PER_TASK:
        m = m.repartition(max(-(-cells // CELLS_PER_TASK), int(m.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "feature")
        taxa = taxa.hint("merge")
    return (m.join(taxa, "feature").groupBy("layer", "rank", F.col("taxon").alias("feature"), "sample")
            .agg(F.sum("value").alias("value")))


def microbe_metabolite(edges: DataFrame, ref: DataFrame, metabolites: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Reference pairs above a potential whose metabolite is measured, flagged where a positive edge links them.

    ``ref``: ``taxon, met_id, metabolite, kegg, hmdb, potential``; ``metabolites``: ``name, kegg, hmdb``;
    ``edges``: ``src, dst, weight`` with the taxon and the metabolite name at the ends.
    """
    r = ref.where(F.col("potential") >= threshold)
    hits = [r.join(metabolites.select(F.col("name").alias("_n"), F.col(c).alias("_k")).where(F.col(c).isNotNull()),
                   F.col(rc) == F.col("_k")).select("taxon", F.col("_n").alias("name"), "potential")
            for rc, c in (("metabolite", "name"), ("kegg", "kegg"), ("hmdb", "hmdb"))]
    p = reduce(DataFrame.unionByName, hits).groupBy("taxon", "name").agg(F.max("potential").alias("potential"))
    e = edges.where("weight > 0")
    both = e.select(F.col("src").alias("taxon"), F.col("dst").alias("name"), "weight").unionByName(
        e.select(F.col("dst").alias("taxon"), F.col("src").alias("name"), "weight"))
    e = both.groupBy("taxon", "name").agg(F.max("weight").alias("weight"))
    return p.join(e, ["taxon", "name"], "left").withColumn("highlight", F.col("weight").isNotNull())


def map_mirna(df: DataFrame, ref: DataFrame) -> DataFrame:
    """Ids or accessions to ``mir_id, mir_acc``, one row per accession."""
    a = df.join(ref, F.lower("query") == F.lower("mir_id")).select("query", "mir_id", "mir_acc")
    b = df.join(ref, F.lower("query") == F.lower("mir_acc")).select("query", "mir_id", "mir_acc")
    return a.unionByName(b).groupBy("mir_acc").agg(F.min_by("query", "query").alias("query"), F.min_by("mir_id", "query").alias("mir_id"))


def custom_signature(comp: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of a comparison result whose feature or label is listed (``ids``: ``id``)."""
    l = ids.select("id").distinct()
    by_id = comp.join(l, F.col("feature") == F.col("id"), "left_semi")
    if "label" not in comp.columns:
        return by_id
    return by_id.unionByName(comp.join(l, F.col("label") == F.col("id"), "left_semi")).distinct()
