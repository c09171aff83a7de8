"""Exact deduplication by skew-safe combining.

1. Each task deduplicates what it reads (the partial aggregate under the first exchange).
2. Groups of a digest are dealt over ``salts`` salts and merged, (digest, content, salt) by (digest, content, salt).
3. The winners of the salts are merged per (digest, content).

The content is part of the grouping key at every stage, so a digest that two contents share is two groups.  Copies of a
text, be they a third of all rows, reach an exchange as at most one row for each task and salt.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lamella.llm.common import ascii_lower, written


def normalised(text: Column | str) -> Column:
    """Null counts as empty; A-Z become a-z."""
    return F.coalesce(ascii_lower(text), F.lit(""))


def text_digest(norm: Column) -> Column:
    return F.sha2(norm, 256)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 8, digest=text_digest) -> DataFrame:
    """``digest, norm, keep_id, group_size``: one row for each different text; the largest id is kept.

    An empty table gives no rows; a group of null ids only has a null ``keep_id``.
    """
    d = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    # dealt by a hash of the id, so that reruns deal alike
    d = d.select("id", "norm", digest(F.col("norm")).alias("digest"), F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
    salted = d.groupBy("digest", "norm", "salt").agg(F.max("id").alias("id"), F.count("*").alias("n"))
    return salted.groupBy("digest", "norm").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 8, digest=text_digest) -> DataFrame:
    """One row for each row of ``docs``: ``id_col, digest, keep_id, group_size, kept``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty; other columns are ignored.  The row with
    the largest id of a group is kept; repeated rows of that id are all marked kept.  A null id loses to any other, and a
    group of null ids only keeps them all.

    Rows find their group by digest.  Should a digest stand for several contents, its rows find it by content as well.
    """
    g = groups(docs, id_col, text_col, salts, digest)
    per_digest = written(g.groupBy("digest").agg(
        F.count("*").alias("contents"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")))
    norm = normalised(text_col)
    d = docs.select(F.col(id_col), norm.alias("_norm")).select(id_col, "_norm", digest(F.col("_norm")).alias("digest"))
    one = d.select(id_col, "digest").join(per_digest.where("contents = 1").drop("contents"), "digest")
    shared = per_digest.where("contents > 1").select("digest")
    if not shared.isEmpty():
        those = g.join(shared, "digest", "left_semi").withColumnRenamed("norm", "_norm")
        one = one.unionByName(d.join(those, ["digest", "_norm"]).drop("_norm"))
    return one.select(id_col, "digest", "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"))

