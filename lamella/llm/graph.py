"""Connected components of an edge table by contraction."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lamella.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``id, comp`` for every node of ``edges`` (``a``, ``b``): ``comp`` is the smallest id reachable.

    Each round hooks a node to its smallest neighbour, follows the hooks to their roots and contracts.  Neighbours are only
    ever reduced by ``min`` (combined before the exchange), so a node with a third of all edges costs one row for each task.
    Runs until no edge is left; the number of edges falls every round.
    """
    edges = written(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")).withColumnRenamed("a", "id")
        hook = written(hook)
        while True:  # follow hooks; chains halve
            up = hook.select(F.col("id").alias("p"), F.col("p").alias("pp"))
            nxt = written(hook.join(up, "p").select("id", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            hook = nxt.select("id", "p")
            if nxt.where("moved").isEmpty():
                break
        found = hook if found is None else written(
            found.join(hook.select(F.col("id").alias("p"), F.col("p").alias("pp")), "p", "left").select("id", F.coalesce("pp", "p").alias("p")))
        x, y = hook.select(F.col("id").alias("a"), F.col("p").alias("pa")), hook.select(F.col("id").alias("b"), F.col("p").alias("pb"))
        rest = (edges.join(x, "a").select("pa", "b").join(y, "b").where("pa != pb")
                .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        edges = written(rest)
        if edges.isEmpty():
            return found.select("id", F.col("p").alias("comp"))
