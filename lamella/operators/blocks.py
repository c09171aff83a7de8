"""Work over pairs of features without a pair table.

Features are hashed into blocks of bounded size; each unordered (or ordered)
pair of blocks is one task that sees two small matrices and returns only the
rows its function selects.  A pair of features never becomes a row by itself.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lamella.core import checkpointed

BLOCK = 512


def n_blocks(vecs: DataFrame, block: int = BLOCK) -> int:
    return max(1, -(-vecs.count() // block))


def block_ids(vecs: DataFrame, blocks: int) -> DataFrame:
    return vecs.withColumn("_b", F.pmod(F.xxhash64("layer", "feature"), F.lit(blocks)).cast("int"))


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.vstack(pdf["vec"].to_numpy()) if len(pdf) else np.empty((0, 0))


def pair_blocks(left: DataFrame, right: DataFrame | None, fn: Callable, schema: str, block: int = BLOCK,
                blocks: int | None = None) -> DataFrame:
    """Run ``fn(lkeys, lmat, rkeys, rmat, same)`` on every pair of blocks.

    Both inputs hold ``layer, feature, vec``.  With ``right`` None the pairs are
    unordered and ``same`` marks a block met with itself.  Keys are lists of
    (layer, feature).  ``fn`` returns a pandas frame in ``schema``.  The vectors are
    written once: they are counted and read by both sides.
    """
    left = checkpointed(left.select("layer", "feature", "vec"))
    right = None if right is None else checkpointed(right.select("layer", "feature", "vec"))
    nb = blocks or n_blocks(left, block)
    nr = nb if right is None else (blocks or n_blocks(right, block))
    cols = ["layer", "feature", "vec"]
    lo = F.col("_b") if right is None else F.lit(0)
    a = block_ids(left.select(*cols), nb).withColumn("_j", F.explode(F.sequence(lo, F.lit(nr - 1)))) \
        .withColumnRenamed("_b", "_i")
    b = block_ids((left if right is None else right).select(*cols), nr)
    hi = F.col("_b") if right is None else F.lit(nb - 1)
    b = b.withColumn("_i", F.explode(F.sequence(F.lit(0), hi))).withColumnRenamed("_b", "_j")
    b = b.toDF(*b.columns)  # fresh attributes: both sides may come from one frame
    self_join = right is None

    def run(key: tuple, l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c.split()[0]: pd.Series([], dtype=object) for c in schema.split(",")})
        if l.empty or r.empty:
            return none
        l, r = l.sort_values(["layer", "feature"]), r.sort_values(["layer", "feature"])
        out = fn(list(zip(l["layer"], l["feature"])), _matrix(l), list(zip(r["layer"], r["feature"])), _matrix(r),
                 self_join and key[0] == key[1])
        return out if len(out) else none

    return a.groupBy("_i", "_j").cogroup(b.groupBy("_i", "_j")).applyInPandas(run, schema)


def fold_rows(vecs: DataFrame, fn: Callable[[pd.DataFrame], dict[str, np.ndarray]], slots: int = 16) -> dict[str, np.ndarray]:
    """Sum arrays of a bounded, sample-space shape over all feature rows.

    ``fn`` maps one Arrow batch to named arrays.  Each task adds up its batches;
    the parts are added in ``slots`` groups per name, then on the driver.
    """
    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for pdf in it:
            if len(pdf):
                for k, v in fn(pdf).items():
                    total[k] = v if k not in total else total[k] + v
        if total:
            slot = TaskContext.get().partitionId() % slots
            yield pd.DataFrame({"name": list(total), "slot": slot,
                                "shape": [list(np.shape(v)) for v in total.values()],
                                "data": [np.ravel(v).astype(float) for v in total.values()]})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"name": [key[0]], "slot": [key[1]], "shape": [pdf["shape"].iloc[0]],
                             "data": [np.sum(np.vstack(pdf["data"].to_numpy()), axis=0)]})

    schema = "name string, slot int, shape array<int>, data array<double>"
    parts = vecs.mapInPandas(part, schema)
    out: dict[str, np.ndarray] = {}
    for r in parts.groupBy("name", "slot").applyInPandas(add, schema).collect():
        x = np.array(r["data"]).reshape(tuple(r["shape"]))
        out[r["name"]] = x if r["name"] not in out else out[r["name"]] + x
    return out
