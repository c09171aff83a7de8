"""Mixing sources to target weights by fixed-length blocks.

A source's documents, in a fixed order, are one stream of words cut into blocks of ``block`` words.  The mix is a row of
slots, dealt to output shards: a shard draws how many of its slots each source gets (multinomial, settled so that the totals
of all shards meet the targets), slot number j of a source is mapped through the source's pseudorandom permutation of its
block numbers, and slots are joined to blocks by that number.  Every pass over a permutation takes each block once, so no
block is taken more often than its source's passes, rounded up.
"""
from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lamella.llm.common import WORD, n_parts, small_batches, written

WEIGHTS = (3, 1, 2)
#: Slots in a deck; totals are dealt to decks evenly. The library draws from fewer than 10^9.
DECK = 1 << 29


def word_count(text: Column | str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (one row for each source).

    Sources by code point, null last, take ``weights`` in turn and share ``share`` of all sizes by weight; a target stops at
    ``most`` times its source's size and the excess is shared again by weight until none is above.  That end is found at
    once: sources are filled in the order of cap over weight, and the level is the one of the first that isn't full.
    One row for each source goes through one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    d = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    full = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    d = d.withColumn("level", (F.sum("source_size").over(every) * share - full) / left)
    d = d.withColumn("open", F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("level"))))
    # the first source whose cap lies above the level sets it for itself and all after it
    first = F.min("open").over(every)
    level = F.when(first.isNotNull() & (F.col("ratio") >= first["ratio"]), first["level"] * F.col("w")).otherwise(F.col("cap"))
    return d.select("source", "source_size", F.least(level, F.col("cap")).alias("target"))


def permuted(j: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n-1 for each key, at j: a Feistel network over the next power of four, walked until it falls inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, key, n = j.astype(np.uint64), key.astype(np.int64).view(np.uint64), n.astype(np.uint64)
    out = np.zeros(len(x), np.uint64)
    todo = np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            h, m, k = half[todo], mask[todo], key[todo]
            left, right = x[todo] >> h, x[todo] & m
            for r in range(rounds):
                f = (right + k + np.uint64(r) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
                f ^= f >> np.uint64(29)
                f *= np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((f >> np.uint64(32)) & m)
            x[todo] = (left << h) | right
            inside = x[todo] < n[todo]
            out[todo[inside]] = x[todo[inside]]
            todo = todo[~inside]
    return out.astype(np.int64)


def placed(docs: DataFrame, per_bucket: int = 4096) -> DataFrame:
    """``docs`` (``id, source, size``, other columns) with ``first``, the words of its source before it.

    The order inside a source is that of hashed buckets, then id.  A source is never ordered in one task: only the sums of
    its buckets are.
    """
    d = written(docs)
    buckets = n_parts(d.count(), per_bucket)
    d = d.withColumn("_b", F.pmod(F.xxhash64("id", "source"), F.lit(buckets)).cast("int"))
    sums = d.groupBy("source", "_b").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = written(sums.withColumn("_ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).select(F.col("source").alias("_s"), F.col("_b").alias("_sb"), "_ahead"))
    own = Window.partitionBy("_b", "source").orderBy("id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("size").over(own), F.lit(0)))
    d = d.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_sb")))
    return d.withColumn("first", F.col("_ahead") + F.col("_in")).drop("_b", "_in", "_s", "_sb", "_ahead")


def slots(plan: DataFrame, per_shard: int, seed: int) -> DataFrame:
    """``shard, source_no, index, pass``: the block that each slot of the mix takes.

    ``plan``: ``source_no, blocks, slots`` of the sources that have slots, one small row for each source.  A shard's counts
    are a multinomial draw under the condition that the counts of all shards meet the totals, and the same on every run: a
    deck of shards is split in halves, and what a half gets of each source is drawn (hypergeometric, the conditional
    multinomial) from the seed and the place of the half, so a task finds its shard's counts and first slots in
    log2(shards) steps.
    """
    spark = plan.sparkSession
    rows = plan.orderBy("source_no").toPandas()
    no, blocks, total = (rows[c].to_numpy(np.int64) for c in ("source_no", "blocks", "slots"))
    n = int(total.sum())
    if not n:
        return spark.createDataFrame([], "shard long, source_no long, index long, pass long")
    decks = n_parts(n, DECK)
    per_deck = n_parts(-(-n // decks) + len(no), per_shard)

    def counts(shard: int) -> tuple[np.ndarray, np.ndarray]:
        deck, place = divmod(shard, per_deck)
        first = total * deck // decks
        have = total * (deck + 1) // decks - first
        end = int(have.sum())
        lo, hi = 0, per_deck
        while hi - lo > 1:
            mid = (lo + hi) // 2
            size = min(mid * per_shard, end) - min(lo * per_shard, end)
            left = np.random.default_rng([seed, deck, lo, hi]).multivariate_hypergeometric(have, size, method="marginals")
            if place < mid:
                hi, have = mid, left
            else:
                lo, first, have = mid, first + left, have - left
        return have, first

    def run(batches):
        for b in batches:
            for shard in b["shard"]:
                have, first = counts(int(shard))
                k = np.repeat(np.arange(len(no)), have)
                j = np.arange(len(k)) - np.repeat(np.cumsum(have) - have, have) + first[k]
                key = np.array([int.from_bytes(hashlib.blake2b(f"{seed}:{x}".encode(), digest_size=7).digest(), "big") for x in no], np.int64)
                at = permuted(j % blocks[k], blocks[k], key[k])
                for s in range(0, len(k), 1 << 16):
                    e = slice(s, s + (1 << 16))
                    yield pd.DataFrame({"shard": shard, "source_no": no[k[e]], "index": at[e], "pass": (j // blocks[k])[e]})

    shards = decks * per_deck
    given = spark.range(0, shards, numPartitions=min(shards, 4096)).withColumnRenamed("id", "shard")
    return given.mapInPandas(run, "shard long, source_no long, index long, pass long")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS, share: float = 1.5,
        most: float = 2.0, block: int = 64, per_shard: int = 16384, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(documents, uses).

    documents: a row for each row of ``docs``: ``id, source, size, first, source_no, source_size, target``.
    uses: ``source_no, index, pass, shard``: the blocks that the mix takes; block ``index`` holds the words ``block * index``
    up to ``block * (index + 1)`` of the source's stream.

    Null and blank texts have size 0 and are in no block; a null source is a source; repeated rows follow each other.  Without
    words there are no uses.  The number of sources, not of documents, is what one task sees and what goes to the driver.
    """
    d = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{source_col}`"].alias("source"), word_count(docs[f"`{text_col}`"]).alias("size"))
    at = written(placed(d))
    sizes = at.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, share, most).withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    blocks = F.ceil(F.col("source_size") / block)
    # a block counts as the mean block of its source, so the words taken come near the target though the last block is short
    n = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * blocks / F.col("source_size")), F.floor(blocks * most))).otherwise(0).cast("long")
    plan = written(plan.withColumn("blocks", blocks.cast("long")).withColumn("slots", n))
    documents = at.join(plan.select(F.col("source").alias("_s"), "source_no", "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    uses = slots(plan.where("slots > 0").select("source_no", "blocks", "slots"), per_shard, seed)
    return documents, uses


def spans(documents: DataFrame, block: int) -> DataFrame:
    """A row for each document and block that it has words in: ``index`` and the document's words ``lo`` up to ``hi`` in it."""
    last = F.col("first") + F.col("size") - 1
    d = documents.where("size > 0").withColumn("index", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(last / block))))
    lo = F.greatest(F.col("index") * block - F.col("first"), F.lit(0))
    return d.withColumn("lo", lo).withColumn("hi", F.least((F.col("index") + 1) * block - F.col("first"), F.col("size")))


def taken(documents: DataFrame, uses: DataFrame, block: int) -> DataFrame:
    """``documents`` with ``taken``: its words in the mix, repeats counted. Documents that share id and source must not differ in ``first``."""
    used = written(uses.groupBy("source_no", "index").agg(F.count("*").alias("times")))
    parts = spans(documents, block).join(used, ["source_no", "index"])
    got = parts.groupBy("id", "source_no", "first").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken"))
    return documents.join(got, (documents["id"].eqNullSafe(got["id"])) & (documents["source_no"] == got["source_no"]) & (documents["first"] == got["first"])
                          & (documents["size"] > 0), "left").select(documents["*"], F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS, share: float = 1.5,
                    most: float = 2.0, block: int = 64, seed: int = 7) -> DataFrame:
    """The mix as rows with the columns of ``docs``: for each document and pass the words taken, in their order.

    The white space between words of a run stays; runs of words that don't follow each other are joined by a line feed.
    A document taken whole has its text unchanged.  Rows that repeat an id and differ otherwise are joined by text and source.
    """
    small_batches(docs.sparkSession)
    documents, uses = mix(docs, id_col, source_col, text_col, weights, share, most, block, seed=seed)
    parts = spans(written(documents), block).join(written(uses), ["source_no", "index"])
    runs = parts.groupBy("id", "source", "first", "size", "pass").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("_runs"))
    # rows that repeat an id: the k-th of them in the stream is the k-th of the table
    many = runs.groupBy("id", "source", "size", "first").agg(F.collect_list("_runs").alias("_runs"))
    kth = Window.partitionBy("id", "source", "size").orderBy("first")
    many = many.withColumn("_k", F.row_number().over(kth))
    d = docs.withColumn("_size", word_count(docs[f"`{text_col}`"]))
    d = d.where("_size > 0").withColumn("_k", F.row_number().over(Window.partitionBy(id_col, source_col, "_size").orderBy(text_col)))
    m = many.select(F.col("id").alias("_id"), F.col("source").alias("_src"), F.col("size").alias("_n"), F.col("_k").alias("_kk"), "_runs")
    d = d.join(m, d[id_col].eqNullSafe(m["_id"]) & d[source_col].eqNullSafe(m["_src"]) & (d["_size"] == m["_n"]) & (d["_k"] == m["_kk"]))
    d = d.withColumn("_run", F.explode("_runs"))
    schema = docs.schema

    def run(batches):
        word = re.compile(WORD)
        for b in batches:
            out = []
            for t, r, size in zip(b.column(text_col).to_pylist(), b.column("_run").to_pylist(), b.column("_size").to_pylist()):
                joined = []
                for x in r:
                    if joined and joined[-1][1] == x["lo"]:
                        joined[-1][1] = x["hi"]
                    else:
                        joined.append([x["lo"], x["hi"]])
                if joined == [[0, size]]:
                    out.append(t)
                    continue
                at = [w.span() for w in word.finditer(t)]
                out.append("\n".join(t[at[lo][0]:at[hi - 1][1]] for lo, hi in joined))
            cols = {c: b.column(c) for c in schema.names}
            cols[text_col] = pa.array(out, b.column(text_col).type)
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([len(x) for x in out], b.column("n_chars").type)
            yield pa.RecordBatch.from_pydict(cols)

    return d.select(*schema.names, "_run", "_size").mapInArrow(run, schema)
