"""Best-fit packing by hierarchical residual packing.

Items are dealt over groups of bounded size; each task packs its group best-fit decreasing and emits the bins that are
nearly full.  Underfull bins go up a tree as items of the next round, ``fan_in`` groups to a task, until one group is left.
Only bins go up, never their items; of bins that are alike a task hands up no more than all rounds above could fill, which
bounds every task, whatever the input, and costs no sequence (``_goes_up``).  No item is ever dropped.
"""
from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lamella.llm.common import arrow_batches, n_parts, small_batches, written
from lamella.llm.tokens import chunks, encoder, tokenizer_path

PIECES = "piece int, start long, length long, ids_crc32 long"


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: pieces of ``size``, the first may be shorter."""
    first = n % size or size
    return [(0, min(first, n)), *((s, size) for s in range(first, n, size))] if n else []


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int | None = 0,
                 path: str | None = None, with_ids: bool = False) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32`` (and ``ids``): whole texts as ids, each followed by ``end_id``, cut to ``size``.

    A null or empty text has the end id only.  Repeated rows give repeated pieces.
    """
    small_batches(docs.sparkSession)
    path = path or tokenizer_path()
    given = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))

    def run(batches):
        enc = encoder(path)
        for b in chunks(batches, "text"):
            ids, lens = enc.encode(b.column("text"))
            at, row, out, arrays = 0, [], [], []
            for i, n in enumerate(lens.tolist()):
                own = ids[at:at + n].astype("<u4")
                at += n
                if end_id is not None:
                    own = np.append(own, np.uint32(end_id))
                for k, (s, m) in enumerate(cuts(len(own), size)):
                    row.append(i)
                    out.append((k, s, m, zlib.crc32(own[s:s + m].tobytes())))
                    if with_ids:
                        arrays.append(own[s:s + m].astype(np.int32))
            k, s, m, c = zip(*out) if out else ((), (), (), ())
            cols = {"id": b.column("id").take(pa.array(row, pa.int64())), "piece": pa.array(k, pa.int32()), "start": pa.array(s, pa.int64()),
                    "length": pa.array(m, pa.int64()), "ids_crc32": pa.array(c, pa.int64())}
            if with_ids:
                cols["ids"] = pa.array(arrays, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(cols)

    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(run, f"id {kind}, {PIECES}" + (", ids array<int>" if with_ids else "")).withColumnRenamed("id", id_col)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin of each item and its place in the bin."""
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(size + 1)]  # bins by what is left
    some, n = 0, 0                                         # bit r: a bin with r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = some >> need
        if fits:
            left = (fits & -fits).bit_length() - 1 + need
            b = free[left].pop()
            if not free[left]:
                some ^= 1 << left
        else:
            left, b, n = size, n, n + 1
        bins[i], places[i] = b, size - left
        left -= need
        if left:
            free[left].append(b)
            some |= 1 << left
    return bins, places


def _local(rows: pd.DataFrame, size: int, full: int, first_id: int, quota: int) -> pd.DataFrame:
    """One task of the first level: rows of items with the bin and place of each, and whether the bin goes up."""
    bins, places = best_fit(rows["length"].to_numpy(), size)
    level = np.bincount(bins, weights=rows["length"].to_numpy()).astype(np.int64)
    return rows.assign(_bin=bins + first_id, _place=places, _up=_goes_up(level, size, full, quota)[bins], _level=level[bins])


def _merge(rows: pd.DataFrame, size: int, full: int, quota: int) -> pd.DataFrame:
    """One task above: bins as items (``_bin, _level``), each with the bin it joins and its place there."""
    names = rows["_bin"].to_numpy()
    used = rows["_level"].to_numpy()
    bins, places = best_fit(used, size)
    level = np.bincount(bins, weights=used).astype(np.int64)
    name = np.full(len(level), np.iinfo(np.int64).max)
    np.minimum.at(name, bins, names)  # a bin is called after one of its own, so names stay unique
    return pd.DataFrame({"_bin": names, "_to": name[bins], "_at": places, "_level": level[bins],
                         "_up": _goes_up(level, size, full, quota)[bins], "_group": rows["_group"].to_numpy()})


def _goes_up(level: np.ndarray, size: int, full: int, quota: int) -> np.ndarray:
    """Which bins a task hands up: all that are at most half full, and of each level above that ``quota``.

    Best fit leaves no two bins that fit together, so at most one bin of a task is at most half full, and bins above half
    only ever take such.  A task has ``fan_in`` children, hence at most ``fan_in`` of them; over all rounds above, no more than
    ``fan_in`` x rounds bins of one level can be taken, and bins of one level are alike.  The surplus is done, with no loss.
    """
    order = np.argsort(level, kind="stable")
    ranked = level[order]
    number = np.empty(len(level), np.int64)
    number[order] = np.arange(len(level)) - np.searchsorted(ranked, ranked)
    return (level < full) & ((2 * level <= size) | (number < quota))


def pack(items: DataFrame, size: int, per_group: int = 4096, fan_in: int = 8, slack: int | None = None) -> DataFrame:
    """``items`` (``length`` of 1 to ``size``, any other columns) with ``sequence_id`` and ``offset``, gapless from 0.

    Bins within ``slack`` (default a 256th of ``size``) of full are emitted at once.  Equal lengths are alike: which of them
    share a sequence is any choice.  Repeated rows are packed each by itself, nulls in other columns are kept.  No rows give
    no rows; a length that is null or outside 1 to ``size`` is an error.
    """
    full = size - (size // 256 if slack is None else slack)
    cols = items.columns
    items = items.withColumn("length", F.when(F.col("length").between(1, size), F.col("length")).otherwise(
        F.raise_error(F.lit("length outside 1 to the sequence size"))))
    table = written(items)
    tree = [n_parts(table.count(), per_group)]  # tasks of each level
    while tree[-1] > 1:
        tree.append(n_parts(tree[-1], fan_in))
    # numbered by place in the written table: rows that repeat do not meet in one group
    table = table.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(tree[0])).cast("int"))

    def level(rows: DataFrame, number: int, task, schema: str) -> DataFrame:
        quota = fan_in * (len(tree) - 1 - number)

        def run(batches):
            held = [b for b in batches if len(b)]
            if held:
                given = pd.concat(held, ignore_index=True)  # one group
                out = task(given, int(given["_group"].iloc[0]), quota)
                yield out if quota else out.assign(_up=False)

        return written(rows.repartitionById(tree[number], F.col("_group")).mapInPandas(run, schema))

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
    placed = level(table, 0, lambda own, group, quota: _local(own, size, full, group << 32, quota),
                   f"{names}, _bin long, _place long, _up boolean, _level long")
    up = placed.where("_up").groupBy("_bin").agg(F.first("_level").alias("_level"), F.first("_group").alias("_group"))
    moves = []
    for number in range(1, len(tree)):
        up = up.withColumn("_group", F.floor(F.col("_group") / fan_in).cast("int"))
        moves.append(level(up, number, lambda own, group, quota: _merge(own, size, full, quota),
                           "_bin long, _to long, _at long, _level long, _up boolean, _group int"))
        up = moves[-1].where("_up").groupBy(F.col("_to").alias("_bin")).agg(F.first("_level").alias("_level"), F.first("_group").alias("_group"))
    place = [F.col("_bin").alias("sequence_id"), F.col("_place").alias("offset")]
    if not moves:
        return placed.select(*cols, *place)
    # where a bin of the first level ends: moves of bins only, from the top down, then once to the items
    ends = moves.pop().select("_bin", "_to", "_at")
    while moves:
        above = ends.toDF("_was", "_last", "_further")
        ends = moves.pop().join(above, F.col("_to") == F.col("_was"), "left").select(
            "_bin", F.coalesce("_last", "_to").alias("_to"), (F.col("_at") + F.coalesce("_further", F.lit(0))).alias("_at"))
    ends = written(ends)
    moved = placed.where("_up").join(ends, "_bin").select(*cols, F.col("_to").alias("sequence_id"), (F.col("_place") + F.col("_at")).alias("offset"))
    return placed.where("not _up").select(*cols, *place).unionByName(moved)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int | None = 0,
                   path: str | None = None) -> DataFrame:
    """Pieces of all documents with their sequence and place.

    A null or empty text is one piece of its end id (none without ``end_id``); repeated rows and null ids give pieces each; a
    very long text gives full pieces and one shorter, its first; other columns are ignored; no rows give no rows.
    """
    with arrow_batches(docs.sparkSession, 256):
        return pack(token_pieces(docs, id_col, text_col, size, end_id, path), size)
