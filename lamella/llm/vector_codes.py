"""Product-quantisation codes of vectors, with codebooks fitted through metric trees.

Tasks cut the vectors they read into chunks and build a tree over each part of a chunk; the trees are written once.  A round
walks every tree with the codebook: balls owned by one entry give their cached sum and number, other leaves their points'.
Sums of a round, one row for each entry and task, are added up on Spark; only the codebook passes through the driver.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lamella.llm.common import arrow_batches, written
from lamella.llm.metric_tree import Tree, assign, build

#: Vectors in a chunk, at most.
CHUNK = 4096
#: Scaled components lie between -RANGE and RANGE, so that squared distances of 64 components fit a long.
RANGE = 1 << 27
FIELDS = (("points", "<i4"), ("row", "<i4"), ("pivot", "<f8"), ("radius", "<f8"), ("total", "<i8"), ("lo", "<i4"), ("hi", "<i4"), ("left", "<i4"), ("right", "<i4"))


def scaled(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """``id, label, v``: components as integers, of the vectors that are whole."""
    v = vectors[f"`{vector_col}`"]
    whole = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    d = vectors.select(vectors[f"`{id_col}`"].alias("id"), vectors[f"`{label_col}`"].alias("label"), F.transform(v, lambda x: x.cast("double")).alias("v")).where(whole)
    number = lambda x: F.when(F.abs(x) < RANGE / scale, F.floor(x * F.lit(float(scale))).cast("int")).otherwise(F.raise_error(F.lit("component out of range")).cast("int"))
    return d.withColumn("v", F.transform("v", number))


def forest(d: DataFrame, dim: int, parts: int, chunk: int) -> DataFrame:
    """One row for each chunk of ``d``: ids, labels and the flat arrays of a tree for each part."""
    wide = dim // parts
    schema = T.StructType([T.StructField("id", T.ArrayType(d.schema["id"].dataType)), T.StructField("label", T.ArrayType(d.schema["label"].dataType))]
                          + [T.StructField(f, T.ArrayType(T.BinaryType())) for f, _ in FIELDS])

    def row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        points = np.asarray(t.column("v").combine_chunks().flatten(), np.int64).reshape(len(t), dim)
        trees = [build(points[:, p * wide:(p + 1) * wide]) for p in range(parts)]
        edge = pa.array([0, len(t)], pa.int32())
        lists = [pa.ListArray.from_arrays(edge, t.column(c).combine_chunks()) for c in ("id", "label")]
        flat = [pa.array([[np.ascontiguousarray(getattr(x, f), kind).tobytes() for x in trees]], pa.list_(pa.binary())) for f, kind in FIELDS]
        return pa.RecordBatch.from_arrays([*lists, *flat], ["id", "label", *(f for f, _ in FIELDS)])

    def run(batches):
        held, n = [], 0
        for b in batches:
            for lo in range(0, len(b), chunk):
                part = b.slice(lo, chunk)
                if n + len(part) > chunk:
                    yield row(held)
                    held, n = [], 0
                held.append(part)
                n += len(part)
        if n:
            yield row(held)

    return d.select("id", "label", "v").where(F.size("v") == dim).mapInArrow(run, schema)


def trees(batch: pa.RecordBatch, i: int, wide: int) -> list[Tree]:
    """The trees of one chunk, a part each."""
    arrays = {f: [np.frombuffer(x, kind) for x in batch.column(f)[i].as_py()] for f, kind in FIELDS}
    shaped = {"points": np.int64, "pivot": np.float64, "total": np.int64}
    return [Tree(*[x.reshape(-1, wide).astype(shaped[f]) if f in shaped else x.astype(np.float64 if f == "radius" else np.int64) for f, x in ((f, arrays[f][p]) for f, _ in FIELDS)])
            for p in range(len(arrays["points"]))]


def sums(forest_: DataFrame, books: list[np.ndarray]) -> pd.DataFrame:
    """``part, entry, n`` and the components' sums ``s``, of all points by nearest entry: a row for each entry that is used."""
    wide, size = books[0].shape[1], len(books[0])

    def run(batches):
        n, s = np.zeros((len(books), size), np.int64), np.zeros((len(books), size, wide), np.int64)
        for b in batches:
            for i in range(len(b)):
                for p, t in enumerate(trees(b, i, wide)):
                    ball, owner, point, entry = assign(t, books[p])
                    np.add.at(n[p], owner, t.hi[ball] - t.lo[ball])
                    np.add.at(s[p], owner, t.total[ball])
                    np.add.at(n[p], entry, 1)
                    np.add.at(s[p], entry, t.points[point])
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(n[part, entry]),
                                          "s": pa.array(list(s[part, entry]), pa.list_(pa.int64()))})

    d = forest_.mapInArrow(run, "part int, entry int, n long, s array<long>")
    return d.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(k))) for k in range(wide)]).alias("s")).toPandas()  # parts x entries


def coded(forest_: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``id, label, code, error`` of every vector."""
    wide = books[0].shape[1]
    schema = T.StructType([T.StructField(c, forest_.schema[c].dataType.elementType) for c in ("id", "label")]
                          + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches):
        for b in batches:
            for i in range(len(b)):
                codes, error = [], 0
                for book, t in zip(books, trees(b, i, wide)):
                    ball, owner, point, entry = assign(t, book)
                    code = np.empty(len(t.points), np.int64)
                    code[point] = entry
                    for a, e, o in zip(t.lo[ball].tolist(), t.hi[ball].tolist(), owner.tolist()):
                        code[a:e] = o
                    own = np.empty_like(code)
                    own[t.row] = code
                    square = np.empty_like(code)
                    square[t.row] = ((t.points - book[code]) ** 2).sum(1)
                    codes.append(own)
                    error = error + square
                text = np.stack(codes, 1).astype(np.uint8).tobytes().hex()
                step = 2 * len(books)
                columns = [b.column(c).slice(i, 1).flatten() for c in ("id", "label")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([text[k:k + step] for k in range(0, len(text), step)], pa.string()), pa.array(error, pa.int64())],
                                                 ["id", "label", "code", "error"])

    return forest_.mapInArrow(run, schema)


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16,
                 rounds: int = 6, scale: int = 4096, chunk: int = CHUNK) -> DataFrame:
    """``id_col, code, error, label_error, codebooks_sha256``, a row for each whole vector, and none where no vector is whole.

    Components become floor(``scale`` x).  A codebook starts as its part of the ``entries`` (256 at most) smallest ids' vectors (null ids
    last, ties by the vector itself; fewer vectors give fewer entries); a round assigns each part to the nearest entry, ties to
    the lower index, and sets entries to the floor of their parts' mean; unused ones stay.  Vectors that are null, hold null,
    NaN or infinite components are left out; so are those, empty ones too, whose length is not that of the smallest id's vector,
    and all where this is no multiple of ``parts``.  Repeated rows and ids are coded row by row.  A component of 2^27 / ``scale`` or more is an error.
    """
    spark = vectors.sparkSession
    if entries > 256:
        raise ValueError("two hex digits name at most 256 entries")
    d = scaled(vectors, id_col, vector_col, label_col, scale)
    d = written(d)
    first = [r["v"] for r in d.where(F.size("v") > 0).orderBy(F.col("id").asc_nulls_last(), "v").limit(1).collect()]
    dim = len(first[0]) if first and len(first[0]) % parts == 0 else 0
    if not dim:
        return d.where("false").select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"),
                                       F.lit("").alias("codebooks_sha256"))
    start = d.where(F.size("v") == dim).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    books = [b.copy() for b in np.split(np.array([r["v"] for r in start], np.int64), parts, axis=1)]
    with arrow_batches(spark, chunk, 64):
        grown = written(forest(d, dim, parts, chunk))
    with arrow_batches(spark, 1, 64):  # a row is a chunk
        for _ in range(rounds):
            for r in sums(grown, books).itertuples():
                books[r.part][r.entry] = [x // r.n for x in r.s]
        out = written(coded(grown, books))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b.tolist() for x in e).encode()).hexdigest()
    by_label = written(out.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "_label")
    return out.join(by_label, out["label"].eqNullSafe(F.col("_label"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    step = """
n{k} AS MATERIALIZED (SELECT vec_id, part, min(d * {e} + entry) AS best FROM (
    SELECT p.vec_id, p.part, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS d FROM p JOIN b{k} b USING (part)) GROUP BY ALL),"""
    new = """
s{k} AS (SELECT part, best % {e} AS entry, place, floor(sum(x) / count(*))::BIGINT AS x
    FROM (SELECT part, best, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS place FROM n{k} JOIN p USING (vec_id, part)) GROUP BY ALL),
u{k} AS (SELECT part, entry, list(x ORDER BY place) AS v FROM s{k} GROUP BY ALL),
b{j} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(u.v, b.v) AS v FROM b{k} b LEFT JOIN u{k} u USING (part, entry)),"""
    body = "".join(step.format(k=k, e=entries) + new.format(k=k, j=k + 1, e=entries) for k in range(rounds)) + step.format(k=rounds, e=entries)
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS v FROM k, range({parts}) r(part)),
b0 AS MATERIALIZED (SELECT part, entry, v FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < {entries}) USING (vec_id)),{body}
c AS (SELECT vec_id, string_agg(printf('%02x', best % {entries}), '' ORDER BY part) AS code, sum(best // {entries})::BIGINT AS error FROM n{rounds} GROUP BY vec_id),
l AS (SELECT label, sum(error)::BIGINT AS label_error FROM c JOIN k USING (vec_id) GROUP BY label),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM c JOIN k USING (vec_id) JOIN l ON l.label IS NOT DISTINCT FROM k.label, h"""
