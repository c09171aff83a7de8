"""Token files: documents' ids in ascending order of document id, coded by the range coder of ``range_coder``.

A file is a row of segments.  A segment, all numbers little-endian:

    magic "LTS2", uint64 length of what follows, uint32 crc32 of the head, uint32 length of the head, head, block streams

Its head is zlib data of: uint32 documents, uint64 ids, uint32 block length, uint32 different ids, uint32 order-0 tables, then
the arrays document ids (int64), null marks (uint8), ids of each document (uint32), different ids (uint32), their frequencies
in each table (uint32), bytes of each block (uint32), crc32 of each block's ids as uint32 and then its
bytes (uint32).  Given the head, a block is
decoded alone and checked by its crc32.  Segments hold whole documents, about ``SEGMENT`` ids; a line feed ends each.
"""
from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lamella.core import scratch_folder
from lamella.llm.common import arrow_batches, n_parts, written
from lamella.llm.range_coder import decode, encode, order0_tables
from lamella.llm.tokens import chunks, encoder, tokenizer_path

MAGIC = b"LTS2"
BLOCK = 4096
SEGMENT = 8_000_000
#: Different pieces a worker remembers while it writes.
PIECES = 800_000
#: Bytes of text that a task writes, about, and segments in a file of it: larger tasks write several files.
PER_TASK, PER_FILE = 20 << 20, 8


def pack_segment(doc_ids: list, sizes: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    seen = np.bincount(ids) > 0  # as long as the vocabulary
    names = np.flatnonzero(seen)
    symbols = (np.cumsum(seen) - 1).astype(np.int32)[ids]
    freq = order0_tables(symbols, sizes, len(names)) if len(ids) else np.empty((0, 0), np.int64)
    streams = encode(symbols, freq, block) if len(ids) else []
    raw = ids.astype("<u4")
    sums = [zlib.crc32(s, zlib.crc32(raw[a:a + block].tobytes())) for a, s in zip(range(0, len(ids), block), streams)]
    null = [x is None for x in doc_ids]
    head = zlib.compress(b"".join([
        struct.pack("<IQIII", len(doc_ids), len(ids), block, len(names), len(freq)), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array(null, "u1").tobytes(),
        sizes.astype("<u4").tobytes(), names.astype("<u4").tobytes(), freq.astype("<u4").tobytes(), np.array([len(s) for s in streams], "<u4").tobytes(),
        np.array(sums, "<u4").tobytes()]), 1)
    body = b"".join(streams)
    return MAGIC + struct.pack("<QII", 8 + len(head) + len(body), zlib.crc32(head), len(head)) + head + body


def segments(content: bytes):
    """(document ids, sizes, ids) of each segment of a file; a damaged one is an error."""
    at = 0
    while at < len(content):
        if content[at:at + 4] != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        n, crc, head_n = struct.unpack_from("<QII", content, at + 4)
        head = content[at + 20:at + 20 + head_n]
        if zlib.crc32(head) != crc or at + 12 + n > len(content):
            raise ValueError(f"damaged head at byte {at}")
        body = content[at + 20 + head_n:at + 12 + n]
        at += 12 + n + 1
        head = zlib.decompress(head)
        docs, total, block, different, tables = struct.unpack_from("<IQIII", head)
        blocks, p = -(-total // block), 24
        arrays = []
        for kind, k in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", different), ("<u4", tables * different), ("<u4", blocks), ("<u4", blocks)):
            arrays.append(np.frombuffer(head, kind, k, p))
            p += arrays[-1].nbytes
        doc_ids, null, sizes, names, freq, length, sums = arrays
        edge = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
        streams = [body[a:b] for a, b in zip(edge[:-1], edge[1:])]
        ids = names[decode(streams, total, freq.astype(np.int64).reshape(tables, different), block)] if total else np.empty(0, np.uint32)
        ids = ids.astype("<u4")
        for i, s in enumerate(sums.tolist()):
            if zlib.crc32(streams[i], zlib.crc32(ids[i * block:(i + 1) * block].tobytes())) != s:
                raise ValueError(f"damaged block {i}")
        yield [None if z else x for x, z in zip(doc_ids.tolist(), null.tolist())], sizes.astype(np.int64), ids


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0, path: str | None = None,
                      per_task: int = PER_TASK, per_file: int = PER_FILE, block: int = BLOCK) -> None:
    """Writes ``docs`` to ``folder``, a range of about ``per_task`` bytes of text for each task, ascending by id, nulls first.

    A file holds at most ``per_file`` segments, whatever a task gets.  Ids that repeat are ordered by a hash of the text.  A null
    or empty text is the end id only.  A segment holds whole documents, so one beyond ``SEGMENT`` ids is a segment by itself.  An
    empty table writes no segment.  The files go through Spark's writer, so any store that Spark writes will do.
    """
    spark = docs.sparkSession
    path = path or tokenizer_path()
    d = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].alias("text"))
    size = d.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    d = d.withColumn("h", F.xxhash64("text"))
    d = d.repartitionByRange(n_parts(size, per_task), "id", "h").sortWithinPartitions("id", "h").select("id", "text")

    def run(batches):
        enc = encoder(path, PIECES)
        names, sizes, parts, n = [], [], [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([pack_segment(names, np.concatenate(sizes), np.concatenate(parts), block)], pa.binary())], ["payload"])

        for b in chunks(batches, "text"):
            ids, lens = enc.encode(b.column("text"))
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(lens), np.uint32(end_id))
                lens = lens + 1
            names += b.column("id").to_pylist()
            sizes.append(lens)
            parts.append(ids)
            n += len(ids)
            if n >= SEGMENT:
                yield out()
                names, sizes, parts, n = [], [], [], 0
        if names:
            yield out()

    with arrow_batches(spark, 256):
        (d.mapInArrow(run, "payload binary").select(F.col("payload").cast("string").alias("value"))
         .write.option("lineSep", "\n").option("maxRecordsPerFile", per_file).text(folder))


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) from the files alone; ``start`` counts the ids of all documents before."""
    # a task's files are numbered in its order
    number = lambda rule: F.regexp_extract("path", rule, 1).cast("long")
    files = spark.read.format("binaryFile").load(folder).select((F.shiftleft(number(r"part-(\d+)"), 32) + F.coalesce(number(r"-c(\d+)\.\w+$"), F.lit(0))).alias("file"), "content")

    def run(batches):
        for b in batches:
            for no, content in zip(b.column("file").to_pylist(), b.column("content")):
                before = 0
                for doc_ids, sizes, ids in segments(content.as_py()):
                    ends = np.cumsum(sizes)
                    starts = ends - sizes
                    cols = {"file": pa.array([no] * len(sizes), pa.int64()), "doc_id": pa.array(doc_ids, pa.int64()), "own": pa.array(starts + before),
                            "n_tokens": pa.array(sizes), "ids_crc32": pa.array([zlib.crc32(ids[a:e].tobytes()) for a, e in zip(starts.tolist(), ends.tolist())], pa.int64())}
                    if with_ids:
                        cols["ids"] = pa.array([ids[a:e].astype(np.int32) for a, e in zip(starts.tolist(), ends.tolist())], pa.list_(pa.int32()))
                    before += len(ids)
                    yield pa.RecordBatch.from_pydict(cols)

    with arrow_batches(spark, 1):  # a row is a file
        d = written(files.mapInArrow(run, "file long, doc_id long, own long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")))
    sums = d.groupBy("file").agg(F.sum("n_tokens").alias("n"))  # one row for each file
    ahead = sums.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return d.join(ahead, "file").select("doc_id", (F.col("ahead") + F.col("own")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0, path: str | None = None) -> DataFrame:
    """Writes ``docs`` to a new folder of the shared place and reads it back."""
    folder = scratch_folder(docs.sparkSession) + "/tokens"
    write_token_files(docs, folder, id_col, text_col, end_id, path)
    return read_token_files(docs.sparkSession, folder)
