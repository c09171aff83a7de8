"""WARC archives: writing with revisit records, and reading by boundary chains.

Reading trusts no magic by itself.  Tasks emit, for every place in an archive that parses as a record head, its offset and
the offset of the record that its Content-Length says comes next; pointer jumping from offset 0 then keeps what is reachable.
A head inside a payload is never reached.
"""
from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lamella.core import scratch_folder
from lamella.llm.common import small_batches, written

#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD = re.compile(rb"WARC/1\.[01]\r\n")
LINES = re.compile(rb"(?:[!-9;-~]++:[^\r\n]*+\r\n)++")
#: The fields that are read.
FIELDS = (b"warc-type", b"warc-record-id", b"warc-target-uri", b"warc-payload-digest", b"warc-refers-to", b"content-length")
#: Records of up to this many bytes are archived ``per_file`` at a time, of up to twice as many half as many at a time, and so on.
SMALL = 1 << 16
NO_ID = "none"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to, revisit: bool, date: str) -> bytes:
    """One record with its closing blank lines. Line ends in the URL are percent-encoded."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = lambda x: f"<urn:x-page:{NO_ID if x is None else x}>"
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date)]
    if url:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    head += [("WARC-Payload-Digest", "sha1:" + payload_digest(payload)), ("Content-Type", "application/http;msgtype=response")]
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0,
                   date: str = "2000-01-01T00:00:00Z", per_file: int = 2048) -> None:
    """A record for each row, gzipped archives of at most ``per_file`` records, through Spark's writer.

    Rows are archived by size, the larger the fewer at a time: an archive holds at most ``per_file`` times 64 KiB of payloads
    and URLs, or a single record.

    Payload: the text in UTF-8, null as empty.  Of equal payloads of ``min_bytes`` or more the row with the largest id is the
    response and the others revisit it; rows that repeat that id are responses too, and a group of null ids only has no
    revisits.  Shorter payloads are all responses.
    """
    small_batches(pages.sparkSession)
    d = pages.select(pages[f"`{id_col}`"].cast("long").alias("id"), pages[f"`{url_col}`"].alias("url"), F.coalesce(pages[f"`{payload_col}`"], F.lit("")).alias("payload"))
    key: Column = F.sha2("payload", 256)
    # grade g: up to 2^g times SMALL
    size = F.octet_length("payload").cast("long") + F.coalesce(F.octet_length("url"), F.lit(0))
    d = d.withColumn("grade", sum((size > SMALL << g).cast("int") for g in range(16)))
    first = written(d.select("id", key.alias("key"), F.octet_length("payload").alias("bytes"), F.expr("shiftleft(1, grade)").alias("bit"))
                    .groupBy("key").agg(F.max("id").alias("first"), F.count("*").alias("n"), F.max("bytes").alias("bytes"), F.bit_or("bit").alias("bits")))
    bits = first.agg(F.bit_or("bits")).first()[0] or 1
    d = d.withColumn("key", key).join(first.where((F.col("n") > 1) & (F.col("bytes") >= min_bytes)).select("key", "first"), "key", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    d = d.select("id", "url", "payload", "first", F.coalesce(revisit, F.lit(False)).alias("revisit"), "grade")

    def run(batches):
        for b in batches:
            rows = [record(i, u, p.encode(), f, r, date)[:-1] for i, u, p, f, r in zip(*(b.column(c).to_pylist() for c in ("id", "url", "payload", "first", "revisit")))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["record"])

    # the line separator is the last byte of the record before it
    for n, g in enumerate(g for g in range(17) if bits >> g & 1):
        (d.where(F.col("grade") == g).drop("grade").mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
         .write.mode("append" if n else "error").option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", max(1, per_file >> g)).text(folder))


def plain(content: bytes) -> bytes:
    """An archive's bytes; one or several gzip members are unpacked."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        z = zlib.decompressobj(31)
        out.append(z.decompress(content))
        if not z.eof:
            raise ValueError("damaged gzip member")
        content = z.unused_data
    return b"".join(out)


def candidates(data: bytes):
    """(offset, successor's offset, ``FIELDS``, block) of every place that parses as a record head.

    Heads may be of any length.  A head that starts inside the lines of another ends with them, so lines are parsed once.
    """
    at, end, last = data.find(b"WARC/1."), -1, {}
    while at >= 0:
        m = HEAD.match(data, at)
        if m:
            if m.end() >= end:
                lines = LINES.match(data, m.end())
                end, p, last = lines.end() if lines else m.end(), m.end(), {}
                for line in data[p:end].split(b"\r\n")[:-1]:
                    k, v = line.split(b":", 1)
                    if k.strip().lower() in FIELDS:
                        last[k.strip().lower()] = p, v.strip()
                    p += len(line) + 2
            if end > m.end() and data[end:end + 2] == b"\r\n":
                fields = {k: v for k, (p, v) in last.items() if p >= m.end()}
                start, n = end + 2, fields.get(b"content-length", b"")
                if n.isdigit() and start + int(n) + 4 <= len(data) and data[start + int(n):start + int(n) + 4] == b"\r\n\r\n":
                    yield at, start + int(n) + 4, fields, data[start:start + int(n)]
        at = data.find(b"WARC/1.", at + 1)


def _page(value: bytes | None) -> int | None:
    m = re.fullmatch(rb"<urn:x-page:(-?\d+)>", value or b"")
    return int(m[1]) if m else None


def reachable(chain: DataFrame) -> DataFrame:
    """Of ``chain`` (``file, at, next``; a row for each candidate) the (``file``, ``at``) on the chain from 0, by pointer jumping.

    After round k the first 2^k records of every file are known and pointers span 2^k records.
    """
    known = written(chain.where("at = 0").select("file", "at"))
    jump = written(chain.select("file", "at", "next"))
    while True:
        more = written(known.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
                       .join(chain.select("file", "at"), ["file", "at"], "left_semi"))
        if more.isEmpty():
            return known
        known = written(known.unionByName(more))
        jump = written(jump.join(jump.select("file", F.col("at").alias("next"), F.col("next").alias("to")), ["file", "next"]).select("file", "at", F.col("to").alias("next")))


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """``page_id, url, record_type, payload_bytes, payload_digest, refers_to`` (and ``payload``) of the records of all archives.

    An archive must fit a row of Spark's binary reader (2 GB).  One whose chain does not lead from its first to its last byte,
    or a response whose payload does not have the stated digest, is an error.
    """
    small_batches(spark, rows=4)
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content")
    names = ["file", "at", "next", "size", "page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "right", "payload"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]

    def run(batches):
        for b in batches:
            for file, content in zip(b.column("file").to_pylist(), b.column("content")):
                data = plain(content.as_py())
                rows = []
                for at, nxt, f, block in candidates(data):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind = f.get(b"warc-type", b"").decode("latin-1")
                    digest = f.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha1:")
                    n = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
                    n = len(payload) if kind == "response" else int(n[1]) if n else None
                    right = kind != "response" or payload_digest(payload) == digest
                    rows.append((file, at, nxt, len(data), _page(f.get(b"warc-record-id")), f.get(b"warc-target-uri", b"").decode("utf-8", "replace"), kind, n, digest,
                                 _page(f.get(b"warc-refers-to")), right, payload if with_payload else None))
                if data and not rows:
                    raise ValueError(f"{file} holds no record")
                for s in range(0, len(rows), 1024):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[s:s + 1024]), kinds)], names)

    found = written(files.mapInArrow(run, "file string, at long, next long, size long, page_id long, url string, record_type string, payload_bytes long, "
                                          "payload_digest string, refers_to long, right boolean, payload binary"))
    kept = found.join(reachable(found.select("file", "at", "next")), ["file", "at"])
    ends = kept.groupBy("file").agg(F.max("next").alias("end"), F.max("size").alias("size"))
    broken = found.select("file").distinct().join(ends.where("end = size"), "file", "left_anti")
    bad = [r[0] for r in broken.limit(3).collect()]
    if bad or not kept.where("not right").isEmpty():
        raise ValueError(f"damaged archives: {bad or 'a payload does not have its digest'}")
    return kept.select("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", *(["payload"] if with_payload else []))


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` to new archives in the shared place and reads them back."""
    folder = scratch_folder(pages.sparkSession) + "/archives"
    write_archives(pages, folder, id_col, url_col, payload_col, min_bytes)
    return read_archives(pages.sparkSession, folder)


def sql() -> str:
    """The same rows in SQL over ``pages``; base32 is spelled out from the digest's bits."""
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT body, max(page_id) AS first FROM p GROUP BY body),
h AS (SELECT page_id, first, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex FROM p JOIN g USING (body)),
b AS (SELECT *, array_to_string([substr('0000000100100011010001010110011110001001101010111100110111101111',
        cast(4 * strpos('0123456789abcdef', substr(hex, k, 1)) - 3 AS bigint), 4) for k in range(1, 41)], '') AS bits FROM h)
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + 16 * cast(substr(bits, 5 * i + 1, 1) AS int)
         + 8 * cast(substr(bits, 5 * i + 2, 1) AS int) + 4 * cast(substr(bits, 5 * i + 3, 1) AS int) + 2 * cast(substr(bits, 5 * i + 4, 1) AS int)
         + cast(substr(bits, 5 * i + 5, 1) AS int) AS bigint), 1) for i in range(32)], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b"""
