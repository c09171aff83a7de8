"""Contiguous shards of equal bytes, from global prefix sums, in DataFrame functions only.

Rows are dealt into ranges of the id order.  Each range's total is one row; a prefix sum over these few rows tells what lies
before a range, a running sum inside the range what lies before a row.  The line of all bytes is cut at equal targets.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lamella.llm.common import n_parts, written

#: Ranges hold about ``PER_RANGE`` rows; there are ``RANGES`` at most, so that their totals stay few, and ranges grow beyond.
PER_RANGE, RANGES = 20_000, 20_000


def running(what: Column | str, order: list[str], by: str | None = None) -> Column:
    """What lies before a row."""
    w = Window.partitionBy(by) if by else Window.partitionBy()
    return F.coalesce(F.sum(what).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def placed(rows: DataFrame, order: list[str], size: str = "size") -> DataFrame:
    """``rows`` with ``bytes_before`` and ``rows_before`` (in ``order``, over the whole table) and ``total``, the sum of ``size``.

    One range exchange and one by range number; no task holds more than a range.  Rows that agree in ``order`` may share one
    value in a third of the table, so their place in the input decides last and ranges can divide them.
    """
    ranges = min(n_parts(rows.count(), PER_RANGE), RANGES)
    order = [*order, "_at"]
    dealt = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(ranges, *order)
    dealt = written(dealt.withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(F.sum(size).alias("_bytes"), F.count("*").alias("_rows"))
    whole = Window.partitionBy()  # a row for each range
    ahead = totals.select("_range", running("_bytes", ["_range"]).alias("_b"), running("_rows", ["_range"]).alias("_r"), F.sum("_bytes").over(whole).alias("total"))
    own = dealt.select("*", running(size, order, "_range").alias("_ob"), running(F.lit(1), order, "_range").alias("_or"))
    return (own.join(ahead, "_range").withColumn("bytes_before", F.col("_b") + F.col("_ob")).withColumn("rows_before", F.col("_r") + F.col("_or"))
            .select(*rows.columns, "bytes_before", "rows_before", "total"))


def byte_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, overhead: int = 16) -> DataFrame:
    """One row for each row of ``docs``: ``id_col, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the UTF-8 bytes of the text plus ``overhead``.  Shards are runs of the id order, nulls first; rows of one id
    follow by size, then by checksum.  A row goes to the target that holds its middle byte, so a shard is off its target by
    less than the largest row, and a row larger than a target leaves shards empty.  ``slot`` counts from 0 in each shard.  A
    null text has no bytes, as an empty one.  Repeated rows get places of their own; an empty table gives no row.  Sums are
    longs: total bytes times ``shards`` must stay below 2^62.
    """
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    rows = docs.select(docs[f"`{id_col}`"].alias("id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text).alias("crc"))
    rows = placed(rows, ["id", "size", "crc"])
    middle = (F.lit(2) * F.col("bytes_before") + F.col("size")) * F.lit(shards).cast("long")
    rows = written(rows.withColumn("middle", middle).withColumn("shard", F.least(F.expr("middle div (2 * total)"), F.lit(shards - 1)).cast("int")).drop("middle"))
    first = rows.groupBy("shard").agg(F.min("rows_before").alias("first"))  # a row for each shard
    return rows.join(first, "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("rows_before") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of the UTF-8 bytes of ``text``, by bits; ``crc_table`` must be in scope as ``t``."""
    return (f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::UBIGINT)), "
            "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT)::BIGINT")


def crc_table_sql() -> str:
    """A one-row query: the 256 remainders of a byte, as the list ``t``."""
    step = "list_transform({}, lambda c: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)"
    t = "list_transform(range(256), lambda i: i::UBIGINT)"
    for _ in range(8):
        t = step.format(t)
    return f"SELECT {t} AS t"


def sql(shards: int = 40, overhead: int = 16) -> str:
    return f"""
WITH crc_table AS ({crc_table_sql()}),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + {overhead} AS size, {crc32_sql("coalesce(text, '')")} AS crc FROM documents, crc_table),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, crc ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM d),
s AS (SELECT *, least(((2 * before + size) * {shards}) // (2 * total), {shards - 1})::INT AS shard FROM p)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, crc) - 1 AS slot, NULL::INT AS grown_shard
FROM s"""
