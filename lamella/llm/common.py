"""Helpers the operators share."""
from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lamella.core import scratch_folder

#: A word: a run of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_batches(spark: SparkSession, rows: int = 256, mb: int = 8) -> None:
    """Bounds what one Arrow batch of whole texts can hold, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", mb << 20)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, mb: int = 8):
    """While an action inside runs, Arrow batches hold at most so many rows and bytes; what was set before holds again after it."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": mb << 20}
    before = {k: spark.conf.get(k) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and a lost executor takes nothing with it."""
    path = scratch_folder(df.sparkSession) + "/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column | str) -> Column:
    return F.translate(c, UPPER, LOWER)


def n_parts(rows: int, per: int) -> int:
    return max(1, -(-rows // per))
