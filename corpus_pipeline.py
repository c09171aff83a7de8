"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing, packing."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lamella.llm.common import read, written
from lamella.llm.exact_dedup import exact_dedup
from lamella.llm.mixing import mixed_documents
from lamella.llm.near_dedup import near_dedup
from lamella.llm.packing import pack_documents
from lamella.llm.quality_rules import quality_rules

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]
#: The tokenizer, the mix and the near-duplicate search have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, with their failed lines taken out."""
    kept = quality_rules(docs, keep_columns=("lang", "source")).where("kept")
    return kept.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("long").alias("n_chars"))


def keyed(docs: DataFrame, nulls_last: bool) -> DataFrame:
    """``docs`` with ``row_key``, unique and in the order of ``doc_id``; null ids stand at one end.

    Ids that are unique and not null are the keys themselves.  Else rows are sorted by id, then by a hash of the text, and
    numbered, and written once, so that every use of a key sees the same row.
    """
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        return docs.withColumn("row_key", F.col("doc_id"))
    at = F.col("doc_id").asc_nulls_last() if nulls_last else F.col("doc_id").asc_nulls_first()
    given = docs.withColumn("given", F.monotonically_increasing_id())  # one id with one text may be most of the table
    return written(given.orderBy(at, F.xxhash64("text"), "given").drop("given").withColumn("row_key", F.monotonically_increasing_id()))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but for the rows whose key is in ``gone``."""
    return docs.join(gone.select("row_key"), "row_key", "left_anti").select(*DOCUMENT)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each different text, the one with the largest id; a null id loses to any other."""
    docs = keyed(docs, nulls_last=False)
    return without(docs, written(exact_dedup(docs, "row_key").where("not kept")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % or more of its five-word shingles, the one with the smallest id; a null id loses to any other."""
    docs = keyed(docs, nulls_last=True)
    return without(docs, written(near_dedup(docs, "row_key", percent=80).where("not kept")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: what the mix takes of each document, a row for each pass."""
    return mixed_documents(docs.select(*DOCUMENT))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return pack_documents(docs)


STAGES = [("quality_rules", clean), ("exact_dedup", exact), ("minhash_near_dedup", near), ("mixing", mix), ("best_fit_packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
