"""Registered queries of this folder and, where SQL can express them, their SQL twins."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lamella.llm import mixing, quality_knn, sharding, spelling, vector_codes as codes
from lamella.llm.common import read, written
from lamella.llm.exact_dedup import exact_dedup
from lamella.llm.near_dedup import near_dedup
from lamella.llm.packing import pack_documents
from lamella.llm.pii import find_pii
from lamella.llm.quality_rules import quality_rules
from lamella.llm.token_file import token_files
from lamella.llm.url_filter import sql as url_sql, url_filter
from lamella.llm.warc import archived, sql as warc_sql


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"), percent=85)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = exact_dedup(read(spark, sf_dir, "documents"))
    return d.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, uses = mixing.mix(read(spark, sf_dir, "documents"))
    d = mixing.taken(written(documents), uses, block=64)
    return d.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules(read(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = find_pii(read(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(read(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality_knn.train(docs, read(spark, sf_dir, "labels"))
    return quality_knn.scored(docs, model).select("doc_id", quality_knn.held_out().alias("held_out"), "score", "predicted")


def op11_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(read(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.vector_codes(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_exact_dedup, op3_mixing, op4_quality_rules, op5_pii, op6_best_fit_packing, op7_token_files, op8_url_filter, op9_warc, op10_quality_classifier,
                                   op11_byte_shards, op12_spelling_variants, op13_vector_codes)}

ORACLES = {
    "op2_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)""",
    "op8_url_filter": url_sql(),
    "op9_warc": warc_sql(),
    "op11_byte_shards": sharding.sql(),
    "op12_spelling_variants": spelling.sql(),
    "op13_vector_codes": codes.sql(),
}
