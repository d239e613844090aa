"""The queries of this subpackage: thin wrappers that derive each contract's columns. Those whose main work is
in Python write their slim results at once, with small Arrow batches; the session's settings stay."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, embedding_dedup, exact_dedup, licenses, line_dedup, merkle, minhash, mixing, periods, quality_cnn, token_counts, url_tree
from .common import small_batches, table, written
from .oracles import ORACLES


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("clean_text", F.lit(""))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(text, 256).alias("clean_sha256"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    with small_batches(spark):
        return written(licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("detections"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    with small_batches(spark):
        return written(token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classify(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mixing.allot(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    placed = placed.orderBy(F.col("position").asc_nulls_last(), "h")
    return placed.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality_cnn.fit(docs, table(spark, sf_dir, "labels"))
    with small_batches(spark):
        scored = written(quality_cnn.score(docs, weights))
    return scored.select("doc_id", quality_cnn.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_tree.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "template")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    with small_batches(spark):
        return written(periods.digests(table(spark, sf_dir, "documents")))


def bpe_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to; a written table."""
    with small_batches(docs.sparkSession):
        decoded = bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))
        joined = F.array_join(F.col("ids").cast("array<string>"), " ")
        return written(decoded.select(
            "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
            F.sha2("decoded", 256).alias("decoded_sha256")))


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_nearest_neighbours, op3_license_scan, op4_token_counts, op5_exact_dedup, op6_mixing,
    op7_quality_classifier, op8_minhash_near_dedup, op9_url_filter, op10_bpe, op11_embedding_dedup, op12_merkle_manifest,
    op13_periodic_runs)}

__all__ = ["ORACLES", "QUERIES"]
