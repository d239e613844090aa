"""A training corpus from `documents` in five stages, each an operator of schemaloom.llm.

Every function takes (spark, docs, sf_dir); all but the last return the columns of documents.
The last returns doc_id, n_tokens, ids_sha256 and decoded_sha256, one row for each copy that the mix
takes. Rows with null texts count as empty texts throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from schemaloom import ship
from schemaloom.llm import exact_dedup, minhash, mixing, quality_cnn
from schemaloom.llm.common import small_batches, table, written
from schemaloom.llm.queries import bpe_digests


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as quality 0 go."""
    weights = quality_cnn.fit(docs, table(ship(spark), sf_dir, "labels"))
    with small_batches(spark):
        return written(quality_cnn.judged(docs, weights).where("predicted = 1").select("row.*"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (runs of five words, similarity 0.80 or more) the document with the smallest doc_id stays."""
    ship(spark)
    return minhash.dedup(docs, percent=80, n_bands=40)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies in the order of their training positions."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the text that they decode to, as digests."""
    ship(spark)
    return bpe_digests(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("bpe", encode)]

#: SQL cannot express the classifier, the similarity of shingle sets at scale, or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage not in (quality, encode):  # these two write their own results
            docs = written(docs)
    return docs
