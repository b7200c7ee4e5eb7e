"""Documents to training tokens: five stages, each written as Parquet and read by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tenderloom.llm import bpe, hyperminhash, langid, pii, raking
from tenderloom.llm.common import stored, table
from tenderloom.llm.queries import byte_bpe_path

FRACTION = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; a null lang is filled with the predicted language where one was learned."""
    return langid.with_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    Rows that repeat a doc_id stand or fall together; rows with a null doc_id are in no group and stay.
    """
    dropped = hyperminhash.near_duplicates(docs, shingle=5, threshold=0.8).filter("doc_id is not null and not kept")
    return docs.join(dropped.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets replaced by surrogates; n_chars follows the new text."""
    done = pii.pseudonymised(docs, pii.session_key(spark))
    length = F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", length).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and forms meet their target shares of tokens."""
    return raking.sampled(docs, FRACTION)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the number of tokens, and hashes of its ids and of the text decoded from them."""
    return bpe.round_trip(docs, byte_bpe_path())


STAGES = [
    ("language id", language),
    ("minhash near-dedup", near_dedup),
    ("pii surrogates", private),
    ("mixing to target weights", mixture),
    ("bpe encoding and decoding", tokens),
]

# SQL cannot express the stages; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
