"""Cleaning of documents, stage by stage: each stage's result is written as Parquet
and is the next one's input.

    1. language ID: documents without a letter or far from every language go
    2. n-gram Jaccard join: one document of each group of near duplicates stays
    3. benchmark decontamination: documents that hold a benchmark item go
    4. secret scan: secrets in the texts are replaced by a mark
    5. byte-level BPE: token ids, and digests that prove they decode to the text

All stages but the last return the columns of documents. What a null, empty or
repeated row does is said in each operator's module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from diamondlap.llm import bpe, decontamination, language_id, ngram_join, secret_scan
from diamondlap.sources.staging import stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secret_scan", mask_secrets),
    ("byte_bpe", encode),
]

#: Profiles, near-duplicate groups, entropy windows and BPE are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
