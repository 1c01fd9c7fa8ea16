"""The corpus pipeline: quality rules, near-dedup, decontamination, secret redaction, SentencePiece encoding.

Each stage gets what its predecessor kept. The first three drop documents, the fourth replaces found secrets in the
texts, the last returns doc_id, n_pieces, ids and round_trip. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import decontamination, near_dedup, pieces, quality, secrets
from granary.llm.shared import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scans", redact_secrets),
    ("sentencepiece", encode),
]

#: The trained network of the fourth stage and the encoding have no SQL form; a test compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else written(out)
    return docs
