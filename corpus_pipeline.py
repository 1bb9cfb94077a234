"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next one.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from streamweave.llm import bpe, language_id, mixing, ngram_join, quality
from streamweave.llm.common import remove, shared_folder

#: SQL cannot express the stages; they are tested against brute force, held-out labels and round trips.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: the documents that it rejects go."""
    return quality.keep_good(docs)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents in no known language go."""
    return language_id.keep_known(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join, five words and 0.8: one document of each group stays, the one of the least doc_id."""
    return ngram_join.dedup(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares of words: rows repeat by whole epochs, and end with the row on which each source's budget does."""
    return mixing.mix(docs, whole=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: the columns of documents and ``token_ids``."""
    return bpe.encode_rows(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", keep_good), ("language", keep_known_language), ("dedup", dedup), ("mix", mix), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what passes between them lies in the shared folder, each table until the next one is written. The last is read by the result, and stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
        if i:
            remove(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
