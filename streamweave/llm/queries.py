"""The queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import public_tokenizers

from . import bpe, embedding_dedup, fingerprints, language_id, licenses, mixing, ngram_join, quality, sharding, token_counts


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix(spark, sf_dir):
    return mixing.take(_documents(spark, sf_dir))


def op2_fingerprint(spark, sf_dir):
    return fingerprints.edits(_documents(spark, sf_dir))


def op3_language(spark, sf_dir):
    return language_id.identify(_documents(spark, sf_dir))


def op4_quality(spark, sf_dir):
    return quality.classify(_documents(spark, sf_dir))


def op5_shard(spark, sf_dir):
    return sharding.shards(_documents(spark, sf_dir))


def op6_ngram_join(spark, sf_dir):
    return ngram_join.jaccard_components(_documents(spark, sf_dir), width=4, percent=85)


def op7_token_counts(spark, sf_dir):
    return token_counts.token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op8_licenses(spark, sf_dir):
    return licenses.scan(_documents(spark, sf_dir))


def op9_bpe(spark, sf_dir):
    return bpe.digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries():
    ops = (op1_mix, op2_fingerprint, op3_language, op4_quality, op5_shard, op6_ngram_join, op7_token_counts, op8_licenses, op9_bpe, op10_embedding_dedup)
    return {f.__name__: f for f in ops}


def oracle_sql():
    return {"op1_mix": mixing.oracle()}
