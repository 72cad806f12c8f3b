"""A corpus from raw documents to token counts: five of the corpus operators, each over all that the one before it kept.

Near copies are texts that share at least 0.8 of their five-word shingles; of each group the least doc_id stays.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cragline.llm import mixing, pieces, quality_rules, simhash, substring
from cragline.llm._spark import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.without_rejects(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays."""
    return simhash.one_of_each_group(docs, words=5, share=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that an earlier document holds are cut; documents left empty stay as such."""
    return substring.texts_without_repeats(docs, width=13)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What each source gives to the mix: whole texts once or twice, and parts."""
    return mixing.mixed_texts(docs, weights=(5, 2, 1), share=1.5, most=2.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text of the mix."""
    return pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mix), ("sentencepiece", tokens)]
#: XXH64 fingerprints and SentencePiece ids can't be had in DuckDB's SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written as Parquet in the shared folder and read again by the next."""
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
