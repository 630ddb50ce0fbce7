"""From raw documents to token digests: language ID, near-dedup, PII masking, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns a DataFrame that is written as
Parquet and read again for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filegraph.llm import bpe, langid, minhash, mixing, pii
from filegraph.llm.common import documents, staged, step


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognizable language (no letter, no text) go."""
    with step("language", docs):
        return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the least doc_id stays; rows without a doc_id stay.

    A row goes by its doc_id and its text, so that another text under the same doc_id is judged by itself.
    """
    with step("near_dedup", docs):
        gone = minhash.near_duplicates(docs, digest=True).filter("NOT kept").select(F.col("doc_id").alias("__gone"), F.col("digest").alias("__text")).distinct()
        gone = staged(gone, "dedup-gone")
        gone = F.broadcast(gone) if gone.count() <= minhash.BROADCAST_IDS else gone  # else the texts are shuffled
    return docs.join(gone, (F.col("doc_id") == F.col("__gone")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__text")), "left_anti")


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to its kind in brackets."""
    with step("pii", docs):
        return pii.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    with step("mix", docs):
        return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count, ids digest and decoded digest of each document."""
    import public_tokenizers

    with step("bpe", docs):
        return bpe.report(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("near_dedup", near_dedup), ("pii", mask_pii), ("mix", mix_sources), ("bpe", encode)]

#: Random ring permutations, rank profiles and BPE are beyond SQL; tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
