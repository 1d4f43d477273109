"""From raw documents to packed token sequences.

Stages: documents judged toxic go; of near duplicates one stays; documents that hold a benchmark item go; secrets are masked; the
rest is packed. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.functions.scale import stored
from clausemill.llm import decontamination, near_dups, packing, secrets, toxicity
from clausemill.llm.common import small_batches, table
from clausemill.session import ship

ORACLE_SQL = None  # classes of near duplicates and learned scores are beyond SQL; tests/llm/test_pipeline.py has the plain version


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a toxicity score below the threshold."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(small_batches(spark), sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of every near-duplicate class."""
    ship(small_batches(spark))
    return near_dups.keep_one(docs)


def drop_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item within its error budget."""
    return decontamination.decontaminate(docs, table(small_batches(spark), sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents; spans that the secret scan finds are masked, and n_chars follows the text."""
    ship(small_batches(spark))
    words = secrets.ranked_words(docs, public_tokenizers.path("word_bpe_49k.json"))
    masked = docs.withColumn("text", secrets.redacted(F.col("text"), words=words))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 2048 tokens."""
    ship(small_batches(spark))
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_items),
    ("secrets", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the result of each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
