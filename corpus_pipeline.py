"""From raw documents to packed training sequences, as five stages on Spark.

Each stage takes what its predecessor kept, as a table written and read again.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import minhash_dedup, mixing, packing, quality_classifier, secret_ledger
from ridgeline.llm._store import delete, new_path, shared_dir, small_batches, temporary
from ridgeline.llm.queries import quality_labels, table

#: Documents of a lower score go. Near copies share this many hundredths of their shingles.
LEAST_QUALITY, PERCENT = 0.3, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality_classifier.fit(docs, quality_labels(spark, sf_dir))
    return quality_classifier.keep_good(docs, model, LEAST_QUALITY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash_dedup.keep_one(docs, PERCENT)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret of the text replaced by a mark."""
    clean = secret_ledger.redact(docs, new_path(spark, "ledger"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    taken = mixing.mixed_rows(docs, mixing.quality_weight(table(spark, sf_dir, "labels")))
    return taken.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mix", mix), ("pack", pack)]

#: SQL cannot express the learned model or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; what a stage wrote goes once the next one is written.

    Null, empty and very long texts, null ids and repeated rows are treated as each operator's
    docstring says; columns that the table has besides its own pass through to the last stage,
    of any name. An empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        with temporary(spark), small_batches(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete(spark, f"{folder}/{before}")
        before = name
    return docs
