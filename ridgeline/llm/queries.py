"""The operators applied to the tables of a data folder, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_clusters, embedding_dedup, minhash_dedup, mixing, packing, quality_classifier, secret_ledger, sharding, spelling_variants, token_counts
from . import url_rules, vector_graph, warc
from . import sql
from ._store import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, label`` of the training folds: crc32 of the id, modulo 5, is not 0."""
    labels = table(spark, sf_dir, "labels")
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select("doc_id", F.col("quality").alias("label"))


def op1_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.block_labels(table(spark, sf_dir, "labels")))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), 85)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def op6_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 16)
    text = F.coalesce("row.text", F.lit(""))
    digests = {"doc_id": F.col("row.doc_id"), "size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text)}
    return rows.withColumns(digests).drop("row")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, quality_labels(spark, sf_dir))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = mixing.quality_weight(table(spark, sf_dir, "labels"))
    return mixing.mix(table(spark, sf_dir, "documents"), weights).drop("source")


def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents come as a first revision, and all documents as the next, which scans the rest."""
    ledger, docs = new_path(spark, "ledger"), table(spark, sf_dir, "documents")
    secret_ledger.update(docs.where("lang = 'en'"), ledger)
    found = secret_ledger.scan(docs, ledger)
    count = {k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long") for k in ("assign", "access", "hex")}
    spans = secret_ledger.joined(F.col("spans"))
    return found.select(
        "doc_id", *(c.alias(f"n_{k}") for k, c in count.items()), F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans")
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(spelling_variants.words(table(spark, sf_dir, "documents")))


def op13_ball_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_clusters.cluster(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_vector_graph,
        op2_warc_derivatives,
        op3_url_rules,
        op4_minhash_dedup,
        op5_embedding_dedup,
        op6_byte_shards,
        op7_quality_classifier,
        op8_source_mix,
        op9_secret_ledger,
        op10_packing,
        op11_token_counts,
        op12_spelling_variants,
        op13_ball_clusters,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
