"""Contiguous shards of near equal bytes, by global prefix sums (native)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._prefix import prefix_sums
from ._store import materialize


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, row`` for every row.

    ``row`` holds all columns of the row itself, so the shards can be written or read on.
    Rows stand in order of id (then checksum and size; null ids first). The running sum of
    their sizes is cut at equal targets: a row goes to the shard that holds the middle of
    its bytes, so each shard is a contiguous run and misses its target by less than a row at
    each end. ``slot`` counts the rows of a shard from 0. Size is the UTF-8 bytes of the text
    and 1; a null text counts as empty. The law is ``bytes``, so ``grown_shard`` is null.
    Repeated rows each have their slot. Fewer rows than shards leave shards empty; an empty
    table gives an empty result.
    """
    text = F.coalesce(text_col, F.lit(""))
    # Ids repeat and may be null: a number written with each row joins it to its place.
    rows = docs.select(
        F.monotonically_increasing_id().alias("nth"),
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit(1).cast("long").alias("one"),
    )
    rows = materialize(rows)
    placed = materialize(prefix_sums(rows.drop("row"), ["doc_id", "text_crc32", "size", "nth"], ["size", "one"]))
    total = placed.agg(F.sum("size")).first()[0] or 1
    # Whole numbers throughout: a double would misplace rows beyond 2**53.
    shard = F.expr(f"cast((size_before * 2 + size) * {shards} div {2 * total} as int)")
    return _slots(placed.withColumn("shard", shard)).join(rows.select("nth", "row"), "nth").drop("nth")


def _slots(placed: DataFrame) -> DataFrame:
    """Number the rows of each shard from its first row; one row a shard is joined."""
    first = placed.groupBy("shard").agg(F.min("one_before").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "nth",
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("one_before") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
