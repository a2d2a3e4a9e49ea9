"""Packages of pages named by their contents: a new version writes only the pages that changed.

A package is a folder: ``pages`` holds ``digest, bytes, body, version`` in folders by the digest's
first two digits, ``version`` being the one that brought the page, and ``index/version=...``
says which digest each page of a version has.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STORED = "digest string, bytes long, body string, version string, slot string"


def _stored(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(STORED).parquet(f"{path}/pages")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED)


def _row(df: DataFrame, page: str) -> Column:
    quoted = (f"`{c.replace('`', '``')}`" for c in df.columns if c != page)
    return F.to_json(F.struct(*quoted), {"ignoreNullFields": "false"})


def write_pages(df: DataFrame, path: str, page: str, version: str, budget: int = 16 << 20) -> DataFrame:
    """Write ``df`` as the pages of one ``version`` and return ``page, digest, bytes, fresh``.

    A page is the rows with one value of ``page`` (not null), as JSON lines in binary order, so
    the order of ``df`` does not matter; repeated rows and nulls stay. ``fresh`` pages have contents
    that this version brought. Pages of equal contents are stored once. Sizes are summed
    before any page is put together, and a page over ``budget`` bytes is an error then: a
    page becomes one row. An empty table makes a version without pages.

    Pages are written before the index, and readers go by the index: a run that dies leaves
    pages that nothing names yet, and its rerun finds them. A version with an index is
    not written again. One writer at a time.
    """
    spark, index = df.sparkSession, f"{path}/index/version={version}"
    rows = df.select(F.col(page).alias("page"), _row(df, page).alias("row"))
    sizes = rows.groupBy("page").agg(F.sum(F.octet_length("row") + 1).alias("bytes"))
    wrong = sizes.where((F.col("bytes") > budget) | F.col("page").isNull()).limit(1).collect()
    if wrong and wrong[0].page is None:
        raise ValueError(f"rows without {page}")
    if wrong:
        raise ValueError(f"page {wrong[0].page} has {wrong[0].bytes} bytes, and {budget} are allowed")
    made = rows.groupBy("page").agg(F.array_join(F.array_sort(F.collect_list("row")), "\n").alias("body"))
    made = made.select("page", F.sha2("body", 256).alias("digest"), F.octet_length("body").cast("long").alias("bytes"), "body")
    new = made.join(_stored(spark, path).select("digest"), "digest", "left_anti").dropDuplicates(["digest"])
    new = new.select("digest", "bytes", "body", F.lit(version).alias("version"), F.substring("digest", 1, 2).alias("slot"))
    new.repartition("slot").write.partitionBy("slot").mode("append").parquet(f"{path}/pages")
    made.select("page", "digest", "bytes").write.mode("errorifexists").parquet(index)
    brought = _stored(spark, path).where(F.col("version") == version).select("digest").distinct().withColumn("_new", F.lit(True))
    written = spark.read.schema(made.select("page", "digest", "bytes").schema).parquet(index)
    return written.join(brought, "digest", "left").select("page", "digest", "bytes", F.col("_new").isNotNull().alias("fresh"))


def read_pages(spark: SparkSession, path: str, version: str, schema: str, pages: DataFrame | None = None) -> DataFrame:
    """``page`` and the columns of ``schema`` of a version, or of the ``pages`` (column ``page``) of it.

    A body is checked against its digest: one that is missing or that does not fit is an error
    and not a smaller result. The slots asked for are pruned where the join is broadcast.
    """
    asked = spark.read.parquet(f"{path}/index/version={version}").select("page", "digest", F.substring("digest", 1, 2).alias("slot"))
    if pages is not None:
        asked = asked.join(pages.select("page"), "page", "left_semi")
    bodies = _stored(spark, path).select("digest", "slot", "body").dropDuplicates(["digest"])
    fits = F.coalesce(F.sha2("body", 256) == F.col("digest"), F.lit(False))
    body = F.when(fits, F.col("body")).otherwise(F.raise_error(F.concat(F.lit("missing or damaged page "), F.col("digest"))))
    lines = asked.join(bodies, ["digest", "slot"], "left").select("page", F.explode(F.split(body, "\n")).alias("row"))
    return lines.select("page", F.from_json("row", schema).alias("r")).select("page", "r.*")
