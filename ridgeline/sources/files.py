"""Readers and writers of ride and place files, all through Spark's own formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "_lat double, _lon double, ele double, time timestamp"
OSM = {
    "node": "_id long, _lat double, _lon double, tag array<struct<_k:string,_v:string>>",
    "way": "_id long, nd array<struct<_ref:long>>, tag array<struct<_k:string,_v:string>>",
    "relation": "_id long, member array<struct<_type:string,_ref:long,_role:string>>, tag array<struct<_k:string,_v:string>>",
}


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """``file, lat, lon, ele, time`` of all track points; a missing height or time is null."""
    rows = spark.read.format("xml").option("rowTag", "trkpt").schema(POINT).load(path)
    return rows.select(F.input_file_name().alias("file"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), "ele", "time")


def read_osm(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Objects of one kind of an OSM XML file, with their tags as a map."""
    rows = spark.read.format("xml").option("rowTag", kind).schema(OSM[kind]).load(path)
    pairs = F.transform(F.coalesce("tag", F.array().cast(rows.schema["tag"].dataType)), lambda t: F.struct(t["_k"], t["_v"]))
    return rows.withColumn("tags", F.map_from_entries(pairs)).drop("tag").withColumnRenamed("_id", "id")


def way_lines(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, tags, line, missing, closed`` of every way: its known nodes in order, and how many are not known.

    ``closed`` says that a way of four nodes or more ends where it begins. A way none of whose
    nodes is known has an empty line, so no way is lost; a closed one with missing nodes is no
    whole ring.
    """
    refs = ways.select("id", F.posexplode("nd").alias("place", "nd"))
    at = nodes.select(F.col("id").alias("ref"), F.struct(F.col("_lon").alias("lon"), F.col("_lat").alias("lat")).alias("point"))
    met = refs.join(at, F.col("nd._ref") == F.col("ref"), "left")
    known = F.collect_list(F.when(F.col("point").isNotNull(), F.struct("place", "point")))
    lines = met.groupBy("id").agg(F.array_sort(known)["point"].alias("line"), F.count_if(F.col("point").isNull()).alias("missing"))
    closed = (F.size("nd") >= 4) & (F.element_at("nd", 1)["_ref"] == F.element_at("nd", -1)["_ref"])
    none = F.array().cast(lines.schema["line"].dataType)
    return ways.select("id", "tags", F.coalesce(closed, F.lit(False)).alias("closed")).join(lines, "id", "left").select(
        "id", "tags", F.coalesce("line", none).alias("line"), F.coalesce("missing", F.lit(0)).alias("missing"), "closed"
    )


def read_envelopes(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows of a JSON-lines dump (compressed or not), and the lines that do not parse."""
    parsed = F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    rows = spark.read.text(path).select("value", parsed.alias("r"))
    return rows.where("r._corrupt is null").select("r.*").drop("_corrupt"), rows.where("r._corrupt is not null").select("value")


def write_cells(df: DataFrame, path: str, cell: str = "cell") -> None:
    """One folder for each cell, so that a bound on cells prunes; large cells span several files."""
    df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(8))).repartition(cell, "_salt").drop("_salt").write.partitionBy(
        cell
    ).mode("errorifexists").parquet(path)


def write_rides(df: DataFrame, path: str) -> None:
    """Samples as CSV with a header."""
    df.write.option("header", True).mode("errorifexists").csv(path)


def read_inserts(spark: SparkSession, path: str, table: str, columns: list[str]) -> DataFrame:
    """Rows of ``INSERT INTO`` lines of an SQL dump, as strings by column name; NULL is null.

    A dump has one statement a line. Quotes may hold commas, brackets and escaped quotes.
    Lines of other tables are skipped; codecs are Spark's.
    """
    head = f"^INSERT INTO `?{table}`? (?:\\([^)]*\\) )?VALUES "
    lines = spark.read.text(path).where(F.col("value").rlike(head))
    field = r"'(?:[^'\\]|\\.|'')*'|[^,()']+"
    tuples = F.regexp_extract_all(F.regexp_replace("value", head, ""), F.lit(rf"\(((?:{field})(?:,(?:{field}))*)\)"), 1)
    values = F.regexp_extract_all(F.col("t"), F.lit(f"({field})"), 1)
    plain = lambda v: F.when(v == "NULL", None).when(
        v.startswith("'"), F.regexp_replace(F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit("''"), F.lit("'")), r"\\(.)", "$1")
    ).otherwise(F.trim(v))
    rows = lines.select(F.explode(tuples).alias("t")).select(F.transform(values, plain).alias("v"))
    return rows.select(*(F.get("v", F.lit(k)).alias(c) for k, c in enumerate(columns)))


def write_gpx(df: DataFrame, path: str, key: str, order: str) -> None:
    """One GPX document a ride, as lines of text under a folder of its ``key``.

    ``df`` has ``lat, lon`` and may have ``ele``. A ride's points stay in order.
    """
    ele = F.when(F.col("ele").isNotNull(), F.concat(F.lit("<ele>"), F.col("ele").cast("string"), F.lit("</ele>"))) if "ele" in df.columns else F.lit(None)
    point = F.format_string('<trkpt lat="%s" lon="%s">%s</trkpt>', F.col("lat").cast("string"), F.col("lon").cast("string"), F.coalesce(ele, F.lit("")))
    start, end = '<gpx version="1.1" creator="ridgeline" xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg>', "</trkseg></trk></gpx>"
    points = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), point.alias("p"))))
    text = F.concat(F.lit(start), F.array_join(F.transform(points, lambda x: x["p"]), "\n"), F.lit(end))
    df.groupBy(key).agg(text.alias("value")).write.partitionBy(key).mode("errorifexists").text(path)


def write_package(df: DataFrame, path: str, kind: str) -> DataFrame:
    """Write a table once and return its counts by ``kind``, read back from what was written."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path).groupBy(kind).agg(F.count("*").alias("rows"))


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace the partitions that ``df`` has rows of; others stay."""
    df.write.option("partitionOverwriteMode", "dynamic").partitionBy(by).mode("overwrite").parquet(path)
