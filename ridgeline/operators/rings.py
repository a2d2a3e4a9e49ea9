"""Areas of relations: member ways stitched into closed rings with their roles, broken ones reported."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

STEP = StructType([StructField("ring", IntegerType()), StructField("step", IntegerType()), StructField("way", LongType()), StructField("back", BooleanType())])


def _stitch(ways: list[dict]) -> list[tuple[int, int, int, bool]] | None:
    """The steps of closed rings that use every way once, from the first one on; None where one stays open."""
    at: dict[int, list[int]] = {}
    for n in reversed(range(len(ways))):
        for end in {ways[n]["a"], ways[n]["b"]}:
            at.setdefault(end, []).append(n)
    free, steps, ring = set(range(len(ways))), [], 0
    for first in range(len(ways)):
        if first not in free:
            continue
        free.remove(first)
        steps.append((ring, 0, ways[first]["way"], False))
        home, here, size, step = ways[first]["a"], ways[first]["b"], ways[first]["nodes"], 0
        while here != home:
            open_ = at[here]
            while open_ and open_[-1] not in free:
                open_.pop()
            if not open_:
                return None
            n = open_.pop()
            free.remove(n)
            way = ways[n]
            back = way["a"] != here
            step += 1
            steps.append((ring, step, way["way"], back))
            here, size = way["a"] if back else way["b"], size + way["nodes"] - 1
        if size < 4:
            return None
        ring += 1
    return steps


@F.pandas_udf(ArrayType(STEP))
def stitched(ways: pd.Series) -> pd.Series:
    """Rings of each list of ways (``place, way, a, b, nodes``); null where a way is unknown or a ring stays open."""

    def one(all_):
        rows = sorted(all_, key=lambda w: w["place"])
        if any(w["nodes"] is None or pd.isna(w["nodes"]) or w["nodes"] < 2 for w in rows):
            return None
        return [dict(zip(("ring", "step", "way", "back"), s)) for s in found] if (found := _stitch(rows)) is not None else None

    return pd.Series([one(x) for x in ways])


def areas(relations: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, tags, outer, inner, fault`` of every relation of type multipolygon.

    Members of the role ``outer`` or none make outer rings, of ``inner`` inner ones; other members
    do not count. ``outer`` and ``inner`` are arrays of rings of ``lon, lat``, first point again at the end.
    ``fault`` is null for whole areas, and else says what is wrong: ``no outer ring``, ``open ring`` (also
    a way that is unknown or too short) or ``unknown node``; rings are null then. Only the ends of ways
    pass through Python, a relation's at once, which its number of members bounds; nodes are
    joined by Spark.
    """
    r = relations.where(F.col("tags")["type"] == "multipolygon")
    role = F.when(F.coalesce("m._role", F.lit("")).isin("outer", ""), "outer").when(F.col("m._role") == "inner", "inner")
    members = r.select("id", F.posexplode("member").alias("place", "m")).where(F.col("m._type") == "way")
    members = members.select("id", "place", F.col("m._ref").alias("way"), role.alias("role")).where("role is not null")
    ends = ways.select(F.col("id").alias("way"), F.element_at("nd", 1)["_ref"].alias("a"), F.element_at("nd", -1)["_ref"].alias("b"), F.size("nd").alias("nodes"))
    parts = members.join(ends, "way", "left").groupBy("id", "role").agg(F.collect_list(F.struct("place", "way", "a", "b", "nodes")).alias("ways"))
    parts = parts.select("id", "role", stitched("ways").alias("steps"))
    steps = parts.select("id", "role", F.explode("steps").alias("s")).select("id", "role", "s.*")
    refs = steps.join(ways.select(F.col("id").alias("way"), "nd"), "way").select("id", "role", "ring", "step", "back", "nd", F.posexplode("nd").alias("at", "ref"))
    # In the order of the walk; a way's first node there is the last one of the way before.
    walk = F.when(F.col("back"), F.size("nd") - 1 - F.col("at")).otherwise(F.col("at"))
    refs = refs.select("id", "role", "ring", "step", walk.alias("walk"), F.col("ref._ref").alias("ref")).where("step = 0 or walk > 0")
    point = nodes.select(F.col("id").alias("ref"), F.struct(F.col("_lon").alias("lon"), F.col("_lat").alias("lat")).alias("point"))
    placed = refs.join(point, "ref", "left").groupBy("id", "role", "ring")
    rings = placed.agg(F.array_sort(F.collect_list(F.struct("step", "walk", "point")))["point"].alias("line"), F.bool_or(F.col("point").isNull()).alias("unknown"))
    shaped = rings.groupBy("id", "role").agg(F.array_sort(F.collect_list(F.struct("ring", "line")))["line"].alias("rings"), F.bool_or("unknown").alias("unknown"))
    whole = parts.select("id", "role", F.col("steps").isNull().alias("open")).join(shaped, ["id", "role"], "left")
    facts = whole.groupBy("id").agg(
        F.max_by("rings", F.when(F.col("role") == "outer", 1)).alias("outer"), F.max_by("rings", F.when(F.col("role") == "inner", 1)).alias("inner"),
        F.bool_or("open").alias("open"), F.bool_or("unknown").alias("unknown"), F.count_if(F.col("role") == "outer").alias("outers"),
    )
    fault = (
        F.when(F.coalesce("outers", F.lit(0)) == 0, "no outer ring").when(F.col("open"), "open ring").when(F.coalesce("unknown", F.lit(False)), "unknown node")
    )
    out = r.select("id", "tags").join(facts, "id", "left").withColumn("fault", fault)
    none = F.array().cast(shaped.schema["rings"].dataType)
    return out.select(
        "id", "tags", F.when(F.col("fault").isNull(), F.col("outer")).alias("outer"), F.when(F.col("fault").isNull(), F.coalesce("inner", none)).alias("inner"), "fault"
    )
