"""Operators on ways and tables of places: nearest ways, simple lines, numbers along a line, order, checks."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import geo
from ..functions.store import cut
from .lines import _covering, segments


#: Shares of the radius that are searched one after the other.
STEPS = (1 / 16, 1 / 4, 1)


def nearest_way(points: DataFrame, lines: DataFrame, most: float) -> DataFrame:
    """``id, way, segment, metres``: the way nearest to each point (``id, x, y``) within ``most``.

    Equal to the micrometre, the smaller way and segment stand. Points of one place are searched
    once, and of equal segments only the first can be an answer. The radius widens in ``STEPS``
    for places that found nothing yet, so crowded places meet near segments alone. A segment is
    filed under the cells that it comes within the radius of, column by column, and a point
    under its own. The best is kept by a map-side combined aggregate.
    """
    segment = segments(lines).groupBy("a", "b").agg(F.min(F.struct(F.col("id").alias("way"), F.col("n").alias("segment"))).alias("s"))
    segment = cut(segment.select("s.way", "s.segment", "a", "b"))
    points = points.select("id", "x", "y")
    left, found = cut(points.select("x", "y").where("x is not null and y is not null").distinct()), []
    for share in STEPS:
        radius = most * share
        best = _nearest_within(left, segment, radius)
        # At the rim, a smaller way just outside may be as near to the micrometre.
        best = cut(best if share == STEPS[-1] else best.where(F.col("b.metres") < radius - 1e-6))
        found.append(best)
        if share != STEPS[-1]:
            left = cut(left.join(best, ["x", "y"], "left_anti"))
    all_ = found[0]
    for more in found[1:]:
        all_ = all_.unionByName(more)
    return points.join(all_, ["x", "y"]).select("id", "b.way", "b.segment", "b.metres")


def _nearest_within(places: DataFrame, segment: DataFrame, radius: float) -> DataFrame:
    side = max(radius, 1.0)
    ax, ay, bx, by = (F.col(c) for c in ("a.x", "a.y", "b.x", "b.y"))
    # A little wider than the radius, for the rounding of the cut at a column.
    wide = radius * 1.001
    s = segment.withColumn("cx", F.explode(_covering(F.least(ax, bx) - wide, F.greatest(ax, bx) + wide, side)))
    # What of the segment lies within the radius of the column.
    at = lambda x: F.when(ax == bx, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - ax) / F.nullif(bx - ax, F.lit(0.0)))))
    low, high = at(F.col("cx") * side - wide), F.when(ax == bx, 1.0).otherwise(at((F.col("cx") + 1) * side + wide))
    y0, y1 = ay + (by - ay) * low, ay + (by - ay) * high
    s = s.withColumn("cy", F.explode(_covering(F.least(y0, y1) - wide, F.greatest(y0, y1) + wide, side)))
    # Both tables are small beside their pairs, so a number of parts is set: one task would do the work otherwise.
    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at_ = places.withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)}).repartition(parts, "cx", "cy")
    s = s.repartition(parts, "cx", "cy")
    metres, _ = geo.on_segment(*(F.col(c) for c in ("x", "y", "a.x", "a.y", "b.x", "b.y")))
    hits = at_.join(s, ["cx", "cy"]).select("x", "y", "way", "segment", metres.alias("metres")).where(F.col("metres") <= radius)
    return hits.groupBy("x", "y").agg(F.min(F.struct(F.round("metres", 6).alias("metres"), "way", "segment")).alias("b"))


@F.pandas_udf(ArrayType(IntegerType()))
def simplified(xs: pd.Series, ys: pd.Series, most: pd.Series) -> pd.Series:
    """Numbers of the vertices that stay when none is left out farther than ``most`` from its chord.

    A stretch is split at its farthest vertex (the first of equals) until all are near. The
    chord counts as a segment, so a way back along it is kept. A line is one array.
    """

    def one(x, y, tolerance):
        x, y = np.asarray(x, float), np.asarray(y, float)
        keep, todo = {0, len(x) - 1}, [(0, len(x) - 1)]
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            dx, dy, px, py = x[b] - x[a], y[b] - y[a], x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
            size = dx * dx + dy * dy
            t = np.clip((px * dx + py * dy) / size, 0, 1) if size > 0 else np.zeros(len(px))
            far = np.sqrt((px - t * dx) ** 2 + (py - t * dy) ** 2)
            m = int(far.argmax())
            if far[m] > tolerance:
                keep.add(a + 1 + m)
                todo += [(a, a + 1 + m), (a + 1 + m, b)]
        return sorted(k for k in keep if k >= 0)

    return pd.Series([None if x is None else one(x, y, t) for x, y, t in zip(xs, ys, most)])


def numbers_along(ranges: DataFrame, most: int = 600) -> DataFrame:
    """``id, number, x, y``: the house numbers inside a range, at their share of the way along a line (``points``).

    ``ranges`` has ``id, first, last, kind, points``: the numbers at the line's begin and end, rising or
    falling, and ``odd``, ``even``, ``all`` or a step of one digit. The end numbers themselves are
    known houses and not given. A range whose ends are no more than a step apart, whose inner
    numbers span ``most`` or more, of another kind, or with a null end gives none.
    """
    kind = F.col("kind")
    parity = kind.isin("odd", "even")
    step = F.when(parity, 2).when(kind == "all", 1).when(kind.rlike("^[1-9]$"), kind.try_cast("int"))
    low, high = F.least("first", "last"), F.greatest("first", "last")
    next_ = low + F.when(parity, 1).otherwise(F.col("step"))
    wrong = (parity & (F.pmod(next_, F.lit(2)) != F.when(kind == "odd", 1).otherwise(0))).cast("int")
    good = ranges.withColumn("step", step).where(F.col("first").isNotNull() & F.col("last").isNotNull() & (F.size("points") >= 2)).withColumn("from_", next_ + wrong)
    good = good.withColumn("to_", F.col("from_") + F.floor((high - 1 - F.col("from_")) / F.col("step")) * F.col("step"))
    good = good.where((F.abs(F.col("last") - F.col("first")) > F.col("step")) & (F.col("to_") >= F.col("from_")) & (F.col("to_") - F.col("from_") < most))
    s = good.select("id", F.posexplode(geo.segments(F.col("points"))).alias("n", "s")).withColumn("size", geo.planar(F.col("s.a"), F.col("s.b")))
    w = Window.partitionBy("id").orderBy("n")
    s = s.withColumn("to", F.sum("size").over(w)).withColumn("from", F.col("to") - F.col("size")).withColumn("whole", F.max("to").over(Window.partitionBy("id")))
    numbers = good.select("id", "first", "last", F.explode(F.sequence("from_", "to_", "step")).alias("number"))
    # Counted from the end of the first number, whichever way the numbers go.
    place = F.col("whole") * F.abs(F.col("number") - F.col("first")) / F.abs(F.col("last") - F.col("first"))
    inside = (place <= F.col("to")) & ((place > F.col("from")) | ((place == 0) & (F.col("n") == 0)))
    met = numbers.join(s, "id").withColumn("place", place).where(inside)
    share = (F.col("place") - F.col("from")) / F.nullif(F.col("size"), F.lit(0.0))
    lerp = lambda c: F.col(f"s.a.{c}") + (F.col(f"s.b.{c}") - F.col(f"s.a.{c}")) * F.coalesce(share, F.lit(0.0))
    return met.select("id", "number", lerp("x").alias("x"), lerp("y").alias("y"))


@F.pandas_udf(ArrayType(IntegerType()))
def forward_matches(vertices: pd.Series, samples: pd.Series) -> pd.Series:
    """For each vertex's key the first sample of that key at or after the last match, from 0; else null."""

    def one(keys, held):
        places: dict = {}
        for n, k in enumerate(held):
            places.setdefault(k, []).append(n)
        at, out = 0, []
        for k in keys:
            known = places.get(k, [])
            i = bisect.bisect_left(known, at)
            out.append(known[i] if i < len(known) else None)
            at = out[-1] if out[-1] is not None else at
        return out

    return pd.Series([None if v is None or s is None else one(v, s) for v, s in zip(vertices, samples)])


def numbered(df: DataFrame, order: list[str], name: str = "nth") -> DataFrame:
    """A total order: rows numbered from 0 by ``order``, which tells all rows apart.

    Rows are dealt by range; each partition numbers its own and adds the counts of those
    before, so nothing is sorted in one place. The dealt rows are written once.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # As many rows as partitions.
    starts = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.join(starts, "_part").withColumn(name, F.col("_start") + own).drop("_part", "_start")


def memberships(records: DataFrame, key: str, parts: dict[str, DataFrame]) -> DataFrame:
    """``records`` with ``has_<name>`` for each table of ``parts`` (of one column, ``key``)."""
    for name, part in parts.items():
        flag = part.select(key).where(F.col(key).isNotNull()).distinct().withColumn(f"has_{name}", F.lit(True))
        records = records.join(flag, key, "left").withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))
    return records


def first_fault(rules: dict[str, Column]) -> Column:
    """The name of the first rule that a row breaks (a null condition breaks it); null for a sound row."""
    return F.coalesce(*(F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()))


def reduced_cover(areas: DataFrame) -> DataFrame:
    """``area`` of those that stay when the largest that the others still cover goes, again and again.

    ``areas`` has ``area, cell``. Of equal sizes the smaller name goes first. Whether an area goes
    depends only on larger ones that share a cell with it, so in a round all go that are first
    in each of their cells; areas apart do not wait for each other. A null area stays.
    """
    left = cut(areas.select("area", "cell").distinct())
    while True:
        many = left.groupBy("cell").agg(F.count("*").alias("n"))
        spare = left.join(many, "cell").groupBy("area").agg(F.count("*").alias("size"), F.min("n").alias("least")).where("least > 1")
        # The first of a cell: the largest, then the smallest name.
        held = left.join(spare.select("area", "size"), "area")
        first = held.groupBy("cell").agg(F.min(F.struct(-F.col("size"), F.col("area"))).alias("first"))
        goes = held.join(first, "cell").groupBy("area").agg(F.bool_and(F.col("first.area") == F.col("area")).alias("goes"))
        goes = cut(goes.where("goes").select("area"))
        if goes.isEmpty():
            return left.select("area").distinct()
        left = cut(left.join(goes, "area", "left_anti"))


def budget_cells(points: DataFrame, depth: int, most: int) -> DataFrame:
    """``level, x, y, size``: the largest squares whose rows have at most ``most`` bytes, the least ones with more.

    ``points`` has whole ``x, y`` below ``2 ** depth`` and ``size``; a square of a level is
    ``2 ** level`` wide. Sizes of all levels come from those of the least squares.
    """
    unit = points.groupBy("x", "y").agg(F.sum("size").alias("size"))
    every = unit.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    wide = lambda c: F.expr(f"shiftright({c}, level)").alias(c)
    sizes = every.groupBy("level", wide("x"), wide("y")).agg(F.sum("size").alias("size"))
    up = sizes.select((F.col("level") - 1).alias("level"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("size").alias("_size"))
    at = sizes.withColumns({"_x": F.shiftright("x", 1), "_y": F.shiftright("y", 1)}).join(up, ["level", "_x", "_y"], "left")
    return at.where(((F.col("size") <= most) | (F.col("level") == 0)) & (F.col("_size").isNull() | (F.col("_size") > most))).select("level", "x", "y", "size")


def clipped(lines: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """``id, part, n, ax, ay, bx, by``: what of each segment ``n`` lies in a box, in parts that go on without a gap.

    ``lines`` has ``id, points`` (structs ``x, y``); the box is ``west, south, east, north``.
    What only touches the box is left out. A line's segments are one window.
    """
    s = segments(lines)
    enter, leave = [F.lit(0.0)], [F.lit(1.0)]
    for axis, low, high in (("x", box[0], box[2]), ("y", box[1], box[3])):
        a = F.col(f"a.{axis}")
        way = F.col(f"b.{axis}") - a
        ends = (F.lit(low) - a) / F.nullif(way, F.lit(0.0)), (F.lit(high) - a) / F.nullif(way, F.lit(0.0))
        enter.append(F.when(way != 0, F.least(*ends)).when(a.between(low, high), 0.0).otherwise(2.0))
        leave.append(F.when(way != 0, F.greatest(*ends)).otherwise(1.0))
    s = s.withColumn("_in", F.greatest(*enter)).withColumn("_out", F.least(*leave)).where("_in < _out")
    w = Window.partitionBy("id").orderBy("n")
    goes_on = (F.col("_in") == 0) & (F.lag("_out").over(w) == 1) & (F.lag("n").over(w) == F.col("n") - 1)
    s = s.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("part", F.sum("_new").over(w))
    at = lambda axis, t: F.col(f"a.{axis}") + (F.col(f"b.{axis}") - F.col(f"a.{axis}")) * F.col(t)
    return s.select("id", "part", "n", at("x", "_in").alias("ax"), at("y", "_in").alias("ay"), at("x", "_out").alias("bx"), at("y", "_out").alias("by"))
