"""Areas that meet lines, by a cover of cells that tells inner cells from those on an area's border."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.store import cut
from .lines import segments


def _along(s: DataFrame, side: float) -> DataFrame:
    """Segments (``a, b``) with each cell ``cx, cy`` that they touch, by columns of cells, a hair widened."""
    west, east = F.least("a.x", "b.x"), F.greatest("a.x", "b.x")
    s = s.withColumn("cx", F.explode(F.sequence(F.floor(west / side), F.floor(east / side))))
    steep = (F.col("b.y") - F.col("a.y")) / F.nullif(F.col("b.x") - F.col("a.x"), F.lit(0.0))
    at = lambda x: F.col("a.y") + steep * (x - F.col("a.x"))
    ends = at(F.greatest(west, F.col("cx") * side)), at(F.least(east, (F.col("cx") + 1) * side))
    low = F.greatest(F.least("a.y", "b.y"), F.coalesce(F.least(*ends), F.least("a.y", "b.y"))) - side * 1e-9
    high = F.least(F.greatest("a.y", "b.y"), F.coalesce(F.greatest(*ends), F.greatest("a.y", "b.y"))) + side * 1e-9
    return s.withColumn("cy", F.explode(F.sequence(F.floor(low / side), F.floor(high / side))))


def crosses(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether two closed segments share a point."""
    turn = lambda p, q, r: F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))
    overlap = lambda k: (F.greatest(a[k], b[k]) >= F.least(c[k], d[k])) & (F.greatest(c[k], d[k]) >= F.least(a[k], b[k]))
    return overlap("x") & overlap("y") & (turn(a, b, c) * turn(a, b, d) <= 0) & (turn(c, d, a) * turn(c, d, b) <= 0)


def _inside(points: DataFrame, edges: DataFrame, side: float) -> DataFrame:
    """``points`` (``area, cy, x, y, ...``) inside their area, by the edges that the row of cells at ``y`` meets."""
    rows = F.explode(F.sequence(F.floor(F.least("a.y", "b.y") / side), F.floor(F.greatest("a.y", "b.y") / side)))
    rows = edges.select("area", "a", "b", rows.alias("cy"))
    y, a, b = F.col("y"), F.col("a"), F.col("b")
    left = ((a["y"] > y) != (b["y"] > y)) & (F.col("x") < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])
    met = points.join(rows, ["area", "cy"]).where(left)
    return met.groupBy(*points.columns).count().where("count % 2 = 1").drop("count")


def cover(areas: DataFrame, side: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges of areas (``area, ring`` of ``x, y``) by border cell, inner cells, and edges.

    A cell that no edge touches is inside or outside as a whole, and so is a run of such cells of a
    row between two border cells: one point of it is tested for all.
    """
    ring = areas.where(F.size("ring") >= 3).select(F.col("area").alias("id"), F.concat("ring", F.slice("ring", 1, 1)).alias("points"))
    edges = cut(segments(ring).select(F.col("id").alias("area"), "a", "b"))
    border = cut(_along(edges, side))
    row = Window.partitionBy("area", "cy").orderBy("cx")
    cells = border.select("area", "cx", "cy").distinct().withColumn("next", F.lead("cx").over(row))
    runs = cells.where("next > cx + 1").select("area", "cy", F.col("cx").alias("first"), "next")
    centre = runs.withColumns({"x": (F.col("first") + 1.5) * side, "y": (F.col("cy") + 0.5) * side})
    inner = _inside(centre, edges, side).select("area", "cy", F.explode(F.sequence(F.col("first") + 1, F.col("next") - 1)).alias("cx"))
    return border, inner, edges


def meeting(areas: DataFrame, lines: DataFrame, side: float) -> DataFrame:
    """``area, line``: areas (``area, ring``) and lines (``id, points``) that share a point; borders count.

    A line meets an area where one of its segments meets an edge, found by the cells that both
    touch, or else lies in it whole, as its first vertex does: in an inner cell without a test, in
    a border cell by the edges of its row. So the work of an area is dealt by its cells, however
    large it is. Rings of fewer than three corners, and null rings and lines, meet nothing; a line
    of one vertex is that point. ``side`` is a matter of speed: a few times a segment's length.
    """
    border, inner, edges = cover(areas, side)
    path = lines.where(F.size("points") >= 1).select("id", F.when(F.size("points") == 1, F.concat("points", "points")).otherwise(F.col("points")).alias("points"))
    s = _along(segments(path).select(F.col("id").alias("line"), F.col("a").alias("p"), F.col("b").alias("q")).withColumnsRenamed({"p": "a", "q": "b"}), side)
    s = s.withColumnsRenamed({"a": "p", "b": "q"})
    crossing = border.join(s, ["cx", "cy"]).where(crosses(F.col("a"), F.col("b"), F.col("p"), F.col("q"))).select("area", "line")
    first = path.select(F.col("id").alias("line"), F.col("points")[0]["x"].alias("x"), F.col("points")[0]["y"].alias("y"))
    first = first.withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})
    whole = first.join(inner, ["cx", "cy"]).select("area", "line")
    near = first.join(border.select("area", "cx", "cy").distinct(), ["cx", "cy"]).select("area", "line", "cy", "x", "y")
    return crossing.unionByName(whole).unionByName(_inside(near, edges, side).select("area", "line")).distinct()
