"""Spatial joins by cells: an equal join on grid cells, then the exact test.

A cell is as high as the search radius, and its row of latitude sets how wide it is: the
rows above and below are cut by the widths of their own, and a point is filed there under
all cells that the radius can reach. Longitudes go round, so cells meet at 180 degrees.
Distances are equirectangular metres.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.store import cut


def cells(df: DataFrame, radius: float | Column, spread: bool, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Adds the cell ``cx, cy``; with ``spread``, a row for each cell that ``radius`` reaches.

    ``radius`` may be a column; cells of different radii are then different grids.

    A row of cells is cut into as many parts of the circle as are no narrower than the radius
    at its end next to the equator. The reach is taken at the end of the three rows next to
    the pole, where it is widest; near a pole it is the whole circle, of few cells there.
    """
    side = radius / geo.METRES_PER_DEGREE * 1.001
    row = lambda k: F.least(F.abs(k), F.abs(k + 1)) * side
    parts = lambda k: F.greatest(F.floor(F.cos(F.radians(F.least(row(k), F.lit(90.0)))) * (360 / side)), F.lit(1))
    turn = F.col(lon) / 360 - F.floor(F.col(lon) / 360)
    df = df.withColumn("cy", F.floor(F.col(lat) / side))
    if not spread:
        n = parts(F.col("cy"))
        return df.withColumn("cx", F.least(F.floor(turn * n), n - 1))
    # Two points whose mean latitude is m are side / cos(m) of longitude apart at most.
    mean = F.least(F.abs(F.col(lat)) + side / 2, F.lit(90.0))
    reach = F.least(F.lit(side) / F.greatest(F.cos(F.radians(mean)), F.lit(1e-9)) / 360, F.lit(0.5))
    df = df.withColumns({"_turn": turn, "_reach": reach, "cy": F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1))}).withColumn("_parts", parts(F.col("cy")))
    low, high = F.floor((F.col("_turn") - F.col("_reach")) * F.col("_parts")), F.floor((F.col("_turn") + F.col("_reach")) * F.col("_parts"))
    high = F.least(high, low + F.col("_parts") - 1)
    return df.withColumn("cx", F.explode(F.sequence(low, high))).withColumn("cx", F.pmod("cx", "_parts")).drop("_turn", "_reach", "_parts")


def near_pairs(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """All pairs within ``radius``: ``left_id, right_id, metres`` (both have ``id, lon, lat``).

    The pairs are the answer here, and grow with the square of the density.

    Columns of ``left`` and ``right`` beyond these come along with their prefix.
    """
    a = cells(left, radius, False).withColumnsRenamed({c: f"left_{c}" for c in left.columns})
    b = cells(right, radius, True).withColumnsRenamed({c: f"right_{c}" for c in right.columns})
    metres = geo.flat_distance(F.col("left_lon"), F.col("left_lat"), F.col("right_lon"), F.col("right_lat"))
    return a.join(b, ["cx", "cy"]).withColumn("metres", metres).where(F.col("metres") <= radius).drop("cx", "cy")


def nearest(left: DataFrame, right: DataFrame, radius: float, n: int = 1, by: list[str] | None = None, levels: int = 12) -> DataFrame:
    """Each left row's ``n`` nearest within ``radius`` (for each value of ``by``), by metres, then id.

    ``by`` names columns of ``right`` with their prefix. Where a small cell alone holds ``n``
    rows of a group, no place in it needs to look further than the cell is long, so every left
    row searches each group in the narrowest of ``levels`` radii (each 0.71 of the one before)
    that is sure to hold the answer, and pairs grow with the answers and not with the density.
    Of equal places only the ``n`` least ids can be an answer. Equal left rows count once.
    """
    radii = [radius / 2 ** (i / 2) for i in range(levels)]
    group = F.struct(*(F.col(c.removeprefix("right_")) for c in by)) if by else F.struct(F.lit(0).alias("all"))
    r = right.withColumn("_g", group)
    r = r.withColumn("_k", F.row_number().over(Window.partitionBy("_g", "lon", "lat").orderBy("id"))).where(F.col("_k") <= n).drop("_k")
    # A cell of 0.7 of a radius is shorter than the radius from corner to corner, but where a row of cells has few parts.
    step = F.explode(F.array(*(F.struct(F.lit(0.7 * x).alias("_t"), F.lit(x).alias("_r")) for x in radii[1:]))).alias("_s")
    tests = r.select("_g", "lon", "lat", step).select("_g", "lon", "lat", "_s.*")
    tests = tests.where(F.cos(F.radians("lat")) * 360 * geo.METRES_PER_DEGREE >= 250 * F.col("_t"))
    full = cells(tests, F.col("_t"), False).groupBy("_g", "_t", "_r", "cx", "cy").agg(F.count("*").alias("_n")).where(F.col("_n") >= n).drop("_n")
    widest = cells(r.select("_g", "lon", "lat"), radius, True).select("_g", F.lit(radius).alias("_t"), F.lit(radius).alias("_r"), "cx", "cy").distinct()
    at = cells(left.withColumn("_t", F.explode(F.array(F.lit(radius), *(F.lit(0.7 * x) for x in radii[1:])))), F.col("_t"), False)
    asked = at.join(full.unionByName(widest), ["_t", "cx", "cy"]).groupBy(*left.columns, "_g").agg(F.min("_r").alias("_r"))
    return _ranked(_met(asked, r, radii, ["_g"]), n, ["_g"]).drop("_g")


def _met(left: DataFrame, right: DataFrame, radii: list[float], also: list[str]) -> DataFrame:
    """Pairs within the left row's own radius ``_r``, one of ``radii``, that agree in ``also``."""
    keys = ["_r", "cx", "cy", *also]
    a = cells(left, F.col("_r"), True)
    a = a.withColumnsRenamed({c: f"left_{c}" for c in left.columns if c not in keys})
    b = cells(right.withColumn("_r", F.explode(F.array(*map(F.lit, radii)))), F.col("_r"), False)
    b = b.withColumnsRenamed({c: f"right_{c}" for c in right.columns if c not in keys})
    metres = geo.flat_distance(F.col("left_lon"), F.col("left_lat"), F.col("right_lon"), F.col("right_lat"))
    return a.join(b, keys).withColumn("metres", metres).where(F.col("metres") <= F.col("_r")).drop("cx", "cy")


def _ranked(pairs: DataFrame, n: int, also: list[str]) -> DataFrame:
    w = Window.partitionBy("left_id", *also).orderBy("metres", "right_id")
    return pairs.drop("_r").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def snap(left: DataFrame, right: DataFrame, radii: list[float], band: float = 3.0, most: int = 8) -> DataFrame:
    """Candidates within ``band`` of the nearest, at most ``most``, in the first radius that has any.

    They are the first of the ``most`` nearest rows within the widest radius.
    """
    near = nearest(left, right, max(radii), most)
    near = near.withColumn("least", F.min("metres").over(Window.partitionBy("left_id")))
    tier = F.coalesce(*(F.when(F.col("least") <= r, F.lit(float(r))) for r in sorted(radii)))
    return near.where(F.col("metres") <= F.col("least") + band).withColumn("radius", tier).where("metres <= radius")


def widened(left: DataFrame, right: DataFrame, radii: list[float]) -> DataFrame:
    """All pairs of each left row in the smallest of ``radii`` that holds any, with that radius as ``tier``.

    The nearest row tells the radius, so no row is joined in a wider one. ``left`` has
    ``id, lon, lat``; columns of ``right`` come along with their prefix.
    """
    slim = left.select("id", "lon", "lat")
    least = nearest(slim, right.select("id", "lon", "lat"), max(radii)).select("left_id", "left_lon", "left_lat", "metres")
    tier = F.coalesce(*(F.when(F.col("metres") <= r, F.lit(float(r))) for r in sorted(radii)))
    asked = least.select(F.col("left_id").alias("id"), F.col("left_lon").alias("lon"), F.col("left_lat").alias("lat"), tier.alias("_r"))
    return _met(asked, right, [float(r) for r in radii], []).withColumnRenamed("_r", "tier")


def within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Rows of ``left`` that have a right row within ``radius`` (a semi-join on the nearest one)."""
    hit = nearest(left.select("id", "lon", "lat"), right.select("id", "lon", "lat"), radius).select(F.col("left_id").alias("id"))
    return left.join(hit, "id", "left_semi")


def containing(points: DataFrame, areas: DataFrame, side: float) -> DataFrame:
    """``id, area`` of points in areas (``area, ring`` of structs ``x, y``), borders included.

    An area is filed under every cell of ``side`` degrees that its box touches.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    floor = lambda c: F.floor(c / side)
    covered = areas.withColumn("cx", F.explode(F.sequence(floor(F.array_min(xs)), floor(F.array_max(xs)))))
    covered = covered.withColumn("cy", F.explode(F.sequence(floor(F.array_min(ys)), floor(F.array_max(ys)))))
    at = points.withColumn("cx", floor(F.col("lon"))).withColumn("cy", floor(F.col("lat")))
    return at.join(covered, ["cx", "cy"]).where(geo.inside(F.col("lon"), F.col("lat"), F.col("ring"))).select("id", "area")


def spaced(df: DataFrame, same: list[str], radius: float, rank: list[Column]) -> DataFrame:
    """Rows that stay when each, in order of rank, drops later ones of its kind within ``radius``.

    Pairs of close rows of one kind are found by cells. Then rounds decide: a row with no
    better undecided neighbour stays and its neighbours go. ``df`` has ``id, lon, lat``.
    """
    slim = df.select("id", "lon", "lat", *same, F.struct(*rank, "id").alias("r"))
    a = cells(slim, radius, False).withColumnsRenamed({c: f"a_{c}" for c in ("id", "lon", "lat", "r")})
    b = cells(slim, radius, True).withColumnsRenamed({c: f"b_{c}" for c in ("id", "lon", "lat", "r")})
    metres = geo.flat_distance(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"))
    pairs = a.join(b, ["cx", "cy", *same]).where((F.col("a_r") < F.col("b_r")) & (metres <= radius))
    open_ = cut(pairs.select(F.col("a_id").alias("better"), F.col("b_id").alias("worse")))
    gone = None
    while not open_.isEmpty():
        waiting = open_.select(F.col("worse").alias("better")).distinct()
        winners = open_.select("better").distinct().join(waiting, "better", "left_anti")
        lost = cut(open_.join(winners, "better", "left_semi").select("worse").distinct())
        gone = lost if gone is None else gone.unionByName(lost)
        open_ = open_.join(lost, "worse", "left_anti").join(lost.withColumnRenamed("worse", "better"), "better", "left_anti")
        open_ = cut(open_)
    return df if gone is None else df.join(gone.withColumnRenamed("worse", "id"), "id", "left_anti")


def pyramid(leaf: DataFrame, zoom: int) -> DataFrame:
    """``z, x, y, v, snow`` of tiles of ``zoom`` and all their parents.

    A parent has the mean of its known children and the flag that most of them have. Each
    level aggregates the one below, so a level is four times smaller than the last.
    """
    level = leaf.select(F.lit(zoom).alias("z"), "x", "y", "v", "snow")
    out = level
    for z in range(zoom - 1, -1, -1):
        up = level.groupBy(F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y"))
        level = up.agg(F.avg("v").alias("v"), (F.count_if("snow") * 2 > F.count("*")).alias("snow")).select(F.lit(z).alias("z"), "x", "y", "v", "snow")
        out = out.unionByName(level)
    return out


def bilinear(corners: DataFrame, asked: DataFrame) -> DataFrame:
    """``id, height`` of asked places (``id, x, y`` in cells) between corners ``i, j, h``.

    The form of a corner and slopes keeps a flat surface exact. One missing corner makes null.
    """
    at = asked.withColumn("_i", F.floor("x")).withColumn("_j", F.floor("y"))
    offsets = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1))))
    each = at.withColumn("_o", offsets).withColumn("i", F.col("_i") + F.col("_o.a")).withColumn("j", F.col("_j") + F.col("_o.b"))
    met = each.join(corners, ["i", "j"], "left").groupBy("id", "x", "y", "_i", "_j")
    h = {(a, b): F.max(F.when((F.col("_o.a") == a) & (F.col("_o.b") == b), F.col("h"))) for a in (0, 1) for b in (0, 1)}
    got = met.agg(*(c.alias(f"h{a}{b}") for (a, b), c in h.items()))
    u, v = F.col("x") - F.col("_i"), F.col("y") - F.col("_j")
    height = F.col("h00") + (F.col("h10") - F.col("h00")) * u + (F.col("h01") - F.col("h00")) * v + (F.col("h00") - F.col("h10") - F.col("h01") + F.col("h11")) * u * v
    return got.select("id", height.alias("height"))


def quadtree(points: DataFrame, depth: int, most: int) -> DataFrame:
    """``level, x, y, n``: the largest squares with at most ``most`` rows, the least ones with more.

    ``points`` has whole ``x, y`` below ``2 ** depth``; a square of a level is ``2 ** level``
    wide. Counts of all levels come from those of the least squares.
    """
    unit = points.groupBy("x", "y").agg(F.count("*").alias("n"))
    every = unit.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    wide = lambda c: F.expr(f"shiftright({c}, level)").alias(c)
    counts = every.groupBy("level", wide("x"), wide("y")).agg(F.sum("n").alias("n"))
    up = counts.select((F.col("level") - 1).alias("level"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("n").alias("_n"))
    on = ["level", "_x", "_y"]
    at = counts.withColumns({"_x": F.shiftright("x", 1), "_y": F.shiftright("y", 1)}).join(up, on, "left")
    return at.where(((F.col("n") <= most) | (F.col("level") == 0)) & (F.col("_n").isNull() | (F.col("_n") > most))).select("level", "x", "y", "n")
