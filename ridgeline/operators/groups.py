"""Groups of lines that follow one road: cheap summaries first, geometry only for pairs they let through.

A line is ``id, points`` (array of structs ``x, y`` in metres of a local plane).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.store import cut

#: Vertices times segments that one step of the exact test holds.
STEP = 1_000_000
SALTS = 16
#: Leaders of a cell in the first wave, and how much each wave is larger than the last.
WAVE = 8


def summaries(lines: DataFrame, share: float, near: float) -> DataFrame:
    """``id, xs, ys, length, west, south, east, north, mx, my, k, cx, cy`` of lines that have a length.

    ``mx, my`` is the mean point along the line. ``k`` counts lengths in steps of a little more
    than ``share``, so lines whose lengths differ by no more are in steps next to each other;
    ``cx, cy`` is the mean point's cell, as wide as the mean points of such a pair can differ.
    """
    s = lines.where(~F.exists("points", lambda p: p["x"].isNull() | p["y"].isNull()) & (F.size("points") >= 2))
    xs, ys = (F.transform(F.col(f"points.{c}"), lambda v: v.cast("double")) for c in "xy")
    total = F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(t: Column, e: Column) -> Column:
        a, b = e["a"], e["b"]
        m = geo.planar(a, b)
        return F.struct((t["l"] + m).alias("l"), (t["x"] + (a["x"] + b["x"]) / 2 * m).alias("x"), (t["y"] + (a["y"] + b["y"]) / 2 * m).alias("y"))

    s = s.withColumns({"xs": xs, "ys": ys, "_t": F.aggregate(geo.segments(F.col("points")), total, add)}).drop("points")
    s = s.where("_t.l > 0 and _t.l < double('infinity')")
    boxes = {"west": F.array_min("xs"), "south": F.array_min("ys"), "east": F.array_max("xs"), "north": F.array_max("ys")}
    s = s.withColumns({"length": F.col("_t.l"), "mx": F.col("_t.x") / F.col("_t.l"), "my": F.col("_t.y") / F.col("_t.l"), **boxes}).drop("_t")
    s = s.withColumn("k", F.floor(F.log("length") / math.log(_base(share))))
    side = _side(F.col("k"), share, near)
    return s.withColumns({"cx": F.floor(F.col("mx") / side), "cy": F.floor(F.col("my") / side)})


def _base(share: float) -> float:
    return 1.001 / (1 - share)


def _side(k: Column, share: float, near: float) -> Column:
    """How far the mean points of two lines can differ if one of them is of step ``k``."""
    return (share * F.pow(F.lit(_base(share)), k + 2) + near) * 1.001


def _around(df: DataFrame, share: float, near: float) -> DataFrame:
    """A row of each line for every step and cell that can hold a line near it: 27."""
    df = df.withColumn("k", F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1)))
    side = _side(F.col("k"), share, near)
    x, y = F.floor(F.col("mx") / side), F.floor(F.col("my") / side)
    df = df.withColumns({"_x": x, "_y": y})
    for axis, at in (("cx", "_x"), ("cy", "_y")):
        df = df.withColumn(axis, F.explode(F.array(F.col(at) - 1, F.col(at), F.col(at) + 1)))
    return df.drop("_x", "_y")


def alike(a: str, b: str, share: float, near: float) -> Column:
    """The cheap test of two summaries (structs): lengths, every edge of the box, mean points."""
    longer = F.greatest(f"{a}.length", f"{b}.length")
    edge = share * longer + near
    close = [F.abs(F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) <= edge for c in ("west", "south", "east", "north")]
    test = (F.abs(F.col(f"{a}.length") - F.col(f"{b}.length")) <= share * longer) & (F.hypot(F.col(f"{a}.mx") - F.col(f"{b}.mx"), F.col(f"{a}.my") - F.col(f"{b}.my")) <= edge)
    for c in close:
        test = test & c
    return test


def _covered(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, near: float, share: float) -> bool:
    """Whether at most ``share`` of line ``x, y``, by its vertices' weights, is farther than ``near`` from line ``u, v``."""
    half = np.hypot(np.diff(x), np.diff(y)) / 2
    weight = np.append(half, 0.0) + np.append(0.0, half)
    a, b, ex, ey = u[:-1], v[:-1], np.diff(u), np.diff(v)
    square = ex * ex + ey * ey
    square[square == 0] = np.inf
    missed, limit, step = 0.0, share * weight.sum(), max(1, STEP // len(a))
    for i in range(0, len(x), step):
        px, py = x[i : i + step, None], y[i : i + step, None]
        t = np.clip(((px - a) * ex + (py - b) * ey) / square, 0.0, 1.0)
        far = np.hypot(px - a - t * ex, py - b - t * ey).min(axis=1) > near
        missed += weight[i : i + step][far].sum()
        if missed > limit:
            return False
    return True


def _same(share: float, near: float) -> Column:
    @F.pandas_udf("boolean")
    def same(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y, u, v in parts:
            out = [_covered(*p, near, share) and _covered(*p[2:], *p[:2], near, share) for p in zip(x, y, u, v, strict=True)]
            yield pd.Series(out, dtype=bool)

    return same("xs", "ys", "xs2", "ys2")


SUMMARY = ("length", "west", "south", "east", "north", "mx", "my")


def _matches(shapes: DataFrame, leaders: DataFrame, rides: DataFrame, share: float, near: float, edge: float) -> DataFrame:
    """``id, hit``: the first of ``leaders`` in order that each of ``rides`` follows.

    Leaders are filed around their cell for each salt, rides at theirs under one salt, so the
    rides of a crowded cell are tested in several tasks. Points are read for pairs alone. Each
    cell's leaders come in order, in waves that grow ``WAVE``-fold: a ride that follows one of
    a wave has its first, and does not meet the later ones.
    """
    cell = ["k", "cx", "cy"]
    around = _around(leaders, share, edge).select(*cell, F.col("order").alias("hit"), F.struct(*SUMMARY).alias("l"))
    around = cut(around.withColumn("_n", F.row_number().over(Window.partitionBy(*cell).orderBy("hit"))))
    left = rides.select(*cell, "id", "order", "best", F.struct(*SUMMARY).alias("r"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    found, low, high = rides.where("false").select("id", F.col("best").alias("hit")), 0, WAVE
    earlier = (F.col("hit") < F.col("order")) & (F.col("best").isNull() | (F.col("hit") < F.col("best")))
    while not (now := around.where((F.col("_n") > low) & (F.col("_n") <= high))).isEmpty():
        pairs = now.withColumn("salt", _salts(SALTS)).join(left, [*cell, "salt"]).where(earlier & alike("l", "r", share, edge))
        pairs = pairs.select("id", "hit", F.col("hit.id").alias("lead"), "salt")
        hits = cut(_following(shapes, pairs, leaders, SALTS, share, near).groupBy("id").agg(F.min("hit").alias("hit")))
        found, left = found.unionByName(hits), left.join(hits.select("id"), "id", "left_anti")
        low, high = high, high * WAVE
    return found


def _following(shapes: DataFrame, pairs: DataFrame, leaders: DataFrame, salts: int, share: float, near: float) -> DataFrame:
    """The rows of ``pairs`` (``id, lead, salt`` and more) that pass the exact test; each ``lead`` is one of ``leaders``."""
    points = shapes.select("id", "xs", "ys")
    theirs = shapes.join(leaders.select("id"), "id", "left_semi")
    theirs = theirs.select(F.col("id").alias("lead"), F.col("xs").alias("xs2"), F.col("ys").alias("ys2"), _salts(salts).alias("salt"))
    return pairs.join(points, "id").join(theirs, ["lead", "salt"]).where(_same(share, near)).drop("xs", "ys", "xs2", "ys2")


def _salts(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def _accepted(shapes: DataFrame, waiting: DataFrame, most: int, share: float, near: float, edge: float) -> DataFrame:
    """Of ``waiting`` rides, some that follow no earlier one: nothing that is still open can lead them.

    Each cell offers its ``most`` first rides, and those are tested against each other. A ride that
    is later than what a cell around it has not offered waits, as what is earlier there is
    unknown. The first of all is always accepted.
    """
    cell = ["k", "cx", "cy"]
    first = waiting.withColumn("_n", F.row_number().over(Window.partitionBy(*cell).orderBy("order"))).where(F.col("_n") <= most + 1)
    first = cut(first.select(*cell, "id", "order", "_n", *SUMMARY))
    offered = first.where(F.col("_n") <= most).drop("_n")
    there = first.groupBy(*cell).agg(
        F.min(F.when(F.col("_n") > most, F.col("order"))).alias("next"),
        F.collect_list(F.when(F.col("_n") <= most, F.struct("order", F.struct(*SUMMARY).alias("s")))).alias("held"),
    )
    asked = _around(offered, share, edge).select(*cell, "id", "order", F.struct(*SUMMARY).alias("a")).join(there, cell)
    late = asked.where(F.col("next") < F.col("order")).select("id")
    met = asked.select("id", "order", "a", F.explode("held").alias("h")).select("id", "order", "a", F.col("h.order").alias("other"), F.col("h.s").alias("b"))
    pairs = met.where((F.col("other") < F.col("order")) & alike("a", "b", share, edge))
    pairs = pairs.join(late, "id", "left_anti").select("id", F.col("other.id").alias("lead"), F.lit(0).cast("long").alias("salt"))
    led = _following(shapes, pairs, offered, 1, share, near).select("id")
    return offered.join(late.unionByName(led), "id", "left_anti")


def same_road(lines: DataFrame, near: float, share: float = 0.1, slack: float = 0.0, most: int = 16) -> DataFrame:
    """``id, grp``: the group of each line, which is the id of the line that leads it.

    ``lines`` has ``id`` (distinct, not null), ``points``, ``start`` and ``anchor`` (null: false). Anchors
    lead in any case, and come before all others. The rest follow in order of ``start`` (null
    first), then id: a line joins the first leader that it follows, else it leads a group itself.
    Two lines follow one road if their lengths, boxes and mean points differ by at most
    ``share`` of the longer and ``near + slack``, and at most ``share`` of each, by its vertices'
    weights, is farther than ``near`` from the other. Start and direction do not matter.
    Lines that are null, empty, of one point, without length or with unknown or infinite
    numbers follow nothing. Repeated lines are equal ways of one group; an empty table has
    none. Other columns are not looked at. Points of one line are in one row, so their
    number is bounded by what a row may hold; the exact test takes them in steps.

    Rounds accept leaders that nothing open can lead, and test all lines against them, so a road
    that is taken a million times costs a million tests and no pairs among its rides. The
    number of rounds grows with the leaders of one cell (``most`` lines are offered a round) and
    with chains of lines that follow only the one before, and not with the number of lines.
    """
    edge = near + slack
    anchor = F.coalesce("anchor", F.lit(False))
    order = F.struct((~anchor).alias("late"), F.when(anchor, None).otherwise(F.col("start")).alias("start"), F.col("id").alias("id"))
    shapes = cut(summaries(lines.select("id", "points", anchor.alias("anchor"), order.alias("order")), share, edge))
    keys = shapes.drop("xs", "ys")
    leaders = keys.where("anchor")
    best = F.lit(None).cast(keys.schema["order"].dataType)
    rides = cut(keys.where("not anchor").withColumn("best", best))
    while True:
        hits = _matches(shapes, leaders, rides, share, near, edge)
        rides = cut(rides.join(hits, "id", "left").withColumn("best", F.least("best", "hit")).drop("hit"))
        waiting = rides.where("best is null")
        if waiting.isEmpty():
            break
        leaders = cut(_accepted(shapes, waiting, most, share, near, edge))
        rides = rides.join(leaders.select("id"), "id", "left_anti")
    return lines.select("id").join(rides.select("id", F.col("best.id").alias("grp")), "id", "left").select("id", F.coalesce("grp", "id").alias("grp"))
