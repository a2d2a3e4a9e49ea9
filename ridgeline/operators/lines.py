"""Operators on lines and on rows placed along them: coverage, chains of places, spreads, smoothing.

A line is ``id, points`` (array of structs ``x, y`` in metres of a local plane).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.store import cut

#: Vertices, and segments, of a cell that one task takes together, and pairs of both that it tests in one step.
CROWD, STEP = 2000, 1 << 20
#: Rows that a task has, and pairs that its cells make, on average.
TASK_ROWS, TASK_PAIRS = 500_000, 200_000_000
#: Rows of a task that orders all rows of its keys, on average.
SORTED = 200_000


def segments(lines: DataFrame) -> DataFrame:
    """``id, n, a, b`` of each line's segments in order."""
    each = F.posexplode(geo.segments(F.col("points"))).alias("n", "s")
    return lines.select("id", each).select("id", "n", "s.a", "s.b")


def weighted_vertices(lines: DataFrame) -> DataFrame:
    """``id, n, p, weight``: each vertex with half the length of the segments at it."""
    s = segments(lines).withColumn("half", geo.planar(F.col("a"), F.col("b")) / 2)
    ends = s.select("id", F.explode(F.array(F.struct("n", F.col("a").alias("p"), "half"), F.struct((F.col("n") + 1).alias("n"), F.col("b").alias("p"), "half"))).alias("v"))
    return ends.groupBy("id", "v.n", "v.p").agg(F.sum("v.half").alias("weight"))


def _covering(low: Column, high: Column, side: float) -> Column:
    return F.sequence(F.floor(low / side), F.floor(high / side))


def coverage(lines: DataFrame, others: DataFrame, near: float, side: float) -> DataFrame:
    """``id, other, share``: how much of each line, by length, lies within ``near`` of another.

    A segment is filed under every cell of ``side`` that its box, widened by ``near``,
    touches; a vertex meets the segments of its own cell, inside the task that has the cell, and what
    leaves the task is one row for each cell and pair of lines. Cells of more than ``CROWD`` vertices or
    segments go to several tasks. Pairs that share nothing have no row.
    """
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell, known = ["cx", "cy"], lambda *c: reduce(Column.__and__, (F.abs(x) < float("inf") for x in c))
    v = weighted_vertices(lines.select("id", "points").repartition(parts, "id"))
    v = v.withColumn("total", F.sum("weight").over(Window.partitionBy("id"))).where((F.col("total") > 0) & known(F.col("p.x"), F.col("p.y")))
    x, y, none = F.col("p.x").cast("double"), F.col("p.y").cast("double"), F.lit(0.0)
    v = v.select(F.floor(x / side).alias("cx"), F.floor(y / side).alias("cy"), "id", F.lit(True).alias("vertex"), x.alias("ax"), y.alias("ay"), none.alias("bx"), none.alias("by"), F.coalesce("weight", none).alias("weight"), "total")
    ends = {f"{e}{axis}": F.col(f"{e}.{axis}").cast("double") for e in "ab" for axis in "xy"}
    s = segments(others.select("id", "points").repartition(parts, "id")).where(known(*ends.values())).select("id", *(c.alias(k) for k, c in ends.items()))
    for axis, at in (("x", "cx"), ("y", "cy")):
        low, high = F.least(f"a{axis}", f"b{axis}") - near, F.greatest(f"a{axis}", f"b{axis}") + near
        s = s.withColumn(at, F.explode(_covering(low, high, side)))
    rows = v.unionByName(s.withColumns({"vertex": F.lit(False), "weight": none, "total": none})).where("id is not null")
    sizes = cut(rows.groupBy(*cell).agg(F.count_if("vertex").alias("nv"), F.count_if(~F.col("vertex")).alias("ns")))
    work = sizes.agg(F.sum("nv") + F.sum("ns"), F.sum(F.col("nv").cast("double") * F.col("ns"))).first()
    tasks = max(parts, math.ceil((work[0] or 0) / TASK_ROWS), math.ceil((work[1] or 0) / TASK_PAIRS))
    crowded = sizes.where(F.greatest("nv", "ns") > CROWD).select(*cell, *(F.ceil(F.col(c) / CROWD).alias(k) for c, k in (("nv", "_of"), ("ns", "_by"))))
    if crowded.isEmpty():
        rows = rows.withColumns({"i": F.lit(0).cast("long"), "j": F.lit(0).cast("long")})
    else:
        # Vertices are dealt by themselves, segments by their line, so that a vertex meets all segments of a line in one task.
        one = F.lit(1).cast("long")
        rows = rows.join(crowded, cell, "left").withColumns({"_of": F.greatest("_of", one), "_by": F.greatest("_by", one)})
        own = lambda n, *by: F.array(F.pmod(F.xxhash64(*by), F.col(n)))
        all_ = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
        rows = rows.withColumn("i", F.explode(F.when(F.col("vertex"), own("_of", "id", "ax", "ay")).otherwise(all_("_of"))))
        rows = rows.withColumn("j", F.explode(F.when(F.col("vertex"), all_("_by")).otherwise(own("_by", "id")))).drop("_of", "_by")
    dealt = rows.repartition(tasks, *cell, "i", "j").sortWithinPartitions(*cell, "i", "j")
    kind = rows.schema["id"].dataType.simpleString()
    held = dealt.mapInArrow(_held(near, side), f"id {kind}, other {kind}, held double, total double").groupBy("id", "other").agg(F.sum("held").alias("held"), F.any_value("total").alias("total"))
    return held.select("id", "other", (F.col("held") / F.col("total")).alias("share"))


def _held(near: float, side: float):
    """Rows sorted by cell to ``id, other, held, total``: the weight of a line's vertices that lie near another, by cell."""

    def pairs(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        b = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        names = pc.dictionary_encode(b.column("id"))
        code, n = names.indices.to_numpy(), len(names.dictionary)
        column = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names if c != "id"}
        new = np.zeros(b.num_rows, np.int64)
        for c in ("cx", "cy", "i", "j"):
            new[1:] |= column[c][1:] != column[c][:-1]
        # Places in a cell by their y, cells in a row.
        base, up = np.cumsum(new) * (2.0 * side), lambda y: np.clip(y - column["cy"] * side, 0.0, side)
        vertex, slack = column["vertex"], near + 1e-6 * (side + near)
        v, s = np.flatnonzero(vertex), np.flatnonzero(~vertex)
        at = base + up(column["ay"])
        v = v[np.argsort(at[v], kind="stable")]
        low = np.searchsorted(at[v], (base + up(np.minimum(column["ay"], column["by"]) - slack))[s], "left")
        high = np.searchsorted(at[v], (base + up(np.maximum(column["ay"], column["by"]) + slack))[s], "right")
        upto, hits, k = np.cumsum(high - low), [np.empty(0, np.int64)], 0
        px, py, mine = column["ax"][v], column["ay"][v], code[v]
        ax, ay, theirs = column["ax"][s], column["ay"][s], code[s]
        dx, dy = column["bx"][s] - ax, column["by"][s] - ay
        size = dx * dx + dy * dy
        west, east = np.minimum(0.0, dx) + ax - slack, np.maximum(0.0, dx) + ax + slack
        while k < len(s):  # some segments at a time
            done = upto[k - 1] if k else 0
            last = max(k + 1, int(np.searchsorted(upto, done + STEP, "right")))
            many = (high - low)[k:last]
            g = np.repeat(np.arange(k, last), many)
            w = np.arange(len(g)) - np.repeat(upto[k:last] - many - done, many) + np.repeat(low[k:last], many)
            some = (mine[w] != theirs[g]) & (px[w] >= west[g]) & (px[w] <= east[g])
            g, w, k = g[some], w[some], last
            with np.errstate(all="ignore"):
                t = np.where(size[g] > 0, np.clip(((px[w] - ax[g]) * dx[g] + (py[w] - ay[g]) * dy[g]) / size[g], 0.0, 1.0), 0.0)
                ex, ey = px[w] - (ax[g] + t * dx[g]), py[w] - (ay[g] + t * dy[g])
                met = np.sqrt(ex * ex + ey * ey) <= near
            hits.append(np.unique(w[met] * n + theirs[g[met]]))
        hit = np.unique(np.concatenate(hits))
        w, other = hit // n, hit % n
        pair, first, which = np.unique(mine[w].astype(np.int64) * n + other, return_index=True, return_inverse=True)
        weight = np.bincount(which.ravel(), column["weight"][v][w], len(pair))
        of = [names.dictionary.take(pa.array(c)) for c in (pair // n, pair % n)]
        return pa.RecordBatch.from_arrays([*of, pa.array(weight, pa.float64()), pa.array(column["total"][v][w[first]])], ["id", "other", "held", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, held = [], None  # rows of the last cell, which may go on, and that cell
        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(c).to_numpy() for c in ("cx", "cy", "i", "j")]
            cell = tuple(k[-1] for k in keys)
            start = b.num_rows - int(np.argmin(np.append(np.logical_and.reduce([k[::-1] == c for k, c in zip(keys, cell)]), False)))
            if start or (rest and cell != held):
                if done := rest + [b.slice(0, start)] if start else rest:
                    yield pairs(done)
                rest = []
            rest.append(b.slice(start))
            held = cell
        if rest:
            yield pairs(rest)

    return run


def _both_ways(covered: DataFrame) -> DataFrame:
    """``a, b, ahead, behind`` with ``a < b``: the shares of each pair, null where a line has none of the other."""
    way = lambda c: F.max(F.when(c, F.col("share")))
    pair = F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")
    return covered.groupBy(*pair).agg(way(F.col("id") < F.col("other")).alias("ahead"), way(F.col("id") > F.col("other")).alias("behind"))


def same_lines(lines: DataFrame, near: float, side: float, least: float = 0.9) -> DataFrame:
    """``a, b`` with ``a < b`` of lines that cover each other; start and direction do not matter."""
    c = coverage(lines, lines, near, side).where(F.col("share") >= least)
    return _both_ways(c).where("ahead is not null and behind is not null").select("a", "b")


def entity_pairs(lines: DataFrame, near: float, side: float, agree: Column, named: float, same: float) -> DataFrame:
    """``id, other, rule, share, back``: lines that are one route.

    Rule ``a``: ``agree`` holds (over ``name`` and ``other_name``) and one covers ``named`` of
    the other. Rule ``b``: both cover ``same`` of the other. ``lines`` also has ``name``.
    """
    way = lambda a, b, there, back: F.struct(F.col(a).alias("id"), F.col(b).alias("other"), F.col(there).alias("share"), F.coalesce(back, F.lit(0.0)).alias("back"))
    ways = F.array(way("a", "b", "ahead", "behind"), way("b", "a", "behind", "ahead"))
    both = _both_ways(coverage(lines, lines, near, side)).select(F.explode(ways).alias("w")).select("w.*").where("share is not null")
    both = both.where((F.greatest("share", "back") >= named) | (F.least("share", "back") >= same))
    name = lines.select("id", "name")
    both = both.join(name, "id").join(name.toDF("other", "other_name"), "other")
    rule = F.when(agree & (F.greatest("share", "back") >= named), "a").when(F.least("share", "back") >= same, "b")
    return both.withColumn("rule", rule).where("rule is not null").select("id", "other", "rule", "share", "back")


def smoothed(df: DataFrame, key: list[str], at: str, value: str, width: float) -> DataFrame:
    """``smooth``: mean height over ``width`` of way around each point, narrower at the ends.

    The mean is the trapezoid integral over the window. Unknown heights stay unknown and end
    a run; runs are smoothed apart. Places of a key are distinct. Points and window ends are
    ordered together, so no range join is needed. Keys are dealt to tasks of about ``SORTED`` rows.
    """
    df = cut(df.select(*key, at, value))
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / SORTED))
    df = df.repartition(tasks, *key)
    w = Window.partitionBy(*key).orderBy(at)
    known = F.col(value).isNotNull()
    new = (known != F.coalesce(F.lag(known).over(w), ~known)).cast("int")
    r = df.select(*key, F.col(at).cast("double").alias("_s"), F.col(value).alias("_z"), new.alias("_new"))
    r = r.withColumn("_run", F.sum("_new").over(Window.partitionBy(*key).orderBy("_s"))).drop("_new")
    in_run = Window.partitionBy(*key, "_run").orderBy("_s")
    step = (F.col("_s") - F.lag("_s").over(in_run)) * (F.col("_z") + F.lag("_z").over(in_run)) / 2
    r = r.withColumn("_area", F.coalesce(step, F.lit(0.0))).withColumn("_area", F.sum("_area").over(in_run))
    whole = Window.partitionBy(*key, "_run")
    half = F.least(F.lit(width / 2), F.col("_s") - F.min("_s").over(whole), F.max("_s").over(whole) - F.col("_s"))
    r = r.withColumn("_h", F.when(F.col("_z").isNotNull(), half))
    point = F.struct("_s", "_z", "_area")
    none = F.lit(None).cast("double")
    marks = r.select(*key, "_run", F.col("_s").alias("_x"), F.lit(0).alias("_kind"), point.alias("_point"), none.alias("_of"))
    ends = r.where("_h > 0").select(*key, "_run", F.explode(F.array(F.struct((F.col("_s") - F.col("_h")).alias("x"), F.lit(-1).alias("k")), F.struct((F.col("_s") + F.col("_h")).alias("x"), F.lit(1).alias("k")))).alias("e"), F.col("_s").alias("_of"))
    both = marks.unionByName(ends.select(*key, "_run", F.col("e.x").alias("_x"), F.col("e.k").alias("_kind"), F.lit(None).cast(marks.schema["_point"].dataType).alias("_point"), "_of"))
    both = both.repartition(tasks, *key)
    order = Window.partitionBy(*key, "_run").orderBy("_x", F.abs("_kind"))
    back = F.last("_point", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # Backwards, as a window that reaches to the end of a run would be gone through again for each row.
    ahead = F.last("_point", True).over(Window.partitionBy(*key, "_run").orderBy(F.desc("_x"), F.abs("_kind")).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_a", back).withColumn("_b", ahead).where("_kind <> 0")
    gone = F.col("_x") - F.col("_a._s")
    share = F.coalesce(gone / F.nullif(F.col("_b._s") - F.col("_a._s"), F.lit(0.0)), F.lit(0.0))
    area = F.col("_a._area") + gone * (2 * F.col("_a._z") + (F.col("_b._z") - F.col("_a._z")) * share) / 2
    mean = both.groupBy(*key, F.col("_of").alias("_s")).agg(F.sum(F.col("_kind") * area).alias("_sum"))
    out = r.join(mean, [*key, "_s"], "left")
    return out.select(*key, F.col("_s").alias(at), F.coalesce(F.col("_sum") / (2 * F.col("_h")), "_z").alias("smooth"))


def spread(df: DataFrame, key: str, at: str, off: str, low: Column, high: Column, limit: int) -> DataFrame:
    """Up to ``limit`` rows of each key, spread over a range.

    Again and again the longest interval (the first of equals) that holds rows is split at
    its row nearest the middle, counting ``off`` as distance. Each split is one round of
    aggregates over all keys, so no key's rows come together in one task. ``df`` has ``id``.
    """
    rows = cut(df.select(key, "id", F.col(at).alias("_at"), F.col(off).alias("_off"), low.cast("double").alias("_from"), high.cast("double").alias("_to")))
    chosen = None
    for _ in range(limit):
        length = F.struct(F.col("_to") - F.col("_from"), -F.col("_from"))
        longest = rows.groupBy(key).agg(F.max_by(F.struct("_from", "_to"), length).alias("_i"))
        inside = rows.join(longest, key).withColumn("_in", (F.col("_from") == F.col("_i._from")) & (F.col("_to") == F.col("_i._to")))
        score = F.abs(F.col("_at") - (F.col("_from") + F.col("_to")) / 2) + F.col("_off")
        best = inside.where("_in").groupBy(key).agg(F.min_by(F.struct("_at", "id"), F.struct(score, F.col("_at"), F.col("id"))).alias("_p"))
        best = cut(best)
        if best.isEmpty():
            break
        got = best.select(key, F.col("_p.id").alias("id"), F.col("_p._at").alias(at))
        chosen = got if chosen is None else chosen.unionByName(got)
        rest = inside.join(best, key).where(F.col("id") != F.col("_p.id"))
        first = F.struct("_at", "id") < F.col("_p")
        rows = cut(rest.select(
            key, "id", "_at", "_off",
            F.when(F.col("_in") & ~first, F.col("_p._at")).otherwise(F.col("_from")).alias("_from"),
            F.when(F.col("_in") & first, F.col("_p._at")).otherwise(F.col("_to")).alias("_to"),
        ))
    return chosen if chosen is not None else df.select(key, "id", at).limit(0)


def chained(places: Column, gap: float, span: float, town_gap: float) -> Column:
    """Group numbers of places along a line (ordered array of structs ``km, town``), from 1.

    A place joins the last group if it follows within ``gap`` and the group then spans at most
    ``span``, or if it follows within ``town_gap`` and its town is one of the group's.
    """
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("first"), F.lit(None).cast("double").alias("last"), F.array().cast("array<string>").alias("towns"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        apart = p["km"] - s["last"]
        town = p["town"].isNotNull() & F.array_contains(s["towns"], F.coalesce(p["town"], F.lit("")))
        joins = F.coalesce(((apart <= gap) & (p["km"] - s["first"] <= span)) | ((apart <= town_gap) & town), F.lit(False))
        n = F.when(joins, s["n"]).otherwise(s["n"] + 1)
        towns = F.concat(F.when(joins, s["towns"]).otherwise(F.array().cast("array<string>")), F.filter(F.array(p["town"]), lambda t: t.isNotNull()))
        return F.struct(
            n.alias("n"), F.when(joins, s["first"]).otherwise(p["km"]).alias("first"), p["km"].alias("last"), towns.alias("towns"),
            F.concat(s["out"], F.array(n)).alias("out"),
        )

    return F.aggregate(places, start, step, lambda s: s["out"])


def trip_chains(rides: Column, days: int, join: float, home: float) -> Column:
    """Chain numbers of rides (ordered array of structs ``day, x0, y0, x1, y1``), from 1.

    A ride joins the chain if it starts at most ``days`` after the last one and within
    ``join`` of its end, and, on a later day, if that end is over ``home`` from where the
    chain began.
    """
    none = F.lit(None).cast("double")
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("int").alias("day"), none.alias("x"), none.alias("y"), none.alias("hx"), none.alias("hy"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, r: Column) -> Column:
        later = r["day"] - s["day"]
        away = F.hypot(s["x"] - s["hx"], s["y"] - s["hy"]) > home
        joins = later.between(0, days) & (F.hypot(r["x0"] - s["x"], r["y0"] - s["y"]) <= join) & ((later == 0) | away)
        joins = F.coalesce(joins, F.lit(False))
        n = F.when(joins, s["n"]).otherwise(s["n"] + 1)
        return F.struct(
            n.alias("n"), r["day"].cast("int").alias("day"), r["x1"].alias("x"), r["y1"].alias("y"),
            F.when(joins, s["hx"]).otherwise(r["x0"]).alias("hx"), F.when(joins, s["hy"]).otherwise(r["y0"]).alias("hy"),
            F.concat(s["out"], F.array(n)).alias("out"),
        )

    return F.aggregate(rides, start, step, lambda s: s["out"])


def even_nights(stops: Column, total: Column, nights: int) -> Column:
    """Places of nights: each takes the stop nearest an even share of the way still left.

    ``stops`` is an ordered array of places; a night only looks beyond the last one, and has
    null where no stop is left. Later nights see the choices before them.
    """
    start = F.struct(F.lit(0.0).alias("at"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, night: Column) -> Column:
        want = s["at"] + (total - s["at"]) / (F.lit(nights + 2) - night)
        ahead = F.filter(stops, lambda x: (x > s["at"]) & (x < total))
        near = F.array_min(F.transform(ahead, lambda x: F.struct(F.abs(x - want).alias("d"), x.alias("x"))))["x"]
        return F.struct(F.coalesce(near, s["at"]).alias("at"), F.concat(s["out"], F.array(near)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(nights)), start, step, lambda s: s["out"])


def first_reached(df: DataFrame, asked: DataFrame, key: list[str], order: str, measure: str, place: str) -> DataFrame:
    """The first row (by ``order``) whose ``measure`` reaches each asked place; null if none does.

    The greatest measure so far never falls, so rows and places are ordered together by it.
    """
    far = F.max(measure).over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    a = df.select(*key, far.alias("_m"), F.col(order).alias("_n"))
    b = asked.select(*key, F.col(place).alias("_m"), F.lit(None).cast(a.schema["_n"].dataType).alias("_n")).distinct()
    both = a.withColumn("_ask", F.lit(False)).unionByName(b.withColumn("_ask", F.lit(True)))
    w = Window.partitionBy(*key).orderBy("_m", F.desc("_ask"), "_n").rowsBetween(0, Window.unboundedFollowing)
    return both.withColumn(order, F.first("_n", True).over(w)).where("_ask").select(*key, F.col("_m").alias(place), order)


def active(ranges: DataFrame, asked: DataFrame, key: list[str], start: str, end: str, at: str) -> DataFrame:
    """Asked places with the range (of those that do not overlap) that holds each, or nulls."""
    a = ranges.select(*key, F.col(start).alias("_m"), F.struct(start, end).alias("_r"), F.lit(False).alias("_ask"))
    b = asked.select(*key, F.col(at).alias("_m"), F.lit(None).cast(a.schema["_r"].dataType).alias("_r"), F.lit(True).alias("_ask"))
    w = Window.partitionBy(*key).orderBy("_m", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_r", F.last("_r", True).over(w)).where("_ask")
    held = F.col("_m") <= F.col(f"_r.{end}")
    return both.select(*key, F.col("_m").alias(at), F.when(held, F.col(f"_r.{start}")).alias(start), F.when(held, F.col(f"_r.{end}")).alias(end))


def filled_columns(df: DataFrame, key: list[str], at: str, value: str, width: float, reach: int) -> DataFrame:
    """``column, mean, filled``: mean of each column of ``width``, and a line through empty ones.

    An empty column is filled between its neighbours when these are at most ``reach`` apart.
    """
    c = df.groupBy(*key, F.floor(F.col(at) / width).alias("column")).agg(F.avg(value).alias("mean")).where("mean is not null")
    w = Window.partitionBy(*key).orderBy("column")
    c = c.withColumn("_to", F.lead("column").over(w)).withColumn("_next", F.lead("mean").over(w))
    near = F.col("_to") - F.col("column") <= reach
    last = F.when(near, F.col("_to") - 1).otherwise(F.col("column"))
    e = c.withColumn("_c", F.explode(F.sequence(F.col("column"), last)))
    share = (F.col("_c") - F.col("column")) / (F.col("_to") - F.col("column"))
    made = F.when(F.col("_c") == F.col("column"), F.col("mean")).otherwise(F.col("mean") + (F.col("_next") - F.col("mean")) * share)
    return e.select(*key, F.col("_c").alias("column"), made.alias("mean"), (F.col("_c") != F.col("column")).alias("filled"))


def in_runs(ids: DataFrame, asked: DataFrame, col: str) -> DataFrame:
    """Asked ids (whole numbers) with ``held``: whether they lie in a run of ``ids``.

    Runs are held by blocks of 64 ids as the bits of one number, so that a look-up is one test
    however many runs there are; they need no order over the whole table.
    """
    block, bit = F.shiftright(F.col(col).cast("long"), 6), F.col(col).cast("long").bitwiseAND(63).cast("int")
    one = F.lit(1).cast("long")
    runs = ids.where(F.col(col).isNotNull()).groupBy(block.alias("_block")).agg(F.bit_or(F.call_function("shiftleft", one, bit)).alias("_runs"))
    held = F.call_function("shiftright", F.col("_runs"), bit).bitwiseAND(1) == 1
    return asked.withColumn("_block", block).join(runs, "_block", "left").withColumn("held", F.coalesce(held, F.lit(False))).drop("_block", "_runs")
