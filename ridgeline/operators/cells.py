"""Graphs cell by cell: union-find inside tasks joined over seams, and lines cut at the grid."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.store import cut, drop, written
from .graph import components, tasks

#: Edges of a task, on average.
TASK_EDGES = 1_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of a task's edges with the smallest node it is joined to by them."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (above := up[x]) != x:
            up[x] = up[above]
            x = up[above]
        return x

    for b in batches:
        for x, y in zip(b.column("src").to_pylist(), b.column("dst").to_pylist()):
            x, y = find(x) if x in up else up.setdefault(x, x), find(y) if y in up else up.setdefault(y, y)
            if x != y:
                up[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([find(x) for x in up], pa.int64())], ["node", "root"])


def cell_components(edges: DataFrame, cell: Column, task_edges: int = TASK_EDGES) -> DataFrame:
    """``node, component`` of an undirected graph (``src, dst``, longs), as ``components`` gives it.

    Edges are dealt to tasks in order of their ``cell``, a large cell to several, and each task
    joins what its own edges join. Only seams, nodes that several tasks hold, link these parts,
    so what is left is a graph of parts that meet at seams, and its rounds move few rows. A task
    holds the nodes of its edges.
    """
    e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), cell.alias("cell")).where("src <> dst")
    e = written(e)
    forest = written(e.repartitionByRange(max(1, math.ceil(e.count() / task_edges)), "cell", "src").select("src", "dst").mapInArrow(_forest, "node long, root long"))
    drop(e)
    held = forest.repartition(tasks(forest), "node").hint("merge")
    nodes = cut(held.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("other")))
    seams = nodes.where("root <> other").select("node", F.col("root").alias("low"))
    links = held.join(seams, "node").where("root <> low").select(F.col("root").alias("src"), F.col("low").alias("dst"))
    named = components(links).withColumnRenamed("node", "root")
    drop(forest)
    return nodes.select("node", "root").join(named, "root", "left").select("node", F.coalesce("component", "root").alias("component"))


def islands(edges: DataFrame, cell: Column, least: int, task_edges: int = TASK_EDGES) -> DataFrame:
    """``node, component, nodes, edges, kept`` of every node: components of fewer than ``least`` distinct edges go.

    The largest one, by nodes, then edges, then the smallest id, always stays.
    """
    undirected = cut(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    named = cut(cell_components(undirected, cell, task_edges))
    per = undirected.join(named.withColumnRenamed("node", "src"), "src").groupBy("component").agg(F.count("*").alias("edges"))
    sizes = cut(named.groupBy("component").agg(F.count("*").alias("nodes")).join(per, "component"))
    # One row.
    first = sizes.agg(F.max_by("component", F.struct("nodes", "edges", -F.col("component"))).alias("largest"))
    known = sizes.join(F.broadcast(first), sizes["component"] == first["largest"], "left")
    known = known.select("component", "nodes", "edges", ((F.col("edges") >= least) | F.col("largest").isNotNull()).alias("kept"))
    return named.join(known, "component").select("node", "component", "nodes", "edges", "kept")


def cut_segments(segments: DataFrame, side: int) -> DataFrame:
    """``line, seq, piece, x0, y0, x1, y1, cell_x, cell_y``: segments (integers) cut at the lines of a grid.

    A crossing is the exact point on the segment, its other coordinate rounded to the nearest
    integer, halves to even, so both directions of a segment, and both cells, have the same
    one. Pieces are numbered along the segment. A cell owns a piece by the piece's least
    coordinates: one that lies on a line is its cell's whose least edge this is. A segment of
    no length is one piece.
    """
    between = lambda a, b: F.expr(f"case when floor((greatest({a}, {b}) - 1) / {side}) >= floor(least({a}, {b}) / {side}) + 1 then sequence(floor(least({a}, {b}) / {side}) + 1, floor((greatest({a}, {b}) - 1) / {side})) else array() end")  # noqa: E731, E501

    def at(v: Column, a: str, b: str, c: str, d: str) -> Column:
        """The other coordinate (from c to d) where the first (from a to b) is v."""
        run = F.col(b) - F.col(a)
        up = F.signum(run).cast("long")
        top = (F.col(c) * run + (F.col(d) - F.col(c)) * (v - F.col(a))) * up
        run = run * up
        q, rest = F.call_function("div", top - F.pmod(top, run), run), F.pmod(top, run) * 2
        return q + F.when((rest > run) | ((rest == run) & (F.pmod(q, F.lit(2)) == 1)), 1).otherwise(0)

    s = segments.select("line", "seq", *(F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")))
    point = lambda x, y: F.struct((F.abs(x - F.col("x0")) + F.abs(y - F.col("y0"))).alias("far"), x.alias("x"), y.alias("y"))
    met = F.concat(
        F.array(point(F.col("x0"), F.col("y0")), point(F.col("x1"), F.col("y1"))),
        F.transform(between("x0", "x1"), lambda k: point(k.cast("long") * side, at(k.cast("long") * side, "x0", "x1", "y0", "y1"))),
        F.transform(between("y0", "y1"), lambda k: point(at(k.cast("long") * side, "y0", "y1", "x0", "x1"), k.cast("long") * side)),
    )
    # Both coordinates go one way along a segment, so the way in both orders its points.
    s = s.withColumn("met", F.array_sort(F.array_distinct(met)))
    s = s.select("line", "seq", "met", F.posexplode(F.slice("met", F.lit(1), F.greatest(F.size("met") - 1, F.lit(1)))).alias("piece", "a"))
    s = s.withColumn("b", F.element_at("met", F.least(F.col("piece") + 2, F.size("met"))))
    cell = lambda c: F.floor(F.least(f"a.{c}", f"b.{c}") / side).cast("long")
    return s.select("line", "seq", "piece", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1"), cell("x").alias("cell_x"), cell("y").alias("cell_y"))


def cell_graphs(segments: DataFrame, side: int, least: int, task_edges: int = TASK_EDGES) -> DataFrame:
    """``cut_segments`` without small islands, with ``border0, border1``: whether an end lies on the grid.

    Points are nodes, and pieces of a cell its edges. A part of a cell's graph that touches no line of the grid
    and has fewer than ``least`` pieces goes. Cells with their border nodes put together are the
    whole graph again, but for those islands.
    """
    p = cut(cut_segments(segments, side))
    ends = p.select("cell_x", "cell_y", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("n"))
    nodes = cut(ends.select("cell_x", "cell_y", "n.x", "n.y").distinct().withColumn("id", F.monotonically_increasing_id()))
    for k in ("0", "1"):
        p = p.join(nodes.withColumnsRenamed({"x": f"x{k}", "y": f"y{k}", "id": f"n{k}"}), ["cell_x", "cell_y", f"x{k}", f"y{k}"])
    p = cut(p)
    joined = cell_components(p.select(F.col("n0").alias("src"), F.col("n1").alias("dst"), "cell_x", "cell_y"), F.struct("cell_x", "cell_y"), task_edges)
    p = p.join(joined.withColumnRenamed("node", "n0"), "n0", "left").withColumn("component", F.coalesce("component", "n0"))
    border = lambda k: (F.pmod(F.col(f"x{k}"), F.lit(side)) == 0) | (F.pmod(F.col(f"y{k}"), F.lit(side)) == 0)
    p = cut(p.withColumns({"border0": border("0"), "border1": border("1")}))
    small = p.groupBy("component").agg(F.count("*").alias("n"), F.bool_or(F.col("border0") | F.col("border1")).alias("touches"))
    kept = p.join(small.where(~F.col("touches") & (F.col("n") < least)).select("component"), "component", "left_anti")
    return kept.select("line", "seq", "piece", "x0", "y0", "x1", "y1", "cell_x", "cell_y", "border0", "border1")
