"""Nearest ways: one place asked twice, equal segments, the rims of the steps; closures over written edges."""

import math

from ridgeline.operators import graph, ways


def test_nearest_way_equals_all_pairs(spark):
    lines = [(w, [((w * 37) % 300 + 60.0 * k, (w * 91) % 300 + (w % 7 - 3) * 20.0 * k) for k in range(3)]) for w in range(30)]
    lines += [(w + 100, xy) for w, xy in lines]
    lines += [(500, [(0.0, 900.0), (50.0, 900.0)]), (501, [(0.0, 875.0), (50.0, 875.0)])]
    points = [(i, float(i * 17 % 400), float(i * 29 % 400)) for i in range(80)] + [(i + 80, float(i * 17 % 400), float(i * 29 % 400)) for i in range(80)]
    points += [(900, 20.0, 887.5), (901, 20.0, 900.0 + 6.25)]

    def far(px, py, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0.0, min(1.0, ((px - a[0]) * dx + (py - a[1]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(px - a[0] - t * dx, py - a[1] - t * dy)

    want = {}
    for i, x, y in points:
        met = [(round(m, 6), w, n) for w, xy in lines for n in range(len(xy) - 1) if (m := far(x, y, xy[n], xy[n + 1])) <= 100.0]
        if met:
            want[i] = min(met)
    d = spark.createDataFrame([(w, [{"x": x, "y": y} for x, y in xy]) for w, xy in lines], "id long, points array<struct<x: double, y: double>>")
    got = ways.nearest_way(spark.createDataFrame(points, "id long, x double, y double"), d, 100.0)
    assert {r.id: (r.metres, r.way, r.segment) for r in got.collect()} == want


def test_closure_writes_edges_once_and_merges(spark):
    edges = spark.createDataFrame([(k, k // 3) for k in range(1, 100)] + [(0, 5)], "src long, dst long")
    seeds = spark.createDataFrame([(80, 80), (1, 1)], "root long, node long")
    got = graph.closure(edges, seeds)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 1), (1, 1, 0), (1, 5, 2), (80, 0, 4), (80, 1, 6), (80, 2, 3), (80, 5, 5), (80, 8, 2), (80, 26, 1), (80, 80, 0)]
    assert [r.depth for r in graph.closure(edges, seeds, 1).where("root = 80").orderBy("depth").collect()] == [0, 1]
