"""Union-find over seams, islands, and lines cut at the grid."""

import random
from fractions import Fraction

from pyspark.sql import functions as F

from ridgeline.operators import cells


def joined(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    return {x: find(x) for x in list(up)}


def test_components_over_seams_equal_one_union_find(spark):
    r = random.Random(2)
    chain = [(k, k + 1) for k in range(0, 400) if k % 50]
    hub = [(7, 500 + k) for k in range(200)]  # a node of many cells
    edges = chain + hub + [(r.randrange(1000, 1300), r.randrange(1000, 1300)) for _ in range(150)] + [(5, 5), (None, 3), (3, None), (900, 901), (901, 900)]
    df = spark.createDataFrame(edges, "src long, dst long")
    for cell, size in ((F.floor(F.col("src") / 40), 30), (F.lit(1), 25), (F.col("src") % 3, 10**6)):
        assert {x.node: x.component for x in cells.cell_components(df, cell, size).collect()} == joined(edges)
    assert cells.cell_components(df.limit(0), F.lit(1)).collect() == []


def test_islands_keep_the_largest_and_those_with_edges(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (20, 21), (21, 22), (22, 20), (20, 21), (30, 31), (31, 32), (32, 33)]
    got = {x.node: (x.component, x.nodes, x.edges, x.kept) for x in cells.islands(spark.createDataFrame(edges, "src long, dst long"), F.floor(F.col("src") / 2), 9, 3).collect()}
    assert got[4] == (1, 4, 3, True)  # ties the island of 30, and is the smaller id
    assert got[33] == (30, 4, 3, False) and got[22] == (20, 3, 3, False) and got[11] == (10, 2, 1, False)
    got = cells.islands(spark.createDataFrame(edges, "src long, dst long"), F.lit(0), 3).collect()
    assert {x.component for x in got if x.kept} == {1, 20, 30}


def test_pieces_follow_segments_and_stay_in_cells(spark):
    r = random.Random(6)
    rows = [(k, 0, *(r.randrange(-90, 90) for _ in range(4))) for k in range(200)]
    rows += [(1000 + k, 1, c, d, a, b) for k, (_, _, a, b, c, d) in enumerate(rows)]  # the way back
    rows += [(2001, 0, 0, 0, 64, 64), (2002, 0, 5, 5, 5, 5), (2003, 0, 32, -40, 32, 40), (2004, 0, -32, 0, 40, 0), (2005, 0, 0, 1, 64, 2)]
    far = 350_000_000
    rows += [(2006, 0, -far, far - 1, -far + 50, -far + 7)]
    df = spark.createDataFrame(rows, "line long, seq int, x0 long, y0 long, x1 long, y1 long")
    small, found = df.where("line <> 2006"), {}
    for x in cells.cut_segments(small, 32).collect():
        found.setdefault((x.line, x.seq), []).append(x)
    for line, seq, x0, y0, x1, y1 in rows[:-1]:
        p = sorted(found[line, seq], key=lambda x: x.piece)
        assert (p[0].x0, p[0].y0, p[-1].x1, p[-1].y1) == (x0, y0, x1, y1)
        assert all((a.x1, a.y1) == (b.x0, b.y0) for a, b in zip(p, p[1:]))
        for s in p:
            assert s.cell_x == min(s.x0, s.x1) // 32 and s.cell_y == min(s.y0, s.y1) // 32
            for a, b in ((s.x0, s.x1), (s.y0, s.y1)):
                assert not any(min(a, b) < v < max(a, b) for v in range(-96, 97, 32))
            for x, y in ((s.x0, s.y0), (s.x1, s.y1)):  # on the segment, but for rounding
                if (x, y) not in ((x0, y0), (x1, y1)):
                    exact = [y0 + Fraction((y1 - y0) * (x - x0), x1 - x0)] if x % 32 == 0 and x1 != x0 else []
                    other = [x0 + Fraction((x1 - x0) * (y - y0), y1 - y0)] if y % 32 == 0 and y1 != y0 else []
                    assert y in map(round, exact) or x in map(round, other)
    for k in range(200):  # both directions have the same points
        assert {(x.x0, x.y0) for x in found[k, 0]} | {(x.x1, x.y1) for x in found[k, 0]} == {(x.x0, x.y0) for x in found[1000 + k, 1]} | {(x.x1, x.y1) for x in found[1000 + k, 1]}
    large = cells.cut_segments(df.where("line = 2006"), 10_000_000).collect()
    assert len(large) == 70 and all(x.y0 >= x.y1 for x in large)


def test_cells_and_borders_rebuild_the_graph(spark):
    r = random.Random(9)
    rows = [(k, 0, x := r.randrange(100), y := r.randrange(100), x + r.randrange(-9, 9), y + r.randrange(-9, 9)) for k in range(300)]
    df = spark.createDataFrame(rows, "line long, seq int, x0 long, y0 long, x1 long, y1 long")
    number = lambda x, y: (x + 500) * 2000 + y + 500
    pieces = cells.cut_segments(df, 16).collect()
    whole = joined((number(p.x0, p.y0), number(p.x1, p.y1)) for p in pieces)
    graphs = cells.cell_graphs(df, 16, 2, 40).collect()
    every = cells.cell_graphs(df, 16, 0, 40).collect()
    assert len(every) == len(pieces) and joined((number(p.x0, p.y0), number(p.x1, p.y1)) for p in every) == whole
    kept = {(p.line, p.piece) for p in graphs}
    for p in pieces:  # what goes is alone in its cell and touches no line
        if (p.line, p.piece) not in kept:
            ends = {(p.x0, p.y0), (p.x1, p.y1)}
            assert all(x % 16 and y % 16 for x, y in ends)
            assert not any(ends & {(q.x0, q.y0), (q.x1, q.y1)} for q in pieces if q is not p and (q.cell_x, q.cell_y) == (p.cell_x, p.cell_y))
    assert any(p.border0 for p in graphs)
