"""Areas against lines by brute force, with whole numbers so that touching is exact."""

import random

from ridgeline.operators import overlaps


def turn(p, q, r):
    x = (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return (x > 0) - (x < 0)


def cross(a, b, c, d):
    box = all(max(a[k], b[k]) >= min(c[k], d[k]) and max(c[k], d[k]) >= min(a[k], b[k]) for k in (0, 1))
    return box and turn(a, b, c) * turn(a, b, d) <= 0 and turn(c, d, a) * turn(c, d, b) <= 0


def inside(p, ring):
    odd = False
    for a, b in zip(ring, ring[1:] + ring[:1]):
        if (a[1] > p[1]) != (b[1] > p[1]) and (p[0] - a[0]) * (b[1] - a[1]) * (1 if b[1] > a[1] else -1) < (b[0] - a[0]) * (p[1] - a[1]) * (1 if b[1] > a[1] else -1):
            odd = not odd
    return odd


def meet(ring, line):
    path = list(zip(line, line[1:])) or [(line[0], line[0])]
    return inside(line[0], ring) or any(cross(a, b, *s) for a, b in zip(ring, ring[1:] + ring[:1]) for s in path)


def test_areas_meet_lines_as_by_brute_force(spark):
    r = random.Random(3)
    spot = lambda size: (r.randrange(size), r.randrange(size))
    areas = {k: [spot(100) for _ in range(r.choice([3, 4, 9]))] for k in range(25)}
    areas |= {100: [(0, 0), (100, 0), (100, 100), (0, 100)], 101: [(10, 10), (90, 10), (90, 90), (50, 20), (10, 90)], 102: [(1, 1), (2, 2)], 103: [(-50, -50), (300, -50), (300, 300), (-50, 300)]}
    lines = {}
    for k in range(120):
        x, y = spot(100)
        lines[k] = [(x + r.randrange(-6, 7), y + r.randrange(-6, 7)) for _ in range(r.choice([1, 2, 2, 5]))]
    lines |= {200: [(100, 50), (120, 50)], 201: [(100, 100)], 202: [(-60, 10), (400, 12)], 203: [(50, 20), (50, 5)], 204: [(50, 60), (51, 61)], 205: [(10, 10), (90, 10)]}
    want = {(a, b) for a, ring in areas.items() for b, line in lines.items() if len(ring) > 2 and meet(ring, line)}
    point = "array<struct<x:double,y:double>>"
    plain = lambda rows: [(k, [(float(x), float(y)) for x, y in v]) for k, v in rows.items()]
    a = spark.createDataFrame([*plain(areas), (500, None), (501, [])], f"area long, ring {point}")
    b = spark.createDataFrame([*plain(lines), (500, None), (501, [])], f"id long, points {point}")
    for side in (7.0, 50.0):
        got = [tuple(x) for x in overlaps.meeting(a, b, side).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    _, inner, _ = overlaps.cover(a.where("area = 100"), 7.0)
    assert inner.count() > 100
