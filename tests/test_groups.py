"""Groups of lines on one road against the plain loop over all earlier leaders."""

import math
import random

from pyspark.sql import functions as F

from ridgeline.operators import groups

SCHEMA = "id long, points array<struct<x double, y double>>, start long, anchor boolean, name string"


def measures(p):
    if not p or len(p) < 2 or any(v is None for q in p for v in q):
        return None
    steps = [(math.dist(a, b), (a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in zip(p, p[1:])]
    total = sum(s[0] for s in steps)
    if not total:
        return None
    box = min(q[0] for q in p), min(q[1] for q in p), max(q[0] for q in p), max(q[1] for q in p)
    return total, box, (sum(m * x for m, x, _ in steps) / total, sum(m * y for m, _, y in steps) / total)


def off(p, a, b):
    ex, ey = b[0] - a[0], b[1] - a[1]
    q = ex * ex + ey * ey
    t = max(0, min(1, ((p[0] - a[0]) * ex + (p[1] - a[1]) * ey) / q)) if q else 0
    return math.hypot(p[0] - a[0] - t * ex, p[1] - a[1] - t * ey)


def missed(line, other, near):
    gone = 0
    for i, p in enumerate(line):
        weight = sum(math.dist(p, line[j]) / 2 for j in (i - 1, i + 1) if 0 <= j < len(line))
        gone += weight * (min(off(p, *e) for e in zip(other, other[1:])) > near)
    return gone


def same(a, b, near, slack):
    m, n = measures(a), measures(b)
    if not m or not n:
        return False
    longer = max(m[0], n[0])
    edge = 0.1 * longer + near + slack
    if abs(m[0] - n[0]) > 0.1 * longer or any(abs(x - y) > edge for x, y in zip(m[1], n[1])) or math.dist(m[2], n[2]) > edge:
        return False
    return missed(a, b, near) <= 0.1 * m[0] and missed(b, a, near) <= 0.1 * n[0]


def plain(rows, near, slack=0.0):
    leaders, out = [], {}
    rank = lambda r: (not r[3], 0 if r[3] or r[2] is None else 1, 0 if r[3] else r[2] or 0, r[0])
    for r in sorted(rows, key=rank):
        lead = None if r[3] else next((k for k, p in leaders if same(r[1], p, near, slack)), None)
        if lead is None and measures(r[1]):
            leaders.append((r[0], r[1]))
        out[r[0]] = r[0] if lead is None else lead
    return out


def crowded(seed, n, roads, jitter):
    """Rides in one district: most on a few roads, some the other way or only in part."""
    r = random.Random(seed)
    shapes = []
    for _ in range(roads):
        x, y = r.uniform(0, 300), r.uniform(0, 300)
        shapes.append([(x := x + r.uniform(-80, 160), y := y + r.uniform(-80, 160)) for _ in range(r.randrange(4, 9))])
    rows = []
    for i in range(n):
        road = shapes[0 if r.random() < 0.4 else r.randrange(roads)]
        line = [(x + r.uniform(-jitter, jitter), y + r.uniform(-jitter, jitter)) for x, y in road]
        line = line[::-1] if r.random() < 0.3 else line[: max(2, len(line) - 1)] if r.random() < 0.2 else line
        rows.append((i, line, r.choice([None, *range(40)]), r.choice([True] + [False] * 15 + [None]), "n"))
    return rows


def test_groups_equal_the_plain_loop(spark):
    for seed, n, jitter, slack, most in ((1, 160, 12.0, 0.0, 16), (2, 60, 30.0, 5.0, 1), (3, 90, 25.0, 0.0, 4)):
        rows = crowded(seed, n, 6, jitter)
        got = {r.id: r.grp for r in groups.same_road(spark.createDataFrame(rows, SCHEMA), 25.0, slack=slack, most=most).collect()}
        want = plain(rows, 25.0, slack)
        assert got == want
        assert 3 < len(set(want.values())) < n


def test_lines_that_follow_nothing(spark):
    line = [(0.0, 0.0), (100.0, 0.0), (170.0, 30.0)]
    rows = [(1, None, 1, None, "a"), (2, [], 1, None, "a"), (3, [(5.0, 5.0)], 1, False, "a"), (4, [(5.0, 5.0)] * 3, 1, False, "a"), (5, [(5.0, None), (9.0, 1.0)], 1, False, "a")]
    rows += [(6, line, 2, False, "a"), (7, line, 2, False, "b"), (8, line[::-1], 1, False, None), (9, line[:1] * 3 + line[1:], None, False, "x")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"k": F.lit(1), "grp": F.lit(0), "best": F.lit("x")})
    got = {r.id: r.grp for r in groups.same_road(df, 25.0).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 9, 7: 9, 8: 9, 9: 9}
    assert groups.same_road(df.limit(0), 25.0).collect() == []


def test_one_road_taken_by_all_is_one_round(spark):
    """Every ride is tested against the one leader, and no pairs among rides are made."""
    n = 3000
    points = "array(struct(id % 7d as x, 0d as y), struct(400d + id % 5 as x, 300d as y), struct(900d as x, 310d + id % 3 as y))"
    df = spark.range(n).selectExpr("id", f"{points} as points", "id as start", "false as anchor")
    assert [tuple(r) for r in groups.same_road(df, 25.0).groupBy("grp").count().collect()] == [(0, n)]
