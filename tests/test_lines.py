"""Operators on lines against brute force, and their edge cases."""

import math
import random

from pyspark.sql import functions as F

from ridgeline.operators import graph, lines


def brute_spread(rows, low, high, limit):
    open_, out = [(low, high, sorted((a, i, o) for i, a, o in rows))], []
    while len(out) < limit and any(r for _, _, r in open_):
        a, b, inside = max((x for x in open_ if x[2]), key=lambda x: (x[1] - x[0], -x[0]))
        open_.remove((a, b, inside))
        k = min(range(len(inside)), key=lambda n: (abs(inside[n][0] - (a + b) / 2) + inside[n][2], inside[n][:2]))
        out.append(inside[k][1])
        open_ += [(a, inside[k][0], inside[:k]), (inside[k][0], b, inside[k + 1 :])]
    return set(out)


def test_spread_equals_splitting_one_interval_after_another(spark):
    r = random.Random(4)
    rows = [(k, n, r.uniform(0, 90), r.uniform(0, 3)) for k in range(3) for n in range((3, 12, 40)[k])]
    df = spark.createDataFrame([(k, n, a, o) for k, n, a, o in rows], "key int, id int, at double, off double")
    got = lines.spread(df, "key", "at", "off", F.lit(0), F.lit(100), 7).collect()
    for k in range(3):
        want = brute_spread([(n, a, o) for kk, n, a, o in rows if kk == k], 0.0, 100.0, 7)
        assert {x.id for x in got if x.key == k} == want
    assert lines.spread(df.limit(0), "key", "at", "off", F.lit(0), F.lit(100), 3).count() == 0


def test_even_nights_see_the_nights_before(spark):
    df = spark.createDataFrame([([10.0, 24.0, 55.0, 80.0],), ([90.0],), ([],)], "stops array<double>")
    got = [x[0] for x in df.select(lines.even_nights(F.col("stops"), F.lit(100.0), 3)).collect()]
    # From 24 on, a third of 76 leads to 49, nearest to 55; from there half of 45 leads to 77.5.
    assert got == [[24.0, 55.0, 80.0], [90.0, None, None], [None, None, None]]


def test_a_town_holds_a_group_together_beyond_the_gap(spark):
    places = [(0.0, "a"), (2.0, None), (6.5, "a"), (9.0, "b"), (15.5, "b"), (17.0, None), (19.0, None), (21.5, None), (23.0, None)]
    df = spark.createDataFrame([(places,)], "p array<struct<km:double,town:string>>")
    assert df.select(lines.chained(F.col("p"), 2.5, 6.0, 6.0)).first()[0] == [1, 1, 1, 2, 3, 3, 3, 3, 4]


def test_smoothing_keeps_a_straight_slope_and_unknown_heights(spark):
    rows = [(0, float(x), 2.0 * x) for x in range(10)] + [(0, 10.0, None), (0, 11.0, 5.0), (1, 3.0, None)]
    got = lines.smoothed(spark.createDataFrame(rows, "k int, s double, z double"), ["k"], "s", "z", 4.0).collect()
    found = {(r.k, r.s): r.smooth for r in got}
    assert len(got) == len(rows)
    assert all(abs(found[(0, float(x))] - 2 * x) < 1e-9 for x in range(10))
    assert found[(0, 10.0)] is None and found[(0, 11.0)] == 5.0 and found[(1, 3.0)] is None


def test_lines_of_one_point_and_no_length_cover_nothing(spark):
    rows = [(1, [(0.0, 0.0), (100.0, 0.0)]), (2, [(100.0, 5.0), (0.0, 5.0)]), (3, [(50.0, 0.0)]), (4, [(1.0, 1.0), (1.0, 1.0)]), (5, [])]
    df = spark.createDataFrame(rows, "id int, points array<struct<x:double,y:double>>")
    got = lines.same_lines(df, 10.0, 40.0).collect()
    assert [(r.a, r.b) for r in got] == [(1, 2)]


def test_crowded_cells_are_split_and_cover_as_brute_force_does(spark, monkeypatch):
    rnd = random.Random(7)
    rows = []
    for k in range(60):
        x, y = rnd.uniform(-120, 120), rnd.uniform(-120, 120)
        rows.append((f"l{k}", [(x := x + rnd.uniform(-40, 40), y := y + rnd.uniform(-40, 40)) for _ in range(6)]))

    def far(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)

    want = {}
    for i, p in rows:
        steps = [math.dist(a, b) / 2 for a, b in zip(p, p[1:])]
        weight = [a + b for a, b in zip([0.0, *steps], [*steps, 0.0])]
        for o, q in rows:
            held = sum(w for v, w in zip(p, weight) if min(far(v, a, b) for a, b in zip(q, q[1:])) <= 15.0)
            if o != i and held:
                want[i, o] = held / sum(weight)
    monkeypatch.setattr(lines, "CROWD", 20)
    monkeypatch.setattr(lines, "STEP", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        df = spark.createDataFrame(rows, "id string, points array<struct<x:double,y:double>>")
        got = {(r.id, r.other): r.share for r in lines.coverage(df, df, 15.0, 100.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_coverage_joins_no_vertices_with_segments_as_rows(spark):
    df = spark.createDataFrame([(1, [(0.0, 0.0), (100.0, 0.0)]), (2, [(100.0, 5.0), (0.0, 5.0)])], "id long, points array<struct<x:double,y:double>>")
    assert "Join" not in lines.coverage(df, df, 10.0, 40.0)._jdf.queryExecution().optimizedPlan().toString()


def test_chains_stop_at_forks_and_join_circles(spark):
    rows = [(1, 1, 2), (2, 2, 3), (3, 3, 4), (4, 3, 5), (5, 10, 11), (6, 11, 10), (7, 20, 20)]
    df = spark.createDataFrame(rows, "id long, src long, dst long").withColumn("kind", F.lit("a"))
    got = {r.id: r.chain for r in graph.chains(df, "kind").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7}


def test_first_reached_and_runs(spark):
    s = spark.createDataFrame([(1, 1, 5.0), (1, 2, 3.0), (1, 3, 9.0)], "k int, n int, x double")
    asked = spark.createDataFrame([(1, 4.0), (1, 5.0), (1, 6.0), (1, 10.0)], "k int, place double")
    got = {r.place: r.n for r in lines.first_reached(s, asked, ["k"], "n", "x", "place").collect()}
    assert got == {4.0: 1, 5.0: 1, 6.0: 3, 10.0: None}
    ids = spark.range(4000, 4200)
    held = lines.in_runs(ids, spark.range(3998, 4202), "id").where("held").count()
    assert held == 200


def test_runs_are_bits_of_a_block_not_lists_to_search(spark):
    ids = spark.createDataFrame([(-65,), (-64,), (-1,), (0,), (0,), (63,), (64,), (9007199254740993,), (None,)], "id long")
    asked = spark.createDataFrame([(n,) for n in (None, -66, -65, -64, -63, -2, -1, 0, 1, 62, 63, 64, 65, 9007199254740992, 9007199254740993)], "id long")
    out = lines.in_runs(ids, asked, "id")
    assert {r.id for r in out.where("held").collect()} == {-65, -64, -1, 0, 63, 64, 9007199254740993} and out.where("held is null").isEmpty()
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_smoothing_goes_through_a_run_once(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0)], "k int, s double, z double")
    plan = lines.smoothed(df, ["k"], "s", "z", 4.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "currentrow$(), unboundedfollowing$()" not in plan and "RepartitionByExpression" in plan
