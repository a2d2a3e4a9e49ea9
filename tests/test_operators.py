"""Operators against brute force on small fixtures, and the named edge cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ridgeline.functions import geo
from ridgeline.functions import text as fn
from ridgeline.operators import graph, search, series, spatial, tables, ways

SMALL = "/root/testdata/sf0.001"


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def metres(a, b):
    x = math.radians(b[1] - a[1]) * math.cos(math.radians((a[2] + b[2]) / 2))
    return 6_371_000 * math.hypot(x, math.radians(b[2] - a[2]))


def points(n, seed=3):
    r = random.Random(seed)
    return [(i, 7 + r.uniform(0, 0.05), 47 + r.uniform(0, 0.05)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, lon double, lat double")


def test_near_pairs_equal_brute_force_after_any_repartition(spark):
    rows = points(120)
    want = {(a[0], b[0]) for a in rows for b in rows if metres(a, b) <= 500}
    for parts in (1, 7):
        df = frame(spark, rows).repartition(parts)
        got = {(r.left_id, r.right_id) for r in spatial.near_pairs(df, df, 500.0).collect()}
        assert got == want


@pytest.mark.parametrize(("lon", "lat"), [(10, 65), (10, -72), (180, 0), (-180, 80), (0, 89.99), (30, -89.99), (180, 47)])
def test_near_pairs_at_high_latitudes_and_across_180_degrees(spark, lon, lat):
    r, wide = random.Random(8), 0.04 / math.cos(math.radians(lat))
    rows = [(i, (lon + r.uniform(-wide, wide) + 180) % 360 - 180, lat + r.uniform(-0.01, 0.01) * (abs(lat) < 89.9)) for i in range(150)]

    def short(a, b):
        d = abs(a[1] - b[1]) % 360
        return metres((0, 0, a[2]), (0, min(d, 360 - d), b[2]))

    want = sorted((a[0], b[0]) for a in rows for b in rows if short(a, b) <= 1000)
    df = frame(spark, rows)
    assert sorted((r.left_id, r.right_id) for r in spatial.near_pairs(df, df, 1000.0).collect()) == want
    kept = []
    for p in rows:
        if all(short(p, k) > 1000 for k in kept):
            kept.append(p)
    got = spatial.spaced(df.withColumn("kind", F.lit(1)), ["kind"], 1000.0, [F.col("id")])
    assert {r.id for r in got.collect()} == {p[0] for p in kept}


def test_spaced_equals_the_greedy_order(spark):
    rows, kept = points(150, 5), []
    for p in rows:
        if all(metres(p, k) > 400 for k in kept):
            kept.append(p)
    got = spatial.spaced(frame(spark, rows).withColumn("kind", F.lit(1)), ["kind"], 400.0, [F.col("id")])
    assert {r.id for r in got.collect()} == {p[0] for p in kept}


def test_border_points_are_inside(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (4, 0), (4, 4), (0, 4)]))
    df = spark.createDataFrame([(2.0, 2.0), (4.0, 1.0), (0.0, 0.0), (4.1, 1.0)], "x double, y double")
    assert [r[0] for r in df.select(geo.inside(F.col("x"), F.col("y"), ring)).collect()] == [True, True, True, False]


def test_hilbert_numbers_are_a_path_of_neighbours(spark):
    df = spark.range(16).selectExpr("id % 4 as x", "id div 4 as y")
    rows = df.select("x", "y", geo.hilbert_tile(F.col("x"), F.col("y"), 2).alias("t")).orderBy("t").collect()
    assert [r.t for r in rows] == list(range(5, 21))
    assert (rows[0].x, rows[0].y) == (0, 0)
    assert all(abs(a.x - b.x) + abs(a.y - b.y) == 1 for a, b in zip(rows, rows[1:]))


def test_edit_distance_counts_a_swap_once(spark):
    df = spark.createDataFrame([("ab", "ba", 2), ("kitten", "sitting", 3), ("abcdef", "a", 2), (None, "a", 1)], "a string, b string, m int")
    assert [r[0] for r in df.select(fn.edits("a", "b", "m")).collect()] == [1, 3, 3, None]


def test_corrections_find_all_variants_within_the_budget(spark):
    def variants(t):
        for i in range(len(t) + 1):
            yield t[:i] + "z" + t[i:]
            if i < len(t):
                yield t[:i] + t[i + 1 :]
                yield t[:i] + "z" + t[i + 1 :]
            if i + 1 < len(t):
                yield t[:i] + t[i + 1] + t[i] + t[i + 2 :]

    terms = ["abcdefgh", "stuvw", "klmnop"]
    asked = {"bacdfegh", *terms} | {x for t in terms for v in variants(t) for x in (v, *variants(v))}
    want = {(q, t, d) for q in asked for t in terms if (d := fn._damerau(q, t, 2)) <= (0 if len(q) < 5 else 1 if len(q) < 8 else 2)}
    assert ("bacdfegh", "abcdefgh", 2) in want
    got = search.corrections(spark.createDataFrame([(q,) for q in asked], "query string"), spark.createDataFrame([(t,) for t in terms], "term string"))
    assert {(r.query, r.term, r.edits) for r in got.collect()} == want


def test_normal_form(spark):
    df = spark.createDataFrame([("Straße  Él-Niño",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(fn.normal(F.col("t"))).collect()] == ["strasse el nino", None, ""]


def test_redirects_end_and_circles_fail(spark):
    chain = [(i, i + 1) for i in range(64)] + [(100, 101), (101, 100)] + [(200 + i, 201 + i) for i in range(65)]
    got = {r.node: r.target for r in graph.follow(spark.createDataFrame(chain, "node long, target long")).collect()}
    assert got[0] == 64 and got[63] == 64
    assert got[100] is None and got[101] is None
    assert got[200] is None and got[201] == 265


def test_strong_components_of_a_cycle_with_a_tail(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1)], "src long, dst long")
    got = {r.node: r.component for r in graph.strong_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_closed_roads_and_unreachable_places(spark):
    edges = spark.createDataFrame([(1, 2, 4), (1, 3, 1), (3, 2, 2), (2, 4, None), (5, 1, 1)], "src long, dst long, cost long")
    sources = spark.createDataFrame([(1,)], "source long")
    assert {(r.node, r.cost) for r in graph.shortest_paths(edges, sources).collect()} == {(1, 0), (2, 3), (3, 1)}


def test_landmarks_are_far_apart(spark):
    line = [(i, i + 1, 1) for i in range(6)] + [(i + 1, i, 1) for i in range(6)]
    got = graph.landmarks(spark.createDataFrame(line, "src long, dst long, cost long"), spark.createDataFrame([(2,)], "source long"), 2)
    assert {(r.landmark, r.node, r.cost) for r in got.collect()} == {(a, n, abs(a - n)) for a in (6, 0) for n in range(7)}


def test_dead_band_books_a_move_of_exactly_its_size(spark):
    df = spark.createDataFrame([([10.0, 12.9, 13.0, None, 10.0, 10.5],), ([],), ([None],)], "v array<double>")
    got = [(r.b.up, r.b.down) for r in df.select(series.dead_band(F.col("v"), 3.0).alias("b")).collect()]
    assert got == [(3.0, 3.0), (0.0, 0.0), (0.0, 0.0)]


def profile(*places):
    return [{"d": float(d), "e": None if e is None else float(e)} for d, e in places]


@pytest.mark.parametrize(
    ("places", "want"),
    [
        (profile((0, 100), (500, 140), (1000, 180), (1250, 150)), [(0, 1000, 80)]),
        (profile((0, 100), (500, 140), (1000, 179), (1250, 150)), []),
        (profile((0, 100), (300, 181)), []),
        (profile((0, 100), (1000, 190), (1200, 166), (1290, 195)), [(0, 1290, 95)]),
        (profile((0, 100), (1000, 190), (1300, 189), (2000, 290)), [(0, 1000, 90), (1300, 2000, 101)]),
        (profile((0, None), (10, 100), (1000, None), (1010, 200)), [(10, 1010, 100)]),
    ],
)
def test_climbs(spark, places, want):
    df = spark.createDataFrame([(places,)], "p array<struct<d:double,e:double>>")
    (row,) = df.select(series.climbs(F.col("p")).alias("c")).collect()
    assert [(c.start, c.end, c.gain) for c in row.c] == want


def test_no_climb_without_points(spark):
    df = spark.createDataFrame([([],)], "p array<struct<d:double,e:double>>")
    assert not df.select(series.climbs(F.col("p")).alias("c")).first().c


def test_latest_and_first_on_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (None, 1, "c"), (2, 5, None)], "k long, at long, v string")
    assert {(r.k, r.v) for r in tables.latest(df, ["k"], [F.col("at")]).collect()} == {(1, "b"), (None, "c"), (2, None)}
    assert tables.keep_first(df, "k", [F.col("at")]).count() == 3


def test_page_says_whether_there_is_more(spark):
    df = spark.range(5)
    assert [r.has_more for r in tables.page(df, [F.col("id")], 5).collect()] == [False] * 5
    assert [r.has_more for r in tables.page(df, [F.col("id")], 4).collect()] == [True] * 4
    assert tables.page(df.limit(0), [F.col("id")], 4).count() == 0


def test_merged_ranges_join_where_they_touch(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 8, 9), (1, 1, 2)], "k long, a long, b long")
    assert sorted((r.a, r.b) for r in series.merged_ranges(df, ["k"], "a", "b").collect()) == [(0, 7), (8, 9)]


def test_whole_graph_queries_take_all_rows(spark):
    queries = __spark_entry__.queries()
    parts = spark.read.parquet(f"{SMALL}/part.parquet").collect()
    roads = {}
    for r in spark.read.parquet(f"{SMALL}/lineitem.parquet").collect():
        k = r.l_partkey, (r.l_partkey * 31 + r.l_suppkey * 7) % len(parts)
        roads.setdefault(k, []).append(int(r.l_quantity))
    roads = {(a, b): (a * len(parts) + b, min(v)) for (a, b), v in roads.items()}
    out, both = {}, {}
    for a, b in roads:
        out.setdefault(a, []).append(b)
        both.setdefault(a, set()).add(b)
        both.setdefault(b, set()).add(a)

    def reached(start, ways):
        seen, todo = {start}, [start]
        while todo:
            new = set(ways.get(todo.pop(), ())) - seen
            seen |= new
            todo += new
        return seen

    def costs(start):
        cost, todo = {start: 0}, [start]
        while todo:
            a = todo.pop(0)
            for b in out.get(a, ()):
                if cost[a] + roads[a, b][1] < cost.get(b, 1 << 60):
                    cost[b] = cost[a] + roads[a, b][1]
                    todo.append(b)
        return cost

    def steps(start):
        depth, new = {start: 0}, [start]
        for k in range(1, 4):
            new = {b for a in new for b in out.get(a, ())} - depth.keys()
            depth |= dict.fromkeys(new, k)
        return depth

    def got(name):
        rows = [tuple(r) for r in queries[name](spark, SMALL).collect()]
        assert len(rows) == len(set(rows))
        return set(rows)

    seeds = [p.p_partkey for p in parts if p.p_size == 50]
    assert seeds
    assert got("components") == {(n, min(reached(n, both))) for n in both if both[n] - {n}}
    far = {n: reached(n, out) for n in both}
    assert got("strong_components") == {(n, min(m for m in far[n] if n in far[m])) for n in both}
    assert got("shortest_paths") == {(s, n, c) for s in seeds for n, c in costs(s).items()}
    assert got("bounded_traversal") == {(s, n, k) for s in seeds for n, k in steps(s).items()}
    assert got("road_successors") == {(i, roads[b, c][0]) for (a, b), (i, _) in roads.items() for c in out.get(b, ()) if c != a}
    assert got("profile_costs") == {
        x for i, c in roads.values() for x in [(i, "walk", 3 * c), (i, "bike", c + 10 if i % 5 else None), (i, "mtb", c * (1 + i % 3))]
    }
    assert {r[0] for r in got("line_chains")} == {i for i, _ in roads.values()}
    marks = got("landmark_distances")
    assert marks == {(m, n, c) for m in {r[0] for r in marks} for n, c in costs(m).items()}
    manifest = {n: {r[0]: r[1] for r in spark.read.parquet(f"{SMALL}/{n}.parquet").select(*c).collect()} for n, c in (("customer", ("c_custkey", "c_nationkey")), ("supplier", ("s_suppkey", "s_nationkey")))}
    c, s = manifest["customer"], manifest["supplier"]
    assert got("manifest_merge") == {(k, c.get(k, s.get(k)), k in c and k in s and c[k] != s[k]) for k in c.keys() | s.keys()}


def test_simplified_lines_and_forward_matches(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0, 2.0, 3.0], [0.0, 0.4, 5.0, 0.0], ["a", "b", "a", "c", "b"], ["b", "a", "a", "b"])], "id long, x array<double>, y array<double>, held array<string>, keys array<string>")
    got = rows.select(ways.simplified("x", "y", F.lit(0.5)).alias("kept"), ways.forward_matches("keys", "held").alias("found")).first()
    assert got.kept == [0, 1, 2, 3] and got.found == [1, 2, 2, 4]
    assert rows.select(ways.simplified("x", "y", F.lit(9.0)).alias("kept")).first().kept == [0, 3]


def test_numbered_is_a_total_order(spark):
    got = ways.numbered(spark.range(100).selectExpr("99 - id as v"), ["v"]).collect()
    assert {(r.v, r.nth) for r in got} == {(k, k) for k in range(100)}


def test_nearest_in_crowds(spark):
    """One place holds a third of all rows, others are crowded, far, at 180 degrees or near a pole."""
    places = [(n, "a" if n % 3 else None, 7.0, 47.0) for n in range(60)]
    places += [(100 + n, "b" if n % 2 else "a", 7.0 + n % 9 * 2e-4, 47.0 + n % 7 * 3e-4) for n in range(80)]
    places += [(200 + n, "a", 179.999 + n * 4e-4 - (360 if n > 2 else 0), -16.0) for n in range(6)]
    places += [(300 + n, "b", n * 60.0 - 180, 89.999) for n in range(6)]
    places += [(400, "a", 20.0, 10.0), (401, "a", None, 10.0), (402, "b", 7.02, 47.0)]
    df = spark.createDataFrame(places, "id long, kind string, lon double, lat double")
    pair = spatial.near_pairs(df, df, 2000.0).select("left_id", "right_id", "right_kind", "metres").collect()
    for n, by in ((1, None), (3, None), (4, ["right_kind"])):
        groups = {}
        for r in pair:
            groups.setdefault((r.left_id, r.right_kind if by else 0), []).append((r.metres, r.right_id))
        want = {(k[0], m[1], i + 1) for k, v in groups.items() for i, m in enumerate(sorted(v)[:n])}
        got = [(r.left_id, r.right_id, r["rank"]) for r in spatial.nearest(df, df, 2000.0, n, by).collect()]
        assert len(got) == len(want) and set(got) == want
    wide = spatial.widened(df.where("id = 402"), df.where("id < 200"), [100.0, 1500.0, 2000.0]).collect()
    assert {r.right_id for r in wide} == {r.right_id for r in pair if r.left_id == 402 and r.right_id < 200 and r.metres <= 1500}
    assert {r.tier for r in wide} == {1500.0}
    assert {r.id for r in spatial.within(df, df.where("id = 402"), 2000.0).collect()} == {r.left_id for r in pair if r.right_id == 402}


def test_clipped_lines_leave_and_come_back(spark):
    rows = [
        (1, [(-5.0, 5.0), (5.0, 5.0), (5.0, 15.0), (7.0, 15.0), (7.0, 5.0)]),  # in, out above, back again
        (2, [(-5.0, 10.0), (5.0, 10.0)]),  # along the border
        (3, [(-5.0, 5.0), (5.0, 15.0)]),  # touches a corner only
        (4, [(1.0, 1.0), (1.0, 1.0), (2.0, 2.0)]),  # a point said twice
        (5, []), (6, None),
    ]
    df = spark.createDataFrame(rows, "id int, points array<struct<x:double,y:double>>")
    got = {(r.id, r.part, r.n): (r.ax, r.ay, r.bx, r.by) for r in ways.clipped(df, (0.0, 0.0, 10.0, 10.0)).collect()}
    assert got == {
        (1, 1, 0): (0, 5, 5, 5), (1, 1, 1): (5, 5, 5, 10), (1, 2, 3): (7, 10, 7, 5), (2, 1, 0): (0, 10, 5, 10),
        (4, 1, 0): (1, 1, 1, 1), (4, 1, 1): (1, 1, 2, 2),
    }


def test_resolved_reads_a_request_again_only_if_nothing_is_found(spark):
    names = spark.createDataFrame([(1, "green valley", 0.0, 1.0), (2, "green vallon", 20.0, 1.0), (3, "old mill", 5.0, None)], "id long, name string, km double, prominence double")
    q = spark.createDataFrame([("green val",), ("grene valley",), ("mill",), ("nowhere",), ("",), ("mill",)], "query string")
    got = {(r.query, r.id): (r.read_as, r["rank"], r.score) for r in search.resolved(q, names, 5).collect()}
    assert {k: v[:2] for k, v in got.items()} == {
        ("green val", 1): ("green val", 1), ("green val", 2): ("green val", 2), ("grene valley", 1): ("green valley", 1), ("mill", 3): ("mill", 1),
    }
    assert got["grene valley", 1][2] == 58 - 8 + 12 + 1
