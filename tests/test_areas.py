"""Areas of relations, ways with unknown nodes, and house numbers along lines."""

import pytest

from ridgeline.operators import rings, ways
from ridgeline.sources import files

NODES = {n: (n % 10, n // 10) for n in range(1, 60)}
WAYS = {
    1: [11, 12, 13], 2: [31, 21, 11], 3: [31, 32, 33, 13],  # an outer ring, one way backwards
    4: [22, 23, 22 + 10, 22],  # a hole that is closed by itself
    5: [41, 42, 43, 41], 6: [44, 45, 46], 7: [46, 99, 44], 8: [47, 48], 9: [50], 10: [99, 98], 12: [51, 52, 51],
}
RELATIONS = {
    100: [(1, "outer"), (2, "outer"), (3, ""), (4, "inner"), (77, "label")],
    101: [(1, "outer"), (5, "outer"), (3, "outer"), (2, "outer")],
    102: [(6, "outer"), (7, "outer")], 103: [(1, "outer"), (2, "outer")], 104: [(4, "inner")], 105: [(5, "outer"), (1234, "inner")],
    106: [(9, "outer")], 107: [], 108: [(5, "outer"), (8, "inner")], 109: [(12, "outer")],
}


@pytest.fixture(scope="module")
def osm(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("osm")
    tag = lambda **t: "".join(f'<tag k="{k}" v="{v}"/>' for k, v in t.items())
    text = "".join(f'<node id="{n}" lon="{x}" lat="{y}"/>' for n, (x, y) in NODES.items())
    text += "".join(f'<way id="{w}">{"".join(f"<nd ref=\"{n}\"/>" for n in refs)}{tag(name=w)}</way>' for w, refs in WAYS.items())
    member = lambda w, role: f'<member type="way" ref="{w}" role="{role}"/>'
    text += "".join(f'<relation id="{r}">{"".join(member(*m) for m in ms)}{tag(type="multipolygon", n=r)}</relation>' for r, ms in RELATIONS.items())
    text += f'<relation id="200">{member(5, "outer")}{tag(type="route")}</relation>'
    (at / "a.osm").write_text(f"<osm>{text}</osm>")
    return {k: files.read_osm(spark, str(at), k) for k in ("node", "way", "relation")}


def ring(*nodes):
    return [NODES[n] for n in nodes]


def test_areas_have_rings_or_a_fault(osm):
    got = {r.id: r for r in rings.areas(osm["relation"], osm["way"], osm["node"]).collect()}
    assert set(got) == set(RELATIONS)
    shape = lambda rs: None if rs is None else [[(p.lon, p.lat) for p in line] for line in rs]
    assert shape(got[100].outer) == [ring(11, 12, 13, 33, 32, 31, 21, 11)] and shape(got[100].inner) == [ring(22, 23, 32, 22)]
    assert got[100].tags["n"] == "100" and got[100].fault is None
    assert shape(got[101].outer) == [ring(11, 12, 13, 33, 32, 31, 21, 11), ring(41, 42, 43, 41)] and shape(got[101].inner) == []
    assert {r: got[r].fault for r in got if got[r].fault} == {
        102: "unknown node", 103: "open ring", 104: "no outer ring", 105: "open ring", 106: "open ring", 107: "no outer ring", 108: "open ring", 109: "open ring",
    }
    assert all(got[r].outer is None and got[r].inner is None for r in got if got[r].fault)


def test_ways_without_known_nodes_stay(osm):
    got = {r.id: r for r in files.way_lines(osm["way"], osm["node"]).collect()}
    assert set(got) == set(WAYS)
    assert (got[10].line, got[10].missing) == ([], 2) and got[7].missing == 1 and len(got[7].line) == 2
    assert {w for w in got if got[w].closed} == {4, 5}


def test_house_numbers_follow_bends_in_both_directions(spark):
    bend = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]
    rows = [(1, 10, 2, "even", bend), (2, 2, 10, "even", bend), (3, 1, 4, "odd", bend), (4, 1, 10, "3", bend), (5, 5, 5, "all", bend), (6, 1, 3, "odd", bend)]
    rows += [(7, 1, 700, "all", bend), (8, 1, 601, "all", bend), (9, 1, 9, "alphabetic", bend), (10, None, 9, "all", bend), (11, 1, 9, "all", [(0.0, 0.0)]), (12, 3, 1, "all", [(2.0, 2.0)] * 2)]
    df = spark.createDataFrame(rows, "id long, first long, last long, kind string, points array<struct<x:double,y:double>>")
    got = {}
    for r in ways.numbers_along(df).collect():
        got.setdefault(r.id, {})[r.number] = (round(r.x, 9), round(r.y, 9))
    assert got[1] == {8: (0.5, 0.0), 6: (1.0, 0.0), 4: (1.0, 0.5)} and got[2] == {4: (0.5, 0.0), 6: (1.0, 0.0), 8: (1.0, 0.5)}
    assert list(got[3]) == [3] and set(got[4]) == {4, 7} and set(got[8]) == set(range(2, 601)) and got[12] == {2: (2.0, 2.0)}
    assert set(got) == {1, 2, 3, 4, 8, 12}
