"""Functions of single values, and operators on areas, in named cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ridgeline.functions import geo
from ridgeline.functions import values as val
from ridgeline.operators import spatial, tables


def each(spark, rows, schema, f):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(f).collect()]


def test_articles_in_one_form(spark):
    given = [
        ("https://en.wikipedia.org/wiki/Lake_Como",), ("https://de.wikipedia.org/wiki/M%C3%BCnster#Bau",), ("en: A_b ",), ("no title",),
        ("en:",), ("https://example.org/wiki/A",), (None,), ("https://en.wikipedia.org/wiki/C++",),
    ]
    got = each(spark, given, "v string", val.article(F.col("v")))
    assert got == ["en:Lake Como", None, "en:A b", None, None, None, None, "en:C++"]


def test_references_and_names(spark):
    rows = [("B 028a", "28"), ("A7", "A 8"), ("Ring", "ring!"), ("Ring", "Rund"), ("R0", "0"), ("", "")]
    assert each(spark, rows, "a string, b string", val.refs_agree(F.col("a"), F.col("b"))) == [True, False, True, False, True, True]
    rows = [("Rhine Trail", "rhine-trail"), ("Rhine Trail 2", "The Rhine Trail 2"), ("Trail 2", "Trail 3"), ("...", "...")]
    assert each(spark, rows, "a string, b string", val.names_agree(F.col("a"), F.col("b"))) == ["same", "words", None, None]


def test_days_of_a_season(spark):
    days = [dt.date(2023, 9, 1), dt.date(2023, 9, 3), dt.date(2024, 2, 28), dt.date(2024, 2, 29), dt.date(2024, 3, 1), dt.date(2023, 3, 1), dt.date(2024, 8, 31)]
    got = each(spark, [(d,) for d in days], "d date", val.season_day(F.col("d")))
    assert [tuple(g) for g in got] == [(2023, 0), (2023, 1), (2023, 90), (2023, 90), (2023, 90), (2022, 90), (2023, 182)]


def test_small_numbers(spark):
    assert each(spark, [(0,), (-1,), (1,), (-64,), (64,)], "n long", val.zigzag(F.col("n"))) == [0, 1, 2, 127, 128]
    assert each(spark, [(0,), (127,), (128,), (16384,)], "n long", val.varint_bytes(F.col("n"))) == [1, 1, 2, 3]
    assert each(spark, [(1.6,), (float("nan"),), (4e4,), (None,)], "x double", val.quantised(F.col("x"))) == [2, None, None, None]
    assert each(spark, [(4.0,), (-1.0,), (None,)], "x double", val.safe_sqrt(F.col("x"))) == [2.0, None, None]


def test_address_words_and_slots(spark):
    import hashlib

    f = val.canonical_words(F.col("t"), {"st": "street"}, {"strasse": "strasse", "str": "strasse"})
    assert each(spark, [("st james st",), ("ringstrasse",), ("str",), ("",), (None,)], "t string", f) == ["street james street", "ring strasse", "str", "", None]
    assert each(spark, [("abc",), ("",)], "t string", val.hash_slot(F.col("t"), 997)) == [int(hashlib.sha256(x).hexdigest(), 16) % 997 for x in (b"abc", b"")]


def test_rings_and_boxes(spark):
    p = "array<struct<x:double,y:double>>"
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    m = each(spark, [(square,), ([(1.0, 1.0), (1.0, 1.0)],)], f"r {p}", geo.ring_measures(F.col("r")))
    assert tuple(m[0]) == (4.0, 1.0, 1.0) and tuple(m[1]) == (0.0, 1.0, 1.0)
    lines = [([(0.0, 5.0), (10.0, 5.0)],), ([(0.0, 0.0), (3.0, 9.0)],), ([(0.0, 7.0), (7.0, 0.0)],), ([(4.0, 4.0), (4.1, 4.1)],), ([(0.0, 3.0), (10.0, 3.0)],), ([],)]
    assert each(spark, lines, f"l {p}", geo.enters_box(F.col("l"), 4, 4, 6, 6)) == [True, False, False, True, False, False]


def test_quadtree_cells_hold_every_row_once(spark):
    r = random.Random(2)
    rows = [(int(r.triangular(0, 63, 5)), r.randrange(64)) for _ in range(400)] + [(9, 9)] * 30
    got = spatial.quadtree(spark.createDataFrame(rows, "x int, y int"), 6, 10).collect()
    assert sum(c.n for c in got) == len(rows)
    assert all(c.n <= 10 or c.level == 0 for c in got)
    for x, y in rows:
        assert sum((x >> c.level, y >> c.level) == (c.x, c.y) for c in got) == 1


@pytest.mark.parametrize("missing", [False, True])
def test_a_flat_surface_stays_exact(spark, missing):
    corners = spark.createDataFrame([(i, j, 0.1) for i in (0, 1) for j in (0, 1) if not (missing and i and j)], "i long, j long, h double")
    asked = spark.createDataFrame([(1, 0.3, 0.7)], "id int, x double, y double")
    assert spatial.bilinear(corners, asked).first().height == (None if missing else 0.1)


def test_hours_reach_into_the_next_day(spark):
    hours = spark.createDataFrame([(1, 6, 1320, 1560)], "id int, day int, start int, end int")
    asked = spark.createDataFrame([(1, 6, 1320), (1, 0, 119), (1, 0, 120), (1, 5, 1330), (2, 0, 0)], "id int, day int, minute int")
    got = {(r.id, r.day, r.minute): r.state for r in tables.open_states(hours, asked).collect()}
    assert [got[k] for k in [(1, 6, 1320), (1, 0, 119), (1, 0, 120), (1, 5, 1330), (2, 0, 0)]] == ["open", "open", "closed", "closed", "unknown"]
