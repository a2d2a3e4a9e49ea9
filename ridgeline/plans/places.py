"""Spatial queries. The first two dimensions of a vector stand in for a place near 7° E, 47° N
and its label for the kind of place."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query, table
from ..functions import geo
from ..operators import spatial as op
from ..operators import tables

#: Places, and the distance of two of them.
PLACES = """(select vec_id as id, label as kind, 7 + embedding[1]::double / 2 as lon, 47 + embedding[2]::double / 2 as lat from embeddings)"""


def metres(a: str, b: str) -> str:
    x = f"radians({b}.lon - {a}.lon) * cos(radians(({a}.lat + {b}.lat) / 2))"
    return f"6371000.0 * sqrt(({x}) * ({x}) + radians({b}.lat - {a}.lat) * radians({b}.lat - {a}.lat))"


def places(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("label").alias("kind"),
        (7 + e[0].cast("double") / 2).alias("lon"),
        (47 + e[1].cast("double") / 2).alias("lat"),
    )


@query(f"""
select p.id, p.kind, round({metres("p", "f")}, 3) as metres, row_number() over (order by {metres("p", "f")}, p.id) as rank
from {PLACES} p, (select 7.01 as lon, 46.99 as lat) f
where p.kind in (1, 3, 5) and p.lon between 6.9 and 7.1 and p.lat between 46.9 and 47.1 order by rank limit 20
""")
def category_search(spark, d):
    """The 20 places of some kinds within a box that are nearest to a focus."""
    p = places(spark, d).where("kind in (1, 3, 5) and lon between 6.9 and 7.1 and lat between 46.9 and 47.1")
    p = p.withColumn("m", geo.flat_distance(F.col("lon"), F.col("lat"), F.lit(7.01), F.lit(46.99)))
    top = tables.page(p, [F.col("m"), F.col("id")], 20)
    return top.select("id", "kind", F.round("m", 3).alias("metres"), "rank")


@query(f"""
with x as (select a.id as left_id, b.id as right_id, b.kind, {metres("a", "b")} as m from {PLACES} a, {PLACES} b where a.kind = 0 and b.kind <> 0),
r as (select *, row_number() over (partition by left_id, kind order by m, right_id) as rank from x where m <= 3000)
select left_id, kind, right_id, rank, round(m, 3) as metres from r where rank <= 5
""")
def nearest_by_kind(spark, d):
    """The five nearest of each kind within 3 km."""
    p = places(spark, d)
    out = op.nearest(p.where("kind = 0"), p.where("kind <> 0"), 3000.0, 5, ["right_kind"])
    return out.select("left_id", F.col("right_kind").alias("kind"), "right_id", "rank", F.round("metres", 3).alias("metres"))


@query(f"""
with x as (select a.id as left_id, b.id as right_id, {metres("a", "b")} as m from {PLACES} a, {PLACES} b where a.kind = 1 and b.kind = 2),
n as (select *, min(m) over (partition by left_id) as least from x),
t as (select *, case when least <= 600 then 600.0 when least <= 2400 then 2400.0 end as radius from n where m <= least + 250),
r as (select *, row_number() over (partition by left_id order by m, right_id) as rank from t where m <= radius)
select left_id, right_id, rank, radius::double as radius, round(m, 3) as metres from r where rank <= 8
""")
def snap_candidates(spark, d):
    """Candidates within 250 m of the nearest, at 600 m and else at 2.4 km."""
    p = places(spark, d)
    out = op.snap(p.where("kind = 1"), p.where("kind = 2"), [600.0, 2400.0], 250.0, 8)
    return out.select("left_id", "right_id", "rank", "radius", F.round("metres", 3).alias("metres"))


@query(f"""
select a.id, a.kind from {PLACES} a where a.kind = 4 and exists (select 1 from {PLACES} b where b.kind = 6 and {metres("a", "b")} <= 700)
""")
def near_existence(spark, d):
    p = places(spark, d)
    return op.within(p.where("kind = 4"), p.where("kind = 6"), 700.0).select("id", "kind")


#: Areas as rings of x, y.
AREAS = {
    "west": [(6.85, 46.85), (7.0, 46.9), (6.98, 47.1), (6.9, 47.12)],
    "east": [(7.0, 46.9), (7.15, 46.88), (7.2, 47.05), (7.02, 47.03)],
    "notch": [(6.9, 46.95), (7.1, 46.95), (7.1, 47.1), (7.0, 46.98), (6.9, 47.1)],
}


def _inside_sql(ring) -> str:
    edges = zip(ring, [*ring[1:], ring[0]])
    cross = [f"(({ay} > lat) <> ({by} > lat) and lon < ({bx}::double - {ax}) * (lat - {ay}) / ({by}::double - {ay}) + {ax})::int" for (ax, ay), (bx, by) in edges]
    return f"(({' + '.join(cross)}) % 2 = 1)"


@query(" union all ".join(f"select id, '{name}' as area from {PLACES} where {_inside_sql(ring)}" for name, ring in AREAS.items()))
def area_containment(spark, d):
    """Places with every area that holds them."""
    rows = [(name, [{"x": x, "y": y} for x, y in ring]) for name, ring in AREAS.items()]
    areas = spark.createDataFrame(rows, "area string, ring array<struct<x:double,y:double>>")
    return op.containing(places(spark, d), areas, 0.05)


@query(f"""
with a as (select p.id, case when {_inside_sql(AREAS["notch"])} then 'notch' when {_inside_sql(AREAS["east"])} then 'east' end as area,
    floor(lon / 0.1) as cx, floor(lat / 0.1) as cy from {PLACES} p),
g as (select cx, cy, 'cell ' || min(id) as cell from a where id % 3 = 0 group by 1, 2)
select id, coalesce(area, cell, 'elsewhere') as country from a left join g using (cx, cy)
""")
def country_lookup(spark, d):
    """The area of highest priority, else the cell's value, else a default."""
    p = places(spark, d).withColumn("cx", F.floor(F.col("lon") / 0.1)).withColumn("cy", F.floor(F.col("lat") / 0.1))
    rows = [(n, name, [{"x": x, "y": y} for x, y in AREAS[name]]) for n, name in enumerate(("notch", "east"))]
    areas = spark.createDataFrame(rows, "nth int, area string, ring array<struct<x:double,y:double>>")
    held = op.containing(p, areas, 0.05).join(areas.select("area", "nth"), "area").groupBy("id").agg(F.min_by("area", "nth").alias("area"))
    grid = p.where("id % 3 = 0").groupBy("cx", "cy").agg(F.concat(F.lit("cell "), F.min("id").cast("string")).alias("cell"))
    out = p.join(held, "id", "left").join(grid, ["cx", "cy"], "left")
    return out.select("id", F.coalesce("area", "cell", F.lit("elsewhere")).alias("country"))


@query(f"""
with m as (select kind, median(lon) as lon, median(lat) as lat, count(*) as n from {PLACES} group by 1),
s as (select a.kind from m a, m b where a.kind <> b.kind and a.n < 60 and b.n > a.n and {metres("a", "b")} <= 1500)
select kind, round(lon, 9) as lon, round(lat, 9) as lat, n from m where kind not in (select kind from s)
""")
def median_suppression(spark, d):
    """Medians by code; small codes near a larger one are dropped."""
    m = places(spark, d).groupBy("kind").agg(
        F.expr("percentile(lon, 0.5)").alias("lon"), F.expr("percentile(lat, 0.5)").alias("lat"), F.count("*").alias("n")
    ).withColumnRenamed("kind", "id")
    weak = op.near_pairs(m.where("n < 60"), m, 1500.0).where("left_id <> right_id and right_n > left_n").select(F.col("left_id").alias("id"))
    out = m.join(weak, "id", "left_anti")
    return out.select(F.col("id").alias("kind"), F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), "n")


@query(None)
def proximity_dedup(spark, d):
    """Places of a kind in order of id; each drops later ones within 600 m."""
    return op.spaced(places(spark, d), ["kind"], 600.0, [F.col("id")])


TILE_X = "floor((lon + 180) / 360 * 2048)::bigint"
TILE_Y = "floor((1 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (2 * pi())) / 2 * 2048)::bigint"


@query(f"select {TILE_X} as x, {TILE_Y} as y, kind, count(*) as n, min(id) as first from {PLACES} group by all")
def point_tiles(spark, d):
    """Places by tile of zoom 11."""
    x, y = geo.tile(F.col("lon"), F.col("lat"), 11)
    return places(spark, d).groupBy(x.alias("x"), y.alias("y"), "kind").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query(f"""
with t as (select id, {TILE_X} as x, {TILE_Y} as y from {PLACES})
select id, list_sum(list_transform(range(11), lambda b: ((x >> b) & 1) * (1 << (2 * b)) + ((y >> b) & 1) * (1 << (2 * b + 1))))::bigint as key from t
""")
def z_order_keys(spark, d):
    x, y = geo.tile(F.col("lon"), F.col("lat"), 11)
    return places(spark, d).select("id", geo.z_order(x, y, 11).alias("key"))


@query(None)
def hilbert_tiles(spark, d):
    x, y = geo.tile(F.col("lon"), F.col("lat"), 11)
    return places(spark, d).select("id", x.alias("x"), y.alias("y"), geo.hilbert_tile(x, y, 11).alias("tile"))


LINE = [(6.86, 46.9), (6.95, 47.0), (7.05, 46.97), (7.12, 47.08)]


def _position_sql() -> str:
    parts = []
    for n, ((ax, ay), (bx, by)) in enumerate(zip(LINE, LINE[1:])):
        t = f"least(greatest(((lon - {ax}) * ({bx} - {ax})::double + (lat - {ay}) * ({by} - {ay})::double) / (({bx} - {ax})::double ** 2 + ({by} - {ay})::double ** 2), 0), 1)"
        parts.append(
            f"select id, {n} as segment, {t} as t, sqrt((lon - ({ax} + {t} * ({bx} - {ax})::double)) ** 2 + (lat - ({ay} + {t} * ({by} - {ay})::double)) ** 2) as away from {PLACES}"
        )
    return " union all ".join(parts)


@query(f"""
select id, segment::int as segment, round(t, 6) as t, round(away, 6) as away from (
    select *, row_number() over (partition by id order by away, segment) as r from ({_position_sql()})) where r = 1
""")
def route_position(spark, d):
    """The nearest segment of a route, the first on a tie, and the place on it."""
    found = []
    for n, ((ax, ay), (bx, by)) in enumerate(zip(LINE, LINE[1:])):
        away, t = geo.on_segment(F.col("lon"), F.col("lat"), *(F.lit(v) for v in (ax, ay, bx, by)))
        found.append(F.struct(away.alias("away"), F.lit(n).alias("segment"), t.alias("t")))
    p = places(spark, d).select("id", F.array_min(F.array(*found)).alias("b"))
    return p.select("id", "b.segment", F.round("b.t", 6).alias("t"), F.round("b.away", 6).alias("away"))


@query(f"""
with t as (select a.id, a.kind, case when min({metres("a", "b")}) <= 500 then 500 when min({metres("a", "b")}) <= 1500 then 1500 when min({metres("a", "b")}) <= 5000 then 5000 end as tier
    from {PLACES} a, {PLACES} b where a.kind = 7 and b.kind = 8 group by 1, 2)
select a.id, t.tier, count(*) as found from t join {PLACES} a on a.id = t.id join {PLACES} b on b.kind = 8 and {metres("a", "b")} <= t.tier group by 1, 2
""")
def widening_search(spark, d):
    """The smallest of three radii that finds anything, and how many it finds."""
    p = places(spark, d)
    pairs = op.widened(p.where("kind = 7"), p.where("kind = 8"), [500.0, 1500.0, 5000.0])
    return pairs.groupBy(F.col("left_id").alias("id"), F.col("tier").cast("int").alias("tier")).agg(F.count("*").alias("found"))


@query(f"""
with c as (select floor(lon / 0.02)::bigint as i, floor(lat / 0.02)::bigint as j, avg(id % 97)::double as h from {PLACES} group by 1, 2),
n as (select a.i, a.j, a.h, avg(b.h) as around, max(b.h) as most, count(b.h) as known from c a left join c b
    on abs(a.i - b.i) <= 1 and abs(a.j - b.j) <= 1 and (a.i, a.j) <> (b.i, b.j) group by 1, 2, 3)
select i, j, round(h, 6) as h, round(around, 6) as around, coalesce(h - around >= 10, false) as crest from n
""")
def crest_cells(spark, d):
    """Cells that stand ten above the mean of their eight neighbours (a stencil by shifted copies)."""
    c = places(spark, d).groupBy(F.floor(F.col("lon") / 0.02).alias("i"), F.floor(F.col("lat") / 0.02).alias("j")).agg(F.avg(F.col("id") % 97).alias("h"))
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
    shifted = c.select(
        F.explode(F.array(*(F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a, b in around))).alias("at"), "h"
    )
    means = shifted.groupBy("at.i", "at.j").agg(F.avg("h").alias("around"))
    out = c.join(means, ["i", "j"], "left")
    crest = F.coalesce(F.col("h") - F.col("around") >= 10, F.lit(False))
    return out.select("i", "j", F.round("h", 6).alias("h"), F.round("around", 6).alias("around"), crest.alias("crest"))


@query(f"""
with c as (select floor(lon / 0.01)::bigint as i, floor(lat / 0.01)::bigint as j, min(id) as id from {PLACES} group by 1, 2),
v as (select c.i, c.j, e.label as v from c join embeddings e on e.vec_id = c.id),
p as (select i >> 1 as i, j >> 1 as j, v, count(*) as n, min((j & 1) * 2 + (i & 1)) as first from v group by 1, 2, 3)
select i, j, (list(v order by n desc, first))[1] as mode from p group by 1, 2
""")
def tile_parents(spark, d):
    """The most common value of four children, the first in reading order on a tie."""
    p = places(spark, d)
    c = p.groupBy(F.floor(F.col("lon") / 0.01).alias("i"), F.floor(F.col("lat") / 0.01).alias("j")).agg(F.min_by("kind", "id").alias("v"))
    place = (F.col("j").bitwiseAND(1) * 2 + F.col("i").bitwiseAND(1)).alias("place")
    up = c.groupBy(F.shiftright("i", 1).alias("i"), F.shiftright("j", 1).alias("j"), "v").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    return up.groupBy("i", "j").agg(F.max_by("v", F.struct("n", -F.col("first"))).alias("mode"))
