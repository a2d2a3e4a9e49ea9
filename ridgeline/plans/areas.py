"""Areas, rings, boxes and rasters. Vectors stand for rings and places, their cells for rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query, table
from ..functions import geo
from ..operators import spatial as op
from .places import PLACES, metres, places

#: Rings of four corners from the first eight dimensions, in a plane.
RINGS = """(select vec_id as id, [{'x': embedding[1]::double, 'y': embedding[2]::double}, {'x': 1 + embedding[3]::double, 'y': embedding[4]::double},
    {'x': 1 + embedding[5]::double, 'y': 1 + embedding[6]::double}, {'x': embedding[7]::double, 'y': 1 + embedding[8]::double}] as ring from embeddings)"""


def rings(spark, d):
    e = F.col("embedding")
    corner = lambda k, x, y: F.struct((e[k].cast("double") + x).alias("x"), (e[k + 1].cast("double") + y).alias("y"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.array(corner(0, 0, 0), corner(2, 1, 0), corner(4, 1, 1), corner(6, 0, 1)).alias("ring"))


@query(f"""
with e as (select id, unnest(range(1, 5)) as k, ring from {RINGS}),
c as (select id, ring[k].x as x, ring[k].y as y, ring[k % 4 + 1].x as u, ring[k % 4 + 1].y as v from e),
s as (select id, sum(x * v - u * y) / 2 as area, sum((x + u) * (x * v - u * y)) as cx, sum((y + v) * (x * v - u * y)) as cy from c group by 1)
select id, round(abs(area), 9) as area, round(cx / (6 * area), 6) as x, round(cy / (6 * area), 6) as y from s where abs(area) > 1e-6
""")
def ring_measures(spark, d):
    """Area and centre of each ring."""
    m = rings(spark, d).select("id", geo.ring_measures(F.col("ring")).alias("m")).where("abs(m.area) > 1e-6")
    return m.select("id", F.round(F.abs("m.area"), 9).alias("area"), F.round("m.x", 6).alias("x"), F.round("m.y", 6).alias("y"))


@query(f"select kind, min(lon) - 0.01 as west, min(lat) - 0.01 as south, max(lon) + 0.01 as east, max(lat) + 0.01 as north, count(*) as n from {PLACES} group by 1")
def envelopes(spark, d):
    """The box around each kind of place, a little wider."""
    lon, lat = F.col("lon"), F.col("lat")
    return places(spark, d).groupBy("kind").agg(
        (F.min(lon) - 0.01).alias("west"), (F.min(lat) - 0.01).alias("south"), (F.max(lon) + 0.01).alias("east"), (F.max(lat) + 0.01).alias("north"), F.count("*").alias("n")
    )


@query(f"""
with b as (select id, lon - 0.013 as w, lon + 0.013 as e, lat - 0.008 as s, lat + 0.008 as n from {PLACES})
select id, i.i as cx, j.j as cy from b, range(250, 450) i(i), range(2000, 2800) j(j)
where i.i between floor(w / 0.02) and floor(e / 0.02) and j.j between floor(s / 0.02) and floor(n / 0.02)
""")
def box_cells(spark, d):
    """Every cell that a box touches, its greatest edge included."""
    p, side = places(spark, d), 0.02
    cover = lambda c, r: F.explode(F.sequence(F.floor((c - r) / side), F.floor((c + r) / side)))
    return p.select("id", "lat", cover(F.col("lon"), 0.013).alias("cx")).select("id", "cx", cover(F.col("lat"), 0.008).alias("cy"))


@query(f"""
with c as (select floor(lon / 0.01)::bigint as i, floor(lat / 0.01)::bigint as j, case when kind <> 3 then id % 100 end as h from {PLACES})
select i // 4 as i, j // 4 as j, max(h) as most, round(avg(h), 9) as mean, count(h) as known from c group by 1, 2
""")
def pooled_squares(spark, d):
    """Greatest and mean value of each square of cells, over those that are known."""
    h = F.when(F.col("kind") != 3, F.col("id") % 100)
    c = places(spark, d).select(F.floor(F.col("lon") / 0.01).alias("i"), F.floor(F.col("lat") / 0.01).alias("j"), h.alias("h"))
    g = c.groupBy(F.expr("i div 4").alias("i"), F.expr("j div 4").alias("j"))
    return g.agg(F.max("h").alias("most"), F.round(F.avg("h"), 9).alias("mean"), F.count("h").alias("known"))


@query(f"""
with recursive l as (select 3 as z, floor(lon / 0.01)::bigint as x, floor(lat / 0.01)::bigint as y, avg(id % 100) as v, count(*) filter (kind = 1) * 2 > count(*) as snow from {PLACES} group by 1, 2, 3),
a as (select 2 as z, x >> 1 as x, y >> 1 as y, avg(v) as v, count(*) filter (snow) * 2 > count(*) as snow from l group by 2, 3),
b as (select 1 as z, x >> 1 as x, y >> 1 as y, avg(v) as v, count(*) filter (snow) * 2 > count(*) as snow from a group by 2, 3),
c as (select 0 as z, x >> 1 as x, y >> 1 as y, avg(v) as v, count(*) filter (snow) * 2 > count(*) as snow from b group by 2, 3)
select z, x, y, round(v, 6) as v, snow from (from l union all from a union all from b union all from c)
""")
def tile_pyramid(spark, d):
    """Tiles and their parents up to a top zoom: mean of the children's values, majority of their flags."""
    p = places(spark, d)
    leaf = p.groupBy(F.floor(F.col("lon") / 0.01).alias("x"), F.floor(F.col("lat") / 0.01).alias("y")).agg(
        F.avg(F.col("id") % 100).alias("v"), (F.count_if(F.col("kind") == 1) * 2 > F.count("*")).alias("snow")
    )
    return op.pyramid(leaf, 3).select("z", "x", "y", F.round("v", 6).alias("v"), "snow")


@query(f"""
with c as (select floor(lon / 0.05)::bigint as i, floor(lat / 0.05)::bigint as j, avg(id % 100)::double as h from {PLACES} group by 1, 2),
q as (select id, lon / 0.05 - floor(lon / 0.05) as u, lat / 0.05 - floor(lat / 0.05) as v, floor(lon / 0.05)::bigint as i, floor(lat / 0.05)::bigint as j from {PLACES})
select q.id, round(a.h + (b.h - a.h) * u + (c.h - a.h) * v + (a.h - b.h - c.h + e.h) * u * v, 6) as height from q
left join c a on a.i = q.i and a.j = q.j left join c b on b.i = q.i + 1 and b.j = q.j left join c c on c.i = q.i and c.j = q.j + 1 left join c e on e.i = q.i + 1 and e.j = q.j + 1
""")
def bilinear_heights(spark, d):
    """Heights between four corners; unknown where a corner is."""
    p, side = places(spark, d), 0.05
    i, j = F.floor(F.col("lon") / side), F.floor(F.col("lat") / side)
    corners = p.groupBy(i.alias("i"), j.alias("j")).agg(F.avg(F.col("id") % 100).alias("h"))
    asked = p.select("id", (F.col("lon") / side).alias("x"), (F.col("lat") / side).alias("y"))
    return op.bilinear(corners, asked).select("id", F.round("height", 6).alias("height"))


@query(f"""
with a as (select * from {PLACES} where kind = 2), h as (select * from {PLACES} where kind = 5),
x as (select a.id, h.id as house, {metres("a", "h")} as m from a, h)
select id, arg_min(house, (m, house)) as house, round(min(m), 3) as metres from x where m <= 2000 group by 1
""")
def reverse_geocode(spark, d):
    """The nearest house of each place within 2 km."""
    p = places(spark, d)
    out = op.nearest(p.where("kind = 2"), p.where("kind = 5"), 2000.0)
    return out.select(F.col("left_id").alias("id"), F.col("right_id").alias("house"), F.round("metres", 3).alias("metres"))


@query(f"""
with e as (select id, unnest(range(1, 5)) as k, ring from {RINGS}), s as (select id, ring[k] as a, ring[k % 4 + 1] as b from e),
f as (select id, bool_or(greatest(a.x, b.x) >= 0.4 and least(a.x, b.x) <= 0.6 and greatest(a.y, b.y) >= 0.9 and least(a.y, b.y) <= 1.1 and
    not (((b.x - a.x) * (0.9 - a.y) - (b.y - a.y) * (0.4 - a.x) > 0) = ((b.x - a.x) * (0.9 - a.y) - (b.y - a.y) * (0.6 - a.x) > 0) and
         ((b.x - a.x) * (0.9 - a.y) - (b.y - a.y) * (0.4 - a.x) > 0) = ((b.x - a.x) * (1.1 - a.y) - (b.y - a.y) * (0.4 - a.x) > 0) and
         ((b.x - a.x) * (0.9 - a.y) - (b.y - a.y) * (0.4 - a.x) > 0) = ((b.x - a.x) * (1.1 - a.y) - (b.y - a.y) * (0.6 - a.x) > 0))) as hit from s group by 1)
select id from f where hit
""")
def line_box_tests(spark, d):
    """Rings whose line enters a box."""
    r = F.col("ring")
    return rings(spark, d).where(geo.enters_box(F.concat(r, F.slice(r, 1, 1)), 0.4, 0.9, 0.6, 1.1)).select("id")


@query(f"""
with p as (select floor((lon - 6) / 0.001)::bigint as x, floor((lat - 46) / 0.001)::bigint as y from {PLACES}),
z as (select greatest(0, least(2047, x)) as x, greatest(0, least(2047, y)) as y from p),
n as (select k, x >> k as cx, y >> k as cy, count(*) as n from z, range(0, 12) r(k) group by 1, 2, 3)
select a.k::int as level, a.cx as x, a.cy as y, a.n from n a left join n b on b.k = a.k + 1 and b.cx = a.cx >> 1 and b.cy = a.cy >> 1
where (a.n <= 20 or a.k = 0) and (a.k = 11 or b.n > 20)
""")
def quadtree_cells(spark, d):
    """Squares split four ways until each holds at most twenty rows."""
    hold = lambda c: F.greatest(F.lit(0), F.least(F.lit(2047), c)).cast("long")
    x, y = hold(F.floor((F.col("lon") - 6) / 0.001)), hold(F.floor((F.col("lat") - 46) / 0.001))
    return op.quadtree(places(spark, d).select(x.alias("x"), y.alias("y")), 11, 20)


@query(f"""
with a as (select id % 7 as code, id, lon, lat from {PLACES})
select code, round(quantile_cont(lon, 0.5), 6) as lon, round(quantile_cont(lat, 0.5), 6) as lat, count(*) as n from a group by 1
""")
def code_centres(spark, d):
    """The median place of each code."""
    p = places(spark, d)
    return p.groupBy((F.col("id") % 7).alias("code")).agg(F.round(F.median("lon"), 6).alias("lon"), F.round(F.median("lat"), 6).alias("lat"), F.count("*").alias("n"))
