"""Queries on ways and tables of places. Vectors stand for lines, parts for points, orders for records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query, table
from ..operators import overlaps, series
from ..operators import ways as op
from .lines import POINTS, lines
from .places import PLACES, places
from .rides import SAMPLES, samples

#: Points of a plane among the lines.
SPOTS = "select p_partkey as id, (p_partkey * 353 % 30000)::double as x, (p_partkey * 911 % 38000)::double as y from part"
#: Lines in the direction that the data has them.
DIRECTED = f"(select id, case when id % 2 = 1 then 5 - n else n end as n, x, y from ({POINTS}))"


@query(f"""
with s as (select id as way, n as segment, x as ax, y as ay, lead(x) over w as qx, lead(y) over w as qy from {DIRECTED} window w as (partition by id order by n)),
t as (select p.id, way, segment, x - ax as px, y - ay as py, qx - ax as dx, qy - ay as dy from ({SPOTS}) p, s where qx is not null),
m as (select id, way, segment, sqrt((px - u * dx) ** 2 + (py - u * dy) ** 2) as metres
    from (select *, greatest(0, least(1, (px * dx + py * dy) / (dx * dx + dy * dy))) as u from t)),
r as (select *, row_number() over (partition by id order by round(metres, 6), way, segment) as k from m where metres <= 400)
select id, way, segment::int as segment, round(metres, 6) as metres from r where k = 1
""")
def nearest_way(spark, d):
    """The line nearest to each point, within 400 m."""
    p = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_partkey") * 353 % 30000).cast("double").alias("x"), (F.col("p_partkey") * 911 % 38000).cast("double").alias("y")
    )
    return op.nearest_way(p, lines(spark, d).select("id", "points"), 400.0).select("id", "way", "segment", F.round("metres", 6).alias("metres"))


@query(f"""
with recursive p as materialized (select user_id as id, t::double / 1000 as x, value as y, row_number() over (partition by user_id order by t, event_id) - 1 as n from ({SAMPLES})),
r(id, a, b) as (select id, 0, max(n) from p group by id
    union all select id, unnest([a, m]), unnest([m, b]) from (
        select id, a, b, min(n) filter (far = top) as m, any_value(top) as top from (
            select *, max(far) over (partition by id, a, b) as top from (
                select r.id, r.a, r.b, v.n, sqrt((v.x - f.x - u * (g.x - f.x)) ** 2 + (v.y - f.y - u * (g.y - f.y)) ** 2) as far from r
                join p f on f.id = r.id and f.n = r.a join p g on g.id = r.id and g.n = r.b join p v on v.id = r.id and v.n > r.a and v.n < r.b,
                lateral (select case when (g.x - f.x) ** 2 + (g.y - f.y) ** 2 > 0 then greatest(0, least(1, ((v.x - f.x) * (g.x - f.x) + (v.y - f.y) * (g.y - f.y)) / ((g.x - f.x) ** 2 + (g.y - f.y) ** 2))) else 0 end as u) l)) group by 1, 2, 3) where top > 90)
select distinct id as user_id, k::int as n from (select id, unnest([a, b]) as k from r)
""")
def simplified_lines(spark, d):
    """The vertices of each user's line that a tolerance of 90 leaves."""
    s = samples(spark, d).select("user_id", F.struct("t", "event_id").alias("at"), (F.col("t").cast("double") / 1000).alias("x"), F.col("value").alias("y"))
    s = series.gathered(s, ["user_id"], "at", ["x", "y"])
    kept = op.simplified(F.transform("series", lambda r: r["x"]), F.transform("series", lambda r: r["y"]), F.lit(90.0))
    return s.select("user_id", F.explode(kept).alias("n"))


@query(f"""
with g as (select vec_id as id, vec_id % 50 + 1 as first, vec_id % 50 + 1 + (vec_id % 13 - 6) * 3 as last, ['all', 'odd', 'even', '3'][vec_id % 4 + 1] as kind from embeddings),
h as (select *, least(first, last) as low, greatest(first, last) as high, case kind when 'all' then 1 when '3' then 3 else 2 end as step from g),
c as (select *, case when kind in ('all', '3') then low + step when (low % 2 <> 0) = (kind = 'odd') then low + 2 else low + 1 end as f from h where abs(last - first) > step),
s as (select id, n, x, y, lead(x) over w as qx, lead(y) over w as qy from {DIRECTED} window w as (partition by id order by n)),
l as (select *, sqrt((qx - x) ** 2 + (qy - y) ** 2) as size from s where qx is not null),
m as (select *, sum(size) over (partition by id order by n) as upto, sum(size) over (partition by id) as whole from l),
k as (select *, unnest(range(f, high, step)) as number from c),
q as (select k.id, number, whole * abs(number - first) / abs(last - first) as place, m.* exclude (id) from k join m using (id)),
r as (select *, row_number() over (partition by id, number order by n) as nth from q where place <= upto + 1e-6)
select id, number, round(x + (qx - x) * (place - upto + size) / size, 3) as x, round(y + (qy - y) * (place - upto + size) / size, 3) as y from r where nth = 1
""")
def numbers_along(spark, d):
    """House numbers inside rising and falling ranges, spread along lines."""
    i, line = F.col("id"), lines(spark, d)
    first = i % 50 + 1
    kind = F.element_at(F.array(*(F.lit(k) for k in ("all", "odd", "even", "3"))), (i % 4 + 1).cast("int"))
    ranges = line.select("id", first.alias("first"), (first + (i % 13 - 6) * 3).alias("last"), kind.alias("kind"), "points")
    return op.numbers_along(ranges).select("id", "number", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(f"""
with recursive s as materialized (select user_id, floor(value / 25)::int as key, event_type, row_number() over (partition by user_id order by t, event_id) - 1 as n from ({SAMPLES})),
v as materialized (select user_id, key, row_number() over (partition by user_id order by n) as k from s where event_type = 'click'),
r(user_id, k, pos, found) as (select distinct user_id, 0::bigint, 0::bigint, null::bigint from v
    union all select v.user_id, v.k, coalesce(min(s.n), any_value(r.pos)), min(s.n) from r join v on v.user_id = r.user_id and v.k = r.k + 1
        left join s on s.user_id = r.user_id and s.n >= r.pos and s.key = v.key group by v.user_id, v.k)
select user_id, k::int as vertex, found::int as sample from r where k > 0
""")
def forward_matches(spark, d):
    """Each vertex of a line matched to the first later sample at the same rounded place."""
    s = samples(spark, d).select("user_id", F.struct("t", "event_id").alias("at"), F.floor(F.col("value") / 25).cast("int").alias("key"), (F.col("event_type") == "click").alias("vertex"))
    s = series.gathered(s, ["user_id"], "at", ["key", "vertex"])
    vertices = F.transform(F.filter("series", lambda r: r["vertex"]), lambda r: r["key"])
    found = s.select("user_id", F.posexplode(op.forward_matches(vertices, F.transform("series", lambda r: r["key"]))).alias("vertex", "sample"))
    return found.select("user_id", (F.col("vertex") + 1).alias("vertex"), "sample")


@query("select o_orderkey, o_totalprice, row_number() over (order by o_totalprice, o_orderkey) - 1 as nth from orders")
def total_order(spark, d):
    """All orders numbered by price, then key."""
    return op.numbered(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])


@query("""
select l_orderkey, l_linenumber, l_partkey, o_orderpriority from lineitem join orders on l_orderkey = o_orderkey
""")
def keyed_overlay(spark, d):
    """Rows of one table beside those of another in order of their key: a merge join."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").hint("merge").join(o, "l_orderkey")


@query("select c_custkey, c_name, c_acctbal from customer where c_custkey = 42 limit 1")
def point_lookup(spark, d):
    """One record by its key; the filter reaches the scan."""
    return table(spark, d, "customer").where("c_custkey = 42").select("c_custkey", "c_name", "c_acctbal").limit(1)


@query("""
with r as (select c_custkey, c_acctbal, c_custkey in (select o_custkey from orders) as has_orders, c_custkey in (select s_suppkey from supplier) as has_suppliers from customer)
select c_custkey, has_orders, has_suppliers, (has_orders or has_suppliers) and c_acctbal >= 0 as usable from r
""")
def record_memberships(spark, d):
    """Which records have rows elsewhere, and which of them may be used."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    held = {"orders": table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "suppliers": table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"))}
    m = op.memberships(c, "c_custkey", held)
    return m.select("c_custkey", "has_orders", "has_suppliers", ((F.col("has_orders") | F.col("has_suppliers")) & (F.col("c_acctbal") >= 0)).alias("usable"))


@query(f"""
select user_id, event_id, case when height is null or height < 0 then 'height' when not coalesce(value <= 300, false) then 'limit'
    when t <= lag(t) over (partition by user_id order by event_id) then 'order' end as fault from ({SAMPLES})
""")
def first_faults(spark, d):
    """The first check that each sample fails: its height, its limit, its time after the one before."""
    before = F.lag("t").over(Window.partitionBy("user_id").orderBy("event_id"))
    rules = {"height": F.col("height") >= 0, "limit": F.col("value") <= 300, "order": before.isNull() | (F.col("t") > before)}
    return samples(spark, d).select("user_id", "event_id", op.first_fault(rules).alias("fault"))


@query("select event_id, round(value - 0.0065 * ((event_id % 2000) - 500), 6) as degrees, round_even(event_id / 2.0, 0)::bigint as half from events")
def lapsed_degrees(spark, d):
    """Temperatures at another height, and halves to the even number."""
    degrees = F.col("value") - 0.0065 * ((F.col("event_id") % 2000) - 500)
    return table(spark, d, "events").select("event_id", F.round(degrees, 6).alias("degrees"), F.bround(F.col("event_id").cast("decimal(20,1)") / 2, 0).cast("bigint").alias("half"))


@query("""
with recursive a as (select distinct s_nationkey as area, s_suppkey % 40 as cell from supplier),
n as (select area, list(cell) as cells, count(*) as size from a group by 1),
o as (select *, row_number() over (order by size desc, area) as k from n),
r(k, kept) as (select 0::bigint, (select list(area) from o)
    union all select r.k + 1, case when (select bool_and((select count(*) from a x where x.cell = y.cell and list_contains(r.kept, x.area)) > 1) from a y where y.area = o.area)
        then list_filter(r.kept, lambda z: z <> o.area) else r.kept end from r join o on o.k = r.k + 1)
select unnest(kept) as area from r where k = (select max(k) from o)
""")
def reduced_cover(spark, d):
    """Areas that are left when those that the others cover go, the largest first."""
    return op.reduced_cover(table(spark, d, "supplier").select(F.col("s_nationkey").alias("area"), (F.col("s_suppkey") % 40).alias("cell")))


@query(f"""
with p as (select greatest(0, least(2047, floor((lon - 6) / 0.001)))::bigint as x, greatest(0, least(2047, floor((lat - 46) / 0.001)))::bigint as y, 40 + id % 100 as size from {PLACES}),
n as (select k, x >> k as cx, y >> k as cy, sum(size)::bigint as size from p, range(0, 12) r(k) group by 1, 2, 3)
select a.k::int as level, a.cx as x, a.cy as y, a.size from n a left join n b on b.k = a.k + 1 and b.cx = a.cx >> 1 and b.cy = a.cy >> 1
where (a.size <= 1500 or a.k = 0) and (a.k = 11 or b.size > 1500)
""")
def budget_cells(spark, d):
    """Squares of a grid whose files stay within 1,500 bytes."""
    hold = lambda c: F.greatest(F.lit(0), F.least(F.lit(2047), c)).cast("long")
    x, y = hold(F.floor((F.col("lon") - 6) / 0.001)), hold(F.floor((F.col("lat") - 46) / 0.001))
    return op.budget_cells(places(spark, d).select(x.alias("x"), y.alias("y"), (40 + F.col("id") % 100).alias("size")), 11, 1500)


@query(f"""
with recursive g as (select user_id, value, event_type, row_number() over (partition by user_id order by t, event_id) as n,
    sum((event_type = 'error')::int) over (partition by user_id order by t, event_id) as part from ({SAMPLES})),
s as materialized (select user_id, part, value, row_number() over (partition by user_id, part order by n) as n from g where event_type <> 'error'),
f as (select user_id, part, n, value as ref, 0.0::double as up from s where n = 1
    union all select s.user_id, s.part, s.n, case when abs(value - ref) >= 30 then value else ref end, up + case when value - ref >= 30 then value - ref else 0 end
    from f join s on s.user_id = f.user_id and s.part = f.part and s.n = f.n + 1),
e as (select *, row_number() over (partition by user_id, part order by n desc) as r from f)
select user_id, round(sum(up), 4) as up, count(*) as parts from e where r = 1 group by 1
""")
def paused_climb(spark, d):
    """Ascent over parts of a ride between pauses: a pause drops the reference and keeps the total."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    s = samples(spark, d).withColumn("part", F.sum((F.col("event_type") == "error").cast("int")).over(w)).where("event_type <> 'error'")
    s = series.gathered(s.select("user_id", "part", F.struct("t", "event_id").alias("at"), "value"), ["user_id", "part"], "at", ["value"])
    up = series.dead_band(F.transform("series", lambda x: x["value"]), 30.0)["up"]
    return s.select("user_id", up.alias("up")).groupBy("user_id").agg(F.round(F.sum("up"), 4).alias("up"), F.count("*").alias("parts"))


#: West, south, east and north of a part of the plane.
WINDOW = (10_100.5, 5_000.0, 40_000.0, 25_020.5)


def _ends_sql(axis: str, low: float, high: float) -> tuple[str, str]:
    ends = f"({low}::double - a{axis}) / d{axis}, ({high}::double - a{axis}) / d{axis}"
    inside = f"when a{axis} between {low} and {high} then 0 else 2"
    return f"case when d{axis} <> 0 then least({ends}) {inside} end", f"case when d{axis} <> 0 then greatest({ends}) else 1 end"


CLIPS = [_ends_sql("x", WINDOW[0], WINDOW[2]), _ends_sql("y", WINDOW[1], WINDOW[3])]


@query(f"""
with s as (select id, n, x as ax, y as ay, lead(x) over w - x as dx, lead(y) over w - y as dy from {DIRECTED} window w as (partition by id order by n)),
t as (select *, greatest(0, {CLIPS[0][0]}, {CLIPS[1][0]}) as i, least(1, {CLIPS[0][1]}, {CLIPS[1][1]}) as o from s where dx is not null),
k as (select *, coalesce(i = 0 and lag(o) over w = 1 and lag(n) over w = n - 1, false) as goes_on from t where i < o window w as (partition by id order by n))
select id, sum((not goes_on)::int) over (partition by id order by n)::bigint as part, n::int as n,
    round(ax + dx * i, 6) as ax, round(ay + dy * i, 6) as ay, round(ax + dx * o, 6) as bx, round(ay + dy * o, 6) as by from k
""")
def clipped_lines(spark, d):
    """The parts of lines that lie in a box."""
    out = op.clipped(lines(spark, d).select("id", "points"), WINDOW)
    return out.select("id", "part", "n", *(F.round(c, 6).alias(c) for c in ("ax", "ay", "bx", "by")))


#: Areas of four corners about the third vertex of every fifth line, some large.
CORNERS = ((-1, -1), (2, -0.5), (1, 1), (-0.5, 2))


@query(f"""
with p as (select id, n, x::double as x, y::double as y from {DIRECTED}), c as (select id as area, x, y, (50 + id % 40 * 60)::double as w from p where n = 2 and id % 5 = 0),
r as (select area, k, x + w * [{', '.join(f"{x}::double" for x, _ in CORNERS)}][k] as x, y + w * [{', '.join(f"{y}::double" for _, y in CORNERS)}][k] as y from c, range(1, 5) t(k)),
e as materialized (select r.area, r.x as sx, r.y as sy, s.x as tx, s.y as ty from r join r s on s.area = r.area and s.k = r.k % 4 + 1),
v as (select id, n, x as px, y as py, lead(x) over w as qx, lead(y) over w as qy from p window w as (partition by id order by n)),
h as (select distinct area, id as line from e, v where qx is not null
    and greatest(sx, tx) >= least(px, qx) and greatest(px, qx) >= least(sx, tx) and greatest(sy, ty) >= least(py, qy) and greatest(py, qy) >= least(sy, ty)
    and sign((tx - sx) * (py - sy) - (ty - sy) * (px - sx)) * sign((tx - sx) * (qy - sy) - (ty - sy) * (qx - sx)) <= 0
    and sign((qx - px) * (sy - py) - (qy - py) * (sx - px)) * sign((qx - px) * (ty - py) - (qy - py) * (tx - px)) <= 0),
i as (select area, id as line from e, v where n = 0 and (sy > py) <> (ty > py) and px < (tx - sx) * (py - sy) / (ty - sy) + sx group by 1, 2 having count(*) % 2 = 1)
select area, line from h union select area, line from i
""")
def areas_meeting_lines(spark, d):
    """Areas with the lines that cross or lie in them."""
    line = lines(spark, d)
    w, at = (F.lit(50) + F.col("id") % 40 * 60).cast("double"), F.col("points")[2]
    corner = lambda x, y: F.struct((at["x"] + w * float(x)).alias("x"), (at["y"] + w * float(y)).alias("y"))
    areas = line.where("id % 5 = 0").select(F.col("id").alias("area"), F.array(*(corner(*c) for c in CORNERS)).alias("ring"))
    return overlaps.meeting(areas, line, 500.0)
