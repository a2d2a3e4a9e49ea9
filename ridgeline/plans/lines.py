"""Queries on lines and on rows along them. Twelve vectors stand for a family of lines of six
points, so that more vectors cover more land; events of a user stand for places along a way, orders for rides."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query, table
from ..operators import graph, groups
from ..operators import lines as op
from ..operators import series
from .graphs import ROADS, roads
from .rides import SAMPLES, samples

#: Lines in metres, their vertices with weights, their segments, and the cover of one by another.
POINTS = """select vec_id as id, k as n, (vec_id // 12 * 700 % 70000 + k * 200 + vec_id * 37 % 120)::double as x,
    (vec_id // 12 * 911 % 40000 + vec_id * 53 % 90 + k * k * 10)::double as y from embeddings, range(6) r(k)"""
COVER = f"""p as ({POINTS}), s as (select id, x as ax, y as ay, lead(x) over w as qx, lead(y) over w as qy, lag(x) over w as px, lag(y) over w as py
    from p window w as (partition by id order by n)),
v as (select id, ax as x, ay as y, (coalesce(sqrt((qx - ax) ** 2 + (qy - ay) ** 2), 0) + coalesce(sqrt((px - ax) ** 2 + (py - ay) ** 2), 0)) / 2 as w from s),
t as (select v.*, s.id as other, ax, ay, qx, qy, greatest(0, least(1, ((x - ax) * (qx - ax) + (y - ay) * (qy - ay)) / ((qx - ax) ** 2 + (qy - ay) ** 2))) as u
    from v, s where qx is not null and v.id <> s.id),
h as (select id, other, x, y, w, min(sqrt((x - ax - u * (qx - ax)) ** 2 + (y - ay - u * (qy - ay)) ** 2)) as m from t group by all having m <= 60.5),
c as (select id, other, sum(w) / (select sum(w) from v where v.id = h.id) as share from h group by 1, 2)"""


def lines(spark, d):
    """Lines; those of odd numbers run backwards, which makes no difference to their cover."""
    i, family = F.col("vec_id"), F.expr("vec_id div 12")

    def point(k):
        x = family * 700 % 70000 + k * 200 + i * 37 % 120
        y = family * 911 % 40000 + i * 53 % 90 + k * k * 10
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    points = F.transform(F.sequence(F.lit(0), F.lit(5)), point)
    name = F.concat(F.lit("R"), (i % 7).cast("string"))
    return table(spark, d, "embeddings").select(i.alias("id"), F.when(i % 2 == 1, F.reverse(points)).otherwise(points).alias("points"), name.alias("name"))


@query(f"with {COVER} select id, other, round(share, 9) as share from c")
def line_coverage(spark, d):
    """The share of each line within 60 m of another."""
    rows = lines(spark, d)
    return op.coverage(rows, rows, 60.5, 500.0).select("id", "other", F.round("share", 9).alias("share"))


@query(f"""with {COVER} select a.id as a, a.other as b from c a join c b on a.id = b.other and a.other = b.id
where a.id < a.other and a.share >= 0.9 and b.share >= 0.9""")
def same_routes(spark, d):
    """Lines that cover each other by 90%."""
    return op.same_lines(lines(spark, d), 60.5, 500.0)


@query(f"""with {COVER}, b as (select a.id, a.other, a.share, coalesce(b.share, 0) as back from c a left join c b on a.id = b.other and a.other = b.id),
r as (select *, case when id % 7 = other % 7 and greatest(share, back) >= 0.5 then 'a' when least(share, back) >= 0.8 then 'b' end as rule from b)
select id, other, rule, round(share, 9) as share, round(back, 9) as back from r where rule is not null""")
def route_entities(spark, d):
    """Lines that are one route, by name and half a line, or by the line alone."""
    out = op.entity_pairs(lines(spark, d), 60.5, 500.0, F.col("name") == F.col("other_name"), 0.5, 0.8)
    return out.select("id", "other", "rule", F.round("share", 9).alias("share"), F.round("back", 9).alias("back"))


#: Rides of one small district: 29 roads, each ridden again and again, a seventh of the rides one road.
DISTRICT = """select vec_id as id, k as n, vec_id * 7919 % 1009 as start, vec_id % 53 = 0 as anchor,
    (r * 113 % 900 + (600 + r * 41 % 500) * k / 6.0 + vec_id * (k + 3) * 37 % 31)::double as x,
    (r * 71 % 700 + (r % 5 + 1) * k * k * 9 + vec_id * (k + 5) * 53 % 29)::double as y
    from (select vec_id, case when vec_id % 7 = 0 then 0 else vec_id % 29 end as r from embeddings), range(7) q(k)"""


def district(spark, d):
    """``id, points, start, anchor``; rides of odd numbers run backwards."""
    i = F.col("vec_id")
    r = F.when(i % 7 == 0, 0).otherwise(i % 29)

    def point(k):
        x = r * 113 % 900 + (600 + r * 41 % 500) * k / 6.0 + i * (k + 3) * 37 % 31
        y = r * 71 % 700 + (r % 5 + 1) * k * k * 9 + i * (k + 5) * 53 % 29
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    points = F.transform(F.sequence(F.lit(0), F.lit(6)), point)
    points = F.when(i % 2 == 1, F.reverse(points)).otherwise(points)
    return table(spark, d, "embeddings").select(i.alias("id"), points.alias("points"), (i * 7919 % 1009).alias("start"), (i % 53 == 0).alias("anchor"))


@query(f"""
with recursive p as ({DISTRICT}),
s as materialized (select id, x as ax, y as ay, lead(x) over w as qx, lead(y) over w as qy, lag(x) over w as px, lag(y) over w as py from p window w as (partition by id order by n)),
l as (select *, coalesce(sqrt((qx - ax) ** 2 + (qy - ay) ** 2), 0) as ahead, coalesce(sqrt((px - ax) ** 2 + (py - ay) ** 2), 0) as behind from s),
o as (select id, row_number() over (order by not anchor, case when not anchor then start end, id) as r, anchor from (select distinct id, start, anchor from p)),
m as materialized (select id, r, anchor, sum(ahead) as len, min(ax) as west, max(ax) as east, min(ay) as south, max(ay) as north,
    sum((ax + qx) / 2 * ahead) / sum(ahead) as mx, sum((ay + qy) / 2 * ahead) / sum(ahead) as my from l join o using (id) group by 1, 2, 3),
e as materialized (select a.id as id, b.id as other, a.r as ra, b.r as rb, a.len from m a join m b on not a.anchor and b.r < a.r and abs(a.len - b.len) <= 0.1 * greatest(a.len, b.len)
    where greatest(abs(a.west - b.west), abs(a.east - b.east), abs(a.south - b.south), abs(a.north - b.north), sqrt((a.mx - b.mx) ** 2 + (a.my - b.my) ** 2))
        <= 0.1 * greatest(a.len, b.len) + 25),
b as (select id, other from e union all select other, id from e),
t as (select b.id, b.other, v.ax as x, v.ay as y, (v.ahead + v.behind) / 2 as w, u.*,
    greatest(0, least(1, ((v.ax - u.ax) * (u.qx - u.ax) + (v.ay - u.ay) * (u.qy - u.ay)) / ((u.qx - u.ax) ** 2 + (u.qy - u.ay) ** 2))) as c
    from b join l v on v.id = b.id join s u on u.id = b.other and u.qx is not null),
h as (select id, other, x, y, any_value(w) as w, min(sqrt((x - ax - c * (qx - ax)) ** 2 + (y - ay - c * (qy - ay)) ** 2)) as far from t group by 1, 2, 3, 4),
f as materialized (select id, other, sum(case when far > 25 then w else 0 end) <= 0.1 * sum(w) as ok from h group by 1, 2),
g as materialized (select ra, list(rb) as led from e join f a on a.id = e.id and a.other = e.other and a.ok join f c on c.id = e.other and c.other = e.id and c.ok group by 1),
k as materialized (select o.r, o.id, coalesce(led, []) as led from o left join g on ra = r),
z as (select 0::bigint as r, []::bigint[] as leaders, null::bigint as grp
    union all select k.r, case when list_has_any(led, leaders) then leaders else list_append(leaders, k.r) end,
        coalesce(list_min(list_intersect(led, leaders)), k.r) from z join k on k.r = z.r + 1)
select k.id, q.id as grp from z join k on k.r = z.r join k q on q.r = z.grp
""")
def ride_groups(spark, d):
    """Rides of one crowded district by the road they follow, in order of their start; some are given routes."""
    return groups.same_road(district(spark, d), 25.0)


#: One height for each time of a ride; unknown where any sample of that time is an error.
HEIGHTS = f"(select user_id, t, case when count(*) = count(height) then avg(height) end as height from ({SAMPLES}) group by 1, 2)"


def heights(spark, d):
    known = F.when(F.count("*") == F.count("height"), F.avg("height"))
    return samples(spark, d).groupBy("user_id", "t").agg(known.alias("height"))


@query(f"""
with n as (select *, ((height is null) is distinct from lag(height is null) over (partition by user_id order by t))::int as new from {HEIGHTS}),
r as (select *, sum(new) over (partition by user_id order by t) as run from n),
e as (select user_id, run, t as a, height as y, lead(t) over w as b, lead(height) over w as z, from r window w as (partition by user_id, run order by t)),
h as (select *, least(43200, t - min(t) over w, max(t) over w - t) as h from r window w as (partition by user_id, run)),
m as (select h.user_id, h.t, sum((least(b, t + h) - greatest(a, t - h)) * ((y + (z - y) * (greatest(a, t - h) - a) / (b - a)) + (y + (z - y) * (least(b, t + h) - a) / (b - a))) / 2) / (2 * any_value(h)) as mean
    from h join e on e.user_id = h.user_id and e.run = h.run and b > t - h and a < t + h where h > 0 and height is not null group by 1, 2)
select h.user_id, h.t::double as t, round(coalesce(mean, height), 6) as smooth from h left join m using (user_id, t)
""")
def smoothed_heights(spark, d):
    """Heights averaged over the way around each point, within runs of known heights."""
    out = op.smoothed(heights(spark, d), ["user_id"], "t", "height", 86_400.0)
    return out.select("user_id", "t", F.round("smooth", 6).alias("smooth"))


@query(None)
def spread_selection(spark, d):
    """Six samples of each ride, spread over the month."""
    return op.spread(samples(spark, d).withColumnRenamed("event_id", "id"), "user_id", "t", "value", F.lit(0), F.lit(2_592_000), 6)


@query(f"""
with recursive p as (select user_id, event_id, t / 3600.0 as km, case when event_type <> 'error' then event_type end as town,
    row_number() over (partition by user_id order by t, event_id) as n from ({SAMPLES})),
g as (select user_id, event_id, n, km, km as first, case when town is null then [] else [town] end as towns, 1 as stop from p where n = 1
    union all select p.user_id, p.event_id, p.n, p.km, case when j then first else p.km end,
        list_concat(case when j then towns else [] end, case when p.town is null then [] else [p.town] end), case when j then stop else stop + 1 end
    from (select g.*, p.event_id as e, (p.km - g.km <= 2.5 and p.km - first <= 6) or (p.km - g.km <= 6 and coalesce(list_contains(towns, p.town), false)) as j
        from g join p on p.user_id = g.user_id and p.n = g.n + 1) g join p on p.event_id = g.e)
select user_id, event_id, stop from g
""")
def chained_stops(spark, d):
    """Places to stop, chained by gaps, with a bound on their span unless the town is the same."""
    town = F.when(F.col("event_type") != "error", F.col("event_type"))
    rows = samples(spark, d).select("user_id", F.struct("t", "event_id").alias("at"), (F.col("t") / 3600.0).alias("km"), town.alias("town"))
    s = series.gathered(rows, ["user_id"], "at", ["km", "town"])
    stops = op.chained(F.transform("series", lambda x: F.struct(x["km"].alias("km"), x["town"].alias("town"))), 2.5, 6.0, 6.0)
    ids = F.transform("series", lambda x: x["at"]["event_id"])
    return s.select("user_id", F.explode(F.arrays_zip(ids.alias("event_id"), stops.alias("stop"))).alias("z")).select("user_id", "z.event_id", "z.stop")


@query("""
with recursive r as (select o_custkey, o_orderkey, epoch_us(o_orderdate) // 86400000000 as day, (o_orderkey * 7919 % 8000)::double as x0, (o_orderkey * 31 % 6000)::double as y0,
    (o_orderkey * 104729 % 8000)::double as x1, (o_orderkey * 37 % 6000)::double as y1, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n from orders),
c as (select *, x0 as hx, y0 as hy, 1 as chain from r where n = 1
    union all select * exclude (hx, hy, j, chain), case when j then hx else x0 end, case when j then hy else y0 end, case when j then chain else chain + 1 end
    from (select r.*, c.hx, c.hy, c.chain, r.day - c.day between 0 and 300 and sqrt((r.x0 - c.x1) ** 2 + (r.y0 - c.y1) ** 2) <= 5000
        and (r.day = c.day or sqrt((c.x1 - c.hx) ** 2 + (c.y1 - c.hy) ** 2) > 2000) as j from c join r on r.o_custkey = c.o_custkey and r.n = c.n + 1)),
w as (select *, lead(day) over (partition by o_custkey, chain order by n) > day as night from c),
f as (select *, arg_min(x1, n) filter (night) over (partition by o_custkey, chain) as nx, arg_min(y1, n) filter (night) over (partition by o_custkey, chain) as ny from w)
select o_custkey, chain, count(*) as rides, (max(day) - min(day) + 1)::bigint as days,
    coalesce(max(day) - min(day) + 1 > 2 and max(sqrt((x1 - nx) ** 2 + (y1 - ny) ** 2)) filter (night) <= 3000, false) as base
from f group by 1, 2 having max(day) > min(day)
""")
def trips(spark, d):
    """Rides chained into trips of over a day; ``base`` if all nights lie near the first."""
    o, place = F.col("o_orderkey"), lambda k, m: (F.col("o_orderkey") * k % m).cast("double")
    rows = table(spark, d, "orders").select(
        "o_custkey", F.struct("o_orderdate", "o_orderkey").alias("at"),
        F.expr("cast(unix_micros(cast(o_orderdate as timestamp)) div 86400000000 as int)").alias("day"), o.alias("id"),
        place(7919, 8000).alias("x0"), place(31, 6000).alias("y0"), place(104729, 8000).alias("x1"), place(37, 6000).alias("y1"),
    )
    s = series.gathered(rows, ["o_custkey"], "at", ["day", "x0", "y0", "x1", "y1"])
    zipped = F.zip_with("series", op.trip_chains(F.col("series"), 300, 5000.0, 2000.0), lambda r, c: F.struct(r["day"].alias("day"), r["x1"].alias("x"), r["y1"].alias("y"), c.alias("chain")))
    c = s.select("o_custkey", F.posexplode(zipped).alias("n", "r")).select("o_custkey", "n", "r.*")
    w = Window.partitionBy("o_custkey", "chain")
    c = c.withColumn("night", F.coalesce(F.lead("day").over(w.orderBy("n")) > F.col("day"), F.lit(False)))
    first = F.min_by(F.when(F.col("night"), F.struct("x", "y")), F.when(F.col("night"), F.col("n"))).over(w)
    c = c.withColumn("far", F.when(F.col("night"), F.hypot(F.col("x") - first["x"], F.col("y") - first["y"])))
    days = F.max("day") - F.min("day") + 1
    out = c.groupBy("o_custkey", "chain").agg(F.count("*").alias("rides"), days.cast("long").alias("days"), F.coalesce((days > 2) & (F.max("far") <= 3000), F.lit(False)).alias("base"))
    return out.where("days > 1")


@query(None)
def even_nights(spark, d):
    """Four nights of each ride, each at the stop nearest an even share of what is left."""
    s = samples(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_set((F.col("t") / 3600.0).cast("double"))).alias("stops"))
    return s.select("user_id", F.posexplode(op.even_nights(F.col("stops"), F.lit(720.0), 4)).alias("night", "at"))


@query(f"""
with s as (select user_id, value, row_number() over (partition by user_id order by t, event_id) as n from ({SAMPLES})),
a as (select distinct user_id, unnest([50.0, 150, 250, 350, 600])::double as place from s)
select a.user_id, place, min(n)::int as n from a left join s on s.user_id = a.user_id and value >= place group by 1, 2
""")
def first_reached(spark, d):
    """The first sample of each ride that reaches a value."""
    s = samples(spark, d).select("user_id", "value", F.row_number().over(series.in_order(["user_id"], ["t", "event_id"])).alias("n"))
    asked = s.select("user_id").distinct().select("user_id", F.explode(F.array(*(F.lit(float(v)) for v in (50, 150, 250, 350, 600)))).alias("place"))
    return op.first_reached(s, asked, ["user_id"], "n", "value", "place")


@query(f"""
with r as (select user_id, t as a, t + 3000 as b from ({SAMPLES})),
s as (select *, max(b) over (partition by user_id order by a, b rows between unbounded preceding and 1 preceding) as reach from r),
i as (select *, sum((reach is null or a > reach)::int) over (partition by user_id order by a, b) as n from s),
m as (select user_id, min(a) as a, max(b) as b from i group by user_id, n),
q as (select distinct user_id, t // 7200 * 7200 as t from ({SAMPLES}))
select q.user_id, q.t, a, b from q left join m on m.user_id = q.user_id and q.t between a and b
""")
def active_ranges(spark, d):
    """The range that holds each asked place, of ranges that do not overlap."""
    s = samples(spark, d)
    ranges = series.merged_ranges(s.select("user_id", F.col("t").alias("a"), (F.col("t") + 3000).alias("b")), ["user_id"], "a", "b")
    asked = s.select("user_id", F.expr("t div 7200 * 7200").alias("t")).distinct()
    return op.active(ranges, asked, ["user_id"], "a", "b", "t")


@query(f"""
with c as (select user_id, t // 21600 as c, avg(height) as m from ({SAMPLES}) group by 1, 2 having m is not null),
n as (select *, lead(c) over w as nc, lead(m) over w as nm from c window w as (partition by user_id order by c)),
e as (select *, unnest(range(c, case when nc - c <= 4 then nc else c + 1 end)) as x from n)
select user_id, x as column, round(case when x = c then m else m + (nm - m) * (x - c) / (nc - c) end, 6) as mean, x <> c as filled from e
""")
def filled_columns(spark, d):
    out = op.filled_columns(samples(spark, d), ["user_id"], "t", "height", 21_600, 4)
    return out.select("user_id", "column", F.round("mean", 6).alias("mean"), "filled")


@query("""
select l_orderkey, l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F') as held from lineitem
""")
def run_membership(spark, d):
    """Whether ids lie in the runs of a table of ids."""
    ids = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return op.in_runs(ids, table(spark, d, "lineitem").select("l_orderkey"), "l_orderkey")


@query(f"""
with p as (select user_id, t, avg(value) as x, avg(event_id % 100) as y from ({SAMPLES}) group by 1, 2),
f as (select user_id, t, first(x) over w as x0, first(y) over w as y0, last(x) over w as x1, last(y) over w as y1 from p
    window w as (partition by user_id order by t range between 20000 preceding and 20000 following))
select user_id, t, case when x0 <> x1 or y0 <> y1 then round((degrees(atan2(x1 - x0, y1 - y0)) + 360) % 360, 6) end as bearing from f
""")
def stretch_bearings(spark, d):
    """Direction of the stretch around each point; null where it ends where it began."""
    p = samples(spark, d).groupBy("user_id", "t").agg(F.avg("value").alias("x"), F.avg(F.col("event_id") % 100).alias("y"))
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-20_000, 20_000)
    dx, dy = F.last("x").over(w) - F.first("x").over(w), F.last("y").over(w) - F.first("y").over(w)
    turn = F.round((F.degrees(F.atan2(dx, dy)) + 360) % 360, 6)
    return p.select("user_id", "t", F.when((dx != 0) | (dy != 0), turn).alias("bearing"))


@query(f"""
with s as (select user_id, (t - lag(t) over w)::double as step, coalesce(height - lag(height) over w, 0) as rise from ({SAMPLES}) window w as (partition by user_id order by t, event_id)),
g as (select *, greatest(-0.5, least(0.5, rise / step)) as slope from s where step > 0)
select user_id, round(sum(step * exp(3.5 * abs(slope + 0.05))) / 1000, 3) as forward, round(sum(step * exp(3.5 * abs(0.05 - slope))) / 1000, 3) as backward from g group by 1
""")
def both_directions(spark, d):
    """Time of a profile in either direction, by a walking pace that falls off with the slope."""
    w = series.in_order(["user_id"], ["t", "event_id"])
    rise = F.coalesce(F.col("height") - F.lag("height").over(w), F.lit(0.0))
    s = samples(spark, d).select("user_id", (F.col("t") - F.lag("t").over(w)).cast("double").alias("step"), rise.alias("rise")).where("step > 0")
    slope = F.greatest(F.lit(-0.5), F.least(F.lit(0.5), F.col("rise") / F.col("step")))
    time = lambda g: F.round(F.sum(F.col("step") * F.exp(3.5 * F.abs(g + 0.05))) / 1000, 3)
    return s.withColumn("slope", slope).groupBy("user_id").agg(time(F.col("slope")).alias("forward"), time(-F.col("slope")).alias("backward"))


@query("""
select event_type, week(ts)::int as week, min(value) as low, max(value) as high, round(sum(value * (event_id % 5 + 1)) / sum(event_id % 5 + 1), 6) as mean
from events group by 1, 2
""")
def weekly_rows(spark, d):
    """Extremes and weighted mean of each week of the year."""
    e = table(spark, d, "events").withColumn("w", F.col("event_id") % 5 + 1)
    return e.groupBy("event_type", F.weekofyear("ts").alias("week")).agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.round(series.weighted("value", "w"), 6).alias("mean")
    )


@query(f"""
with recursive e as materialized (select id, node from (select id, unnest([src, dst]) as node from {ROADS})),
m as (select min(id) as a, max(id) as b from e group by node having count(*) = 2 and min(id) <> max(id)),
n as materialized (select a, b from m union select b, a from m),
r(id, chain) using key (id) as (select id, id from {ROADS}
    union select n.b, min(r.chain) from r join n on n.a = r.id join recurring.r as k on k.id = n.b where r.chain < k.chain group by 1)
select id, chain from r
""")
def line_chains(spark, d):
    """Roads joined to chains at nodes where just two meet."""
    return graph.chains(roads(spark, d).withColumn("kind", F.lit(1)), "kind")
