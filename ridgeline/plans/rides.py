"""Time series queries. Events of a user stand in for the samples of a ride: ``ts`` is the
time, ``value`` the measured channel, the event type a surface or zone, and an error a pause."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query, table
from ..operators import series as op

#: Samples: seconds since the start of 2024 (whole), place in the series, and the channel.
SAMPLES = """select user_id, event_id, epoch_us(ts) // 1000000 - 1704067200 as t, event_type, value,
    case when event_type = 'error' then null else value end as height from events"""


def samples(spark, d):
    e = table(spark, d, "events")
    t = F.expr("unix_micros(cast(ts as timestamp)) div 1000000 - 1704067200")
    height = F.when(F.col("event_type") != "error", F.col("value"))
    return e.select("user_id", "event_id", t.alias("t"), "event_type", "value", height.alias("height"))


@query(f"""
select user_id, event_id, coalesce(t - lag(t) over w, 0) as step, round(coalesce(abs(value - lag(value) over w), 0), 6) as move,
    round(sum(value) over (partition by user_id order by t, event_id rows unbounded preceding), 4) as total
from ({SAMPLES}) window w as (partition by user_id order by t, event_id)
""")
def steps_and_totals(spark, d):
    """Step from the sample before, and the running total."""
    w = op.in_order(["user_id"], ["t", "event_id"])
    return samples(spark, d).select(
        "user_id", "event_id",
        F.coalesce(F.col("t") - F.lag("t").over(w), F.lit(0)).alias("step"),
        F.round(F.coalesce(F.abs(F.col("value") - F.lag("value").over(w)), F.lit(0.0)), 6).alias("move"),
        F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("total"),
    )


@query(f"""
with s as (select *, t - lag(t) over (partition by user_id order by t, event_id) as step from ({SAMPLES}))
select user_id, coalesce(sum(case when value >= 20 and event_type <> 'error' then step end), 0)::bigint as moving,
    coalesce(sum(step), 0)::bigint as elapsed, max(value) as most, round(sum(value * step) / nullif(sum(step), 0), 6) as mean
from s group by 1
""")
def ride_totals(spark, d):
    """Moving and elapsed time, greatest value and mean by time, of each ride."""
    w = op.in_order(["user_id"], ["t", "event_id"])
    s = samples(spark, d).withColumn("step", F.col("t") - F.lag("t").over(w))
    moving = F.when((F.col("value") >= 20) & (F.col("event_type") != "error"), F.col("step"))
    return s.groupBy("user_id").agg(
        F.coalesce(F.sum(moving), F.lit(0)).alias("moving"),
        F.coalesce(F.sum("step"), F.lit(0)).alias("elapsed"),
        F.max("value").alias("most"),
        F.round(op.weighted("value", "step"), 6).alias("mean"),
    )


@query(f"""
with s as (select *, t - lag(t) over (partition by user_id order by t, event_id) as step from ({SAMPLES}))
select user_id, (case when value < 20 then 0 when value < 50 then 1 when value < 100 then 2 else 3 end) as zone,
    sum(step)::bigint as seconds from s where step is not null group by 1, 2
""")
def zone_seconds(spark, d):
    w = op.in_order(["user_id"], ["t", "event_id"])
    s = samples(spark, d).withColumn("step", F.col("t") - F.lag("t").over(w)).where("step is not null")
    zone = F.when(F.col("value") < 20, 0).when(F.col("value") < 50, 1).when(F.col("value") < 100, 2).otherwise(3)
    return s.groupBy("user_id", zone.alias("zone")).agg(F.sum("step").alias("seconds"))


@query(f"""
select user_id, event_id, case when height is not null then round(avg(height) over (
    partition by user_id order by t range between 43200 preceding and 43200 following), 6) end as smooth from ({SAMPLES})
""")
def moving_mean(spark, d):
    s = op.moving_mean(samples(spark, d), ["user_id"], "t", "height", 43_200, "smooth")
    return s.select("user_id", "event_id", F.round("smooth", 6).alias("smooth"))


@query("""
with h as (select event_type, hour(ts) as h, sum(value) as v from events group by 1, 2),
n as (select event_type, (h + o + 24) % 24 as h, v from h, range(-2, 3) r(o))
select event_type, h::int as hour, round(avg(v), 4) as mean from n group by 1, 2
""")
def circular_mean(spark, d):
    """Mean of each hour with two on either side, past midnight."""
    h = table(spark, d, "events").groupBy("event_type", F.hour("ts").alias("hour")).agg(F.sum("value").alias("v"))
    out = op.circular_mean(h, ["event_type"], "hour", "v", 24, 2)
    return out.select("event_type", "hour", F.round("mean", 4).alias("mean"))


@query(f"""
with s as (select *, coalesce((t - lag(t) over (partition by user_id order by t) > 14400)::int, 0) as new from ({SAMPLES})),
n as (select *, sum(new) over (partition by user_id order by t) as session from s)
select user_id, session::bigint as session, min(t) as first, max(t) as last, count(*) as rows from n group by 1, 2
""")
def session_stops(spark, d):
    """Sessions that a pause of over four hours separates."""
    s = op.sessions(samples(spark, d), ["user_id"], "t", 14_400)
    return s.groupBy("user_id", "session").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("rows"))


@query(f"""
with s as (select *, lag(event_type) over (partition by user_id order by t, event_id) as p from ({SAMPLES})),
n as (select *, sum((p is distinct from event_type)::int) over (partition by user_id order by t, event_id) as run from s)
select user_id, run::bigint as run, any_value(event_type) as event_type, min(t) as first, max(t) as last, count(*) as rows from n group by 1, 2
""")
def run_lengths(spark, d):
    return op.run_lengths(samples(spark, d), ["user_id"], ["t", "event_id"], "event_type")


@query(f"""
select * from (select user_id, event_id, t, t - lag(t) over (partition by user_id order by t) as gap from ({SAMPLES})) where gap > 36000
""")
def time_gaps(spark, d):
    return op.gaps(samples(spark, d).select("user_id", "event_id", "t"), ["user_id"], "t", 36_000, ("event_id",))


@query(f"""
with m as (select user_id, t from ({SAMPLES}) where event_type = 'purchase' union all
    select distinct user_id, unnest([0, 2592000]) from ({SAMPLES}) where event_type = 'purchase'),
p as (select user_id, t as "from", lead(t) over (partition by user_id order by t) as "to" from m),
r as (select *, "to" - "from" as length, row_number() over (partition by user_id order by "to" - "from" desc, "from") as rank from p where "to" - "from" >= 86400)
select * from r where rank <= 20
""")
def between_events(spark, d):
    """The longest stretches of a month without a purchase, of a day or more; at most 20."""
    s = samples(spark, d).where("event_type = 'purchase'")
    lo, hi = F.lit(0).cast("long"), F.lit(2_592_000).cast("long")
    return op.between_events(s, ["user_id"], "t", lo, hi, 86_400, 20).withColumnRenamed("at", "from")


@query(f"""
with s as (select user_id, t::double as t, sum(value) as v from ({SAMPLES}) group by 1, 2),
q as (select distinct user_id, (n * 86400)::double as day from s, range(31) r(n)),
a as (select q.user_id, q.day, max(s.t) filter (s.t <= q.day) as ta, min(s.t) filter (s.t >= q.day) as tb from q join s on s.user_id = q.user_id group by 1, 2)
select a.user_id, a.day, round(case when ta is null or tb is null then null when tb > ta then x.v + (y.v - x.v) * (a.day - ta) / (tb - ta) else x.v end, 4) as v
from a left join s x on x.user_id = a.user_id and x.t = ta left join s y on y.user_id = a.user_id and y.t = tb
""")
def at_measure(spark, d):
    """The channel at each midnight, linear between samples."""
    s = samples(spark, d).groupBy("user_id", F.col("t").cast("double").alias("t")).agg(F.sum("value").alias("v"))
    days = s.select("user_id").distinct().withColumn("day", F.explode(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda n: n * F.lit(86400.0))))
    out = op.at_measure(s, days, ["user_id"], "t", "day", ["v"])
    return out.select("user_id", "day", F.round("v", 4).alias("v"))


@query(f"""
with r as (select user_id, min(t) as a, max(t) as b from ({SAMPLES}) group by 1)
select user_id, unnest(list_distinct(list_append(list_transform(range(0, (b - a) // 86400 + 1), lambda i: a + i * 86400), b)))::double as place from r
""")
def steps_every(spark, d):
    s = samples(spark, d).select("user_id", F.col("t").cast("double").alias("t"))
    return op.steps_every(s, ["user_id"], "t", 86_400.0, "place")


@query("""
with recursive s as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as n from events where event_type <> 'error'),
f as (select user_id, n, value as ref, 0.0::double as up, 0.0::double as down from s where n = 1
    union all select s.user_id, s.n, case when abs(value - ref) >= 30 then value else ref end,
        up + case when value - ref >= 30 then value - ref else 0 end, down + case when ref - value >= 30 then ref - value else 0 end
    from f join s on s.user_id = f.user_id and s.n = f.n + 1)
select user_id, round(up, 4) as up, round(down, 4) as down from (select *, row_number() over (partition by user_id order by n desc) as r from f) where r = 1
""")
def dead_band(spark, d):
    """Ascent and descent; a change counts once it reaches 30."""
    e = table(spark, d, "events").where("event_type <> 'error'").select("user_id", F.struct("ts", "event_id").alias("at"), "value")
    s = op.gathered(e, ["user_id"], "at", ["value"])
    band = op.dead_band(F.transform("series", lambda x: x["value"]), 30.0)
    return s.select("user_id", band.alias("b")).select("user_id", F.round("b.up", 4).alias("up"), F.round("b.down", 4).alias("down"))


@query(f"""
select user_id, least(t // 40500, 63)::int as bucket, min(value) as least, max(value) as most, round(avg(value), 6) as mean
from ({SAMPLES}) where t between 0 and 2592000 group by 1, 2
""")
def profile_buckets(spark, d):
    out = op.buckets(samples(spark, d), ["user_id"], "t", "value", 0, 2_592_000, 64)
    return out.select("user_id", "bucket", "least", "most", F.round("mean", 6).alias("mean"))


@query(f"""
with s as (select *, lead(t) over (partition by user_id order by t, event_id) as n from ({SAMPLES}))
select user_id, event_type, sum(least(n, 1296000) - greatest(t, 432000))::bigint as seconds from s where n > 432000 and t < 1296000 group by 1, 2
""")
def interval_facts(spark, d):
    """Time by surface within one range of the route."""
    s = samples(spark, d).withColumn("n", F.lead("t").over(op.in_order(["user_id"], ["t", "event_id"])))
    inside = s.where("n > 432000 and t < 1296000")
    length = F.least("n", F.lit(1_296_000)) - F.greatest("t", F.lit(432_000))
    return inside.groupBy("user_id", "event_type").agg(F.sum(length).alias("seconds"))


@query(f"""
with r as (select user_id, t as a, t + 7200 as b from ({SAMPLES})),
s as (select *, max(b) over (partition by user_id order by a, b rows between unbounded preceding and 1 preceding) as reach from r),
i as (select *, sum((reach is null or a > reach)::int) over (partition by user_id order by a, b) as n from s)
select user_id, min(a) as a, max(b) as b from i group by user_id, n
""")
def merged_ranges(spark, d):
    r = samples(spark, d).select("user_id", F.col("t").alias("a"), (F.col("t") + 7200).alias("b"))
    return op.merged_ranges(r, ["user_id"], "a", "b")


@query(f"""
with s as (select *, coalesce(value - lag(value) over (partition by user_id order by t, event_id), 0) as m from ({SAMPLES})),
k as (select user_id, event_id, t, unnest([case when m >= 20 then 'climb' end, case when m <= -20 then 'descent' end,
    case when abs(m) >= 80 then 'steep' end, case when event_type = 'error' then 'closure' end]) as kind from s),
n as (select user_id, event_id, row_number() over (partition by user_id order by t, event_id) as n from s),
i as (select kind, k.user_id, n, n - row_number() over (partition by kind, k.user_id order by n) as island from k join n using (event_id) where kind is not null)
select kind, user_id, min(n) as first, max(n) as last from i group by kind, user_id, island
""")
def route_segments(spark, d):
    """Runs of samples that satisfy a predicate, for several predicates at once."""
    w = op.in_order(["user_id"], ["t", "event_id"])
    s = samples(spark, d).select(
        "user_id", "event_type",
        F.row_number().over(w).alias("n"),
        F.coalesce(F.col("value") - F.lag("value").over(w), F.lit(0.0)).alias("m"),
    )
    tests = {"climb": F.col("m") >= 20, "descent": F.col("m") <= -20, "steep": F.abs("m") >= 80, "closure": F.col("event_type") == "error"}
    kinds = s.select("user_id", "n", F.explode(F.array(*(F.when(c, k) for k, c in tests.items()))).alias("kind")).where("kind is not null")
    island = F.col("n") - F.row_number().over(Window.partitionBy("kind", "user_id").orderBy("n"))
    return kinds.withColumn("island", island).groupBy("kind", "user_id", "island").agg(F.min("n").alias("first"), F.max("n").alias("last")).drop("island")


@query("""
select user_id, make_timestamp(epoch_us(ts) // 3600000000 * 3600000000) as bucket, round(avg(value), 6) as mean, count(*) as n from events group by 1, 2
""")
def tumbling_buckets(spark, d):
    """Mean of each hour-long bucket that has samples."""
    e = table(spark, d, "events").withColumn("hour", F.window(F.col("ts"), "1 hour")["start"])
    return e.groupBy("user_id", F.col("hour").alias("bucket")).agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


@query("""
with s as (select user_id, epoch_us(ts) // 60000000 as minute, (list(value order by ts desc, event_id desc))[1] as v from events group by 1, 2)
select user_id, minute, round(avg(v) over (partition by user_id order by minute range between 1439 preceding and current row), 6) as mean from s
""")
def last_per_minute_mean(spark, d):
    """The last value of each minute, averaged over the day that ends there."""
    minute = F.expr("unix_micros(cast(ts as timestamp)) div 60000000")
    s = table(spark, d, "events").groupBy("user_id", minute.alias("minute")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    w = Window.partitionBy("user_id").orderBy("minute").rangeBetween(-1439, 0)
    return s.select("user_id", "minute", F.round(F.avg("v").over(w), 6).alias("mean"))


@query("""
with recursive s as (select user_id, event_id, value, row_number() over (partition by user_id order by ts, event_id) as n from events),
f as (select user_id, event_id, n, case when value >= 100 then 3 when value >= 50 then 2 when value >= 20 then 1 else 0 end as zone from s where n = 1
    union all select s.user_id, s.event_id, s.n, case
        when value >= [-1e300, 20, 50, 100][zone + 1] - 5 and value < [20, 50, 100, 1e300][zone + 1] + 5 then zone
        when value >= 100 then 3 when value >= 50 then 2 when value >= 20 then 1 else 0 end
    from f join s on s.user_id = f.user_id and s.n = f.n + 1)
select user_id, event_id, zone from f
""")
def hysteresis_zones(spark, d):
    """Zones that are left only past their border by 5."""
    e = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "value")
    s = op.gathered(e, ["user_id"], "at", ["value"])
    zones = op.hysteresis_zone(F.transform("series", lambda x: x["value"]), [20, 50, 100], 5)
    z = s.select("user_id", F.explode(F.arrays_zip(F.transform("series", lambda x: x["at"]["event_id"]).alias("event_id"), zones.alias("zone"))).alias("z"))
    return z.select("user_id", "z.event_id", "z.zone")


@query(None)
def climb_segments(spark, d):
    """Climbs of a synthetic profile: running sums of the centred channel against time."""
    w = op.in_order(["user_id"], ["t", "event_id"])
    s = samples(spark, d).withColumn("e", F.sum(F.col("value") - 50).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    p = op.gathered(s.select("user_id", F.struct((F.col("t") / 100.0).alias("d"), "event_id").alias("at"), "e"), ["user_id"], "at", ["e"])
    found = op.climbs(F.transform("series", lambda x: F.struct(x["at"]["d"].alias("d"), x["e"].alias("e"))))
    return p.select("user_id", F.explode(found).alias("c")).select("user_id", "c.start", "c.end", F.round("c.gain", 4).alias("gain"))


@query(f"""
with s as (select *, row_number() over (partition by user_id order by t, event_id) - 1 as n from ({SAMPLES})),
y as (select user_id, event_type, n // 10 as place, avg(value) as v from s where event_type <> 'error' group by 1, 2, 3)
select user_id, place::bigint as place, round(sum(v * w) / sum(w), 9) as mean from (
    select *, case event_type when 'click' then 1 when 'view' then 2 else 3 end as w from y) group by 1, 2
""")
def distance_weighted_mean(spark, d):
    """Mean of each cell's values by the distance spent on them."""
    s = samples(spark, d).withColumn("place", F.expr("(row_number() over (partition by user_id order by t, event_id) - 1) div 10"))
    y = s.where("event_type <> 'error'").groupBy("user_id", "event_type", "place").agg(F.avg("value").alias("v"))
    w = F.when(F.col("event_type") == "click", 1.0).when(F.col("event_type") == "view", 2.0).otherwise(3.0)
    return y.withColumn("w", w).groupBy("user_id", "place").agg(F.round(op.weighted("v", "w"), 9).alias("mean"))


@query("""
with b as (select user_id, count(*) as n, count(*) filter (value >= 50) as paved, count(*) filter (event_type <> 'error') as known,
    count(*) filter (event_type = 'view') as canopy from events group by 1)
select user_id, round(paved / n, 6) as paved, case when known >= 0.8 * n then round(canopy / known, 6) end as canopy from b
""")
def share_counters(spark, d):
    """Shares of samples; one that needs enough known samples is null without them."""
    n, known = F.count("*"), F.count_if(F.col("event_type") != "error")
    return table(spark, d, "events").groupBy("user_id").agg(
        F.round(F.count_if(F.col("value") >= 50) / n, 6).alias("paved"),
        F.when(known >= 0.8 * n, F.round(F.count_if(F.col("event_type") == "view") / known, 6)).alias("canopy"),
    )


@query("""
with k as (select event_type, day(ts) as day, user_id % 10 as season, bool_or(value > 120) as snow from events group by 1, 2, 3),
q as (select event_type, day, 4 * count(*) filter (snow) >= count(*) as covered from k group by 1, 2 having count(*) >= 5),
f as (select event_type, day from q where not covered),
twice as (select event_type, day as x from f union all select event_type, day + 31 from f),
i as (select event_type, x, x - row_number() over (partition by event_type order by x) as island from twice),
l as (select event_type, least(count(*), 31) as n from i group by event_type, island)
select event_type, max(n)::bigint as longest_free from l group by 1
""")
def season_free_run(spark, d):
    """Days that a quarter of the seasons cover, and the longest run without, past the year's end."""
    k = table(spark, d, "events").groupBy("event_type", F.dayofmonth("ts").alias("day"), (F.col("user_id") % 10).alias("season"))
    k = k.agg(F.bool_or(F.col("value") > 120).alias("snow")).groupBy("event_type", "day")
    q = k.agg((4 * F.count_if("snow") >= F.count("*")).alias("covered"), F.count("*").alias("seasons"))
    free = q.where("seasons >= 5 and not covered")
    twice = free.select("event_type", F.explode(F.array(F.col("day"), F.col("day") + 31)).alias("x"))
    island = F.col("x") - F.row_number().over(Window.partitionBy("event_type").orderBy("x"))
    runs = twice.withColumn("island", island).groupBy("event_type", "island")
    return runs.agg(F.least(F.count("*"), F.lit(31)).alias("n")).groupBy("event_type").agg(F.max("n").alias("longest_free"))


@query(f"""
with s as (select *, t - lag(t) over (partition by user_id order by t, event_id) as gap, lag(event_type) over (partition by user_id order by t, event_id) as p from ({SAMPLES}))
select coalesce(p, 'start') as bucket, coalesce(sum(least(gap, 3600)), 0)::bigint as seconds, count(*) as n from s group by 1
""")
def time_attribution(spark, d):
    """The gap before an event is charged to what went on since the one before, up to an hour."""
    w = op.in_order(["user_id"], ["t", "event_id"])
    s = samples(spark, d).select((F.col("t") - F.lag("t").over(w)).alias("gap"), F.lag("event_type").over(w).alias("p"))
    return s.groupBy(F.coalesce("p", F.lit("start")).alias("bucket")).agg(
        F.coalesce(F.sum(F.least("gap", F.lit(3600))), F.lit(0)).alias("seconds"), F.count("*").alias("n")
    )
