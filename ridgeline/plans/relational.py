"""Relational queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query, table
from ..operators import tables as op


@query("""
select c_custkey, c_name, n_name, r_name, coalesce(s.best, c_name) as label, coalesce(s.n, 0) as suppliers
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
left join (select s_nationkey, min(s_name) as best, count(*) as n from supplier group by 1) s on s.s_nationkey = c_nationkey
""")
def places_view(spark, d):
    """Records joined to their contexts, and to content where there is some."""
    context = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    content = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.min("s_name").alias("best"), F.count("*").alias("n"))
    rows = table(spark, d, "customer").join(context, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.join(content, F.col("s_nationkey") == F.col("c_nationkey"), "left")
    return rows.select(
        "c_custkey", "c_name", "n_name", "r_name", F.coalesce("best", "c_name").alias("label"), F.coalesce("n", F.lit(0)).alias("suppliers")
    )


@query("""
with box as (select distinct l_orderkey from lineitem where l_quantity >= 49),
ids as (select o_orderkey from orders where o_totalprice < 2000 union select l_orderkey from box)
select l_orderkey, count(*) as lines, round(sum(l_extendedprice), 2) as price from lineitem
where l_orderkey in (select o_orderkey from ids) group by 1
""")
def shard_selection(spark, d):
    """Ids in a box and ids of their dependents, then the rows of both (left semi)."""
    lines = table(spark, d, "lineitem")
    ids = table(spark, d, "orders").where("o_totalprice < 2000").select("o_orderkey")
    ids = ids.union(lines.where("l_quantity >= 49").select("l_orderkey"))
    held = lines.join(ids, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return held.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def missing_facts(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey")
    return table(spark, d, "customer").join(done, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""
select o_orderkey, coalesce(a.q, b.q) as quantity from orders
left join (select l_orderkey, sum(l_quantity) as q from lineitem where l_returnflag = 'R' group by 1) a on a.l_orderkey = o_orderkey
left join (select l_orderkey, max(l_quantity) as q from lineitem group by 1) b on b.l_orderkey = o_orderkey
""")
def preferred_fact(spark, d):
    """An earlier fact where there is one, else the current one; one shuffle of the lines."""
    early = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")))
    facts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.coalesce(early, F.max("l_quantity")).alias("quantity"))
    orders = table(spark, d, "orders").select("o_orderkey")
    return orders.join(facts, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", "quantity")


@query("""
with fresh as (select p_partkey, p_name, max(l_extendedprice) as price from lineitem join part on l_partkey = p_partkey
    where l_returnflag = 'A' group by 1, 2)
select p_partkey, p_name, p_retailprice as price from part where p_partkey not in (select p_partkey from fresh)
union all select * from fresh
""")
def curated_upsert(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", F.col("p_retailprice").alias("price"))
    lines = table(spark, d, "lineitem").where("l_returnflag = 'A'").groupBy("l_partkey")
    seen = lines.agg(F.max("l_extendedprice").alias("price"))
    fresh = part.drop("price").join(seen, F.col("p_partkey") == F.col("l_partkey")).drop("l_partkey")
    return op.upsert(part, fresh, "p_partkey")


@query("""
select s.event_type, s.nth, e.event_id,
    greatest(epoch_us(e.ts), s.lo) as from_us, least(epoch_us(e.ts) + 600000000, s.hi) as to_us
from events e join (
    select event_type, n as nth, 1704067200000000 + n * 86400000000 as lo, 1704067200000000 + n * 86400000000 + 3600000000 as hi
    from (select distinct event_type from events), range(30) t(n)
) s on s.event_type = e.event_type and epoch_us(e.ts) < s.hi and epoch_us(e.ts) + 600000000 > s.lo
""")
def interval_overlap(spark, d):
    """Ten-minute stretches clipped to the ranges that they overlap.

    A range is filed under each day that it touches, so the join has an equal key.
    """
    day, hour = 86_400_000_000, 3_600_000_000
    e = table(spark, d, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("a"))
    e = e.withColumn("b", F.col("a") + 600_000_000)
    e = e.withColumn("day", F.explode(F.sequence(F.expr(f"a div {day}"), F.expr(f"b div {day}"))))
    kinds = e.select("event_type").distinct()
    s = kinds.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))))
    s = s.withColumn("lo", 1_704_067_200_000_000 + F.col("nth") * day).withColumn("hi", F.col("lo") + hour)
    s = s.withColumn("day", F.expr(f"lo div {day}"))
    met = e.join(s, ["event_type", "day"]).where("a < hi and b > lo")
    return met.select("event_type", "nth", "event_id", F.greatest("a", "lo").alias("from_us"), F.least("b", "hi").alias("to_us"))


@query("select event_type, count(*) as n from events group by 1")
def group_count(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""
select o_orderpriority, count(distinct case when o_orderstatus = 'F' then o_custkey end) as done,
    count(distinct o_custkey) as customers, sum(case when o_totalprice > 300000 then 1 else 0 end) as large
from orders group by 1
""")
def conditional_distinct(spark, d):
    """Distinct customers by condition, as two sums over one combine by customer."""
    by = table(spark, d, "orders").groupBy("o_orderpriority", "o_custkey").agg(
        F.max((F.col("o_orderstatus") == "F").cast("int")).alias("done"), F.sum((F.col("o_totalprice") > 300000).cast("int")).alias("large")
    )
    done, known = F.when(F.col("o_custkey").isNotNull(), F.col("done")), F.count("o_custkey")
    return by.groupBy("o_orderpriority").agg(F.sum(done).alias("done"), known.alias("customers"), F.sum("large").alias("large"))


@query("""
with low as (select date_trunc('week', ts)::date as period, user_id, event_type, count(*) as calls from events group by all)
select period, event_type, sum(calls)::bigint as calls, count(*) as groups, sum((calls >= 3)::int)::bigint as busy from low group by 1, 2
""")
def two_level_by_week(spark, d):
    rows = table(spark, d, "events").select(F.date_trunc("week", "ts").cast("date").alias("period"), "user_id", "event_type", F.lit(1).alias("one"))
    return op.two_level(rows, ["period", "user_id", "event_type"], ["period", "event_type"], "one", 3)


@query("""
select event_type, count(*) filter (ts >= timestamp '2024-01-23' and ts < timestamp '2024-01-30') as now_n,
    count(*) filter (ts >= timestamp '2024-01-16' and ts < timestamp '2024-01-23') as before_n,
    round(coalesce(sum(value) filter (ts >= timestamp '2024-01-23' and ts < timestamp '2024-01-30'), 0)
        - coalesce(sum(value) filter (ts >= timestamp '2024-01-16' and ts < timestamp '2024-01-23'), 0), 4) as change
from events group by 1
""")
def comparison_windows(spark, d):
    """The last seven days beside the seven before, in one pass."""
    ts = F.col("ts")
    now = (ts >= F.expr("timestamp_ntz'2024-01-23'")) & (ts < F.expr("timestamp_ntz'2024-01-30'"))
    before = (ts >= F.expr("timestamp_ntz'2024-01-16'")) & (ts < F.expr("timestamp_ntz'2024-01-23'"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("value"))), F.lit(0.0))
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count_if(now).alias("now_n"), F.count_if(before).alias("before_n"), F.round(total(now) - total(before), 4).alias("change")
    )


@query("""
select p_brand, p_type, min(p_size) as least, max(p_size) as most, min(p_partkey) as id,
    (list(p_name order by p_retailprice desc, p_partkey))[1] as name, list_sort(list(distinct p_name)) as names
from part group by 1, 2
""")
def street_groups(spark, d):
    """Groups with their extent and the name of the row that comes first, whatever the input's order."""
    key = F.struct(-F.col("p_retailprice"), "p_partkey")
    return table(spark, d, "part").groupBy("p_brand", "p_type").agg(
        F.min("p_size").alias("least"), F.max("p_size").alias("most"), F.min("p_partkey").alias("id"),
        F.min_by("p_name", key).alias("name"), F.array_sort(F.collect_set("p_name")).alias("names"),
    )


@query("""
with m as (select y, m from range(1992, 2003) a(y), range(1, 13) b(m)),
t as (select year(o_orderdate) as y, month(o_orderdate) as m, count(*) as n, sum(o_totalprice) as total from orders group by 1, 2)
select m.y::int as year, m.m::int as month, coalesce(n, 0) as n, round(coalesce(total, 0), 2) as total from m left join t on t.y = m.y and t.m = m.m
""")
def dense_months(spark, d):
    """Totals of every month, also of those without a row."""
    months = spark.range(1992, 2003).select(F.col("id").cast("int").alias("year"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    t = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    t = t.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return op.dense(t, months, ["year", "month"], ["n", "total"])


@query("""
select c_mktsegment, (list(o_orderkey order by o_totalprice desc, o_orderkey))[1] as largest, max(o_totalprice) as price,
    (list(o_orderkey order by o_orderdate, o_orderkey))[1] as earliest
from orders join customer on o_custkey = c_custkey group by 1
""")
def record_holders(spark, d):
    """Rows that hold a record; the smallest id wins a tie."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_mktsegment").agg(
        F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("largest"),
        F.max("o_totalprice").alias("price"),
        F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("earliest"),
    )


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def latest_per_key(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return op.latest(rows, ["user_id"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("select user_id, event_type, min(event_id) as first_event_id, (list(value order by event_id desc))[1] as last_value from events group by 1, 2")
def first_and_last(spark, d):
    return op.first_and_last(table(spark, d, "events"), ["user_id", "event_type"], "event_id", "value")


@query("""
with e as (select event_id, case when event_type <> 'error' then user_id::varchar || ':' || event_type end as source, value from events)
select event_id, source, value from (select *, row_number() over (partition by source order by event_id) as r from e) where r = 1 or source is null
""")
def dedup_by_source(spark, d):
    """The first row of each source; rows without one all stay."""
    source = F.when(F.col("event_type") != "error", F.concat_ws(":", "user_id", "event_type"))
    rows = table(spark, d, "events").select("event_id", source.alias("source"), "value")
    return op.keep_first(rows, "source", [F.col("event_id")])


@query("""
select user_id, event_id, event_type from (
    select *, lag(event_type) over w as p, row_number() over w as r from events window w as (partition by user_id order by ts, event_id))
where r = 1 or p is distinct from event_type
""")
def adjacent_dedup(spark, d):
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return op.drop_adjacent(rows, ["user_id"], ["ts", "event_id"], "event_type").drop("ts")


@query("""
with a as (select 0 as s, c_custkey as id, c_name as name from customer where c_acctbal > 5000
    union all select 1, s_suppkey, s_name from supplier union all select 2, p_partkey, p_name from part)
select id, name from (select *, row_number() over (partition by id order by s) as r from a) where r = 1
""")
def merged_sources(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return op.merge_sources([c, s, p], "id")


@query("select substr(sha256(p_name), 1, 16) as name_id, count(*) as n, p_name from part group by 1, 3")
def interned_attributes(spark, d):
    pool, rows = op.intern(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "name_id")
    return rows.groupBy("name_id").agg(F.count("*").alias("n")).join(pool, "name_id")


@query("""
select p_brand, p_partkey, p_retailprice, r as rank, big from (
    select *, row_number() over (partition by p_brand, p_size >= 25 order by p_retailprice desc, p_partkey) as r, p_size >= 25 as big from part) where r <= 5
""")
def nested_top(spark, d):
    """Five large and five small rows of each group, in one window."""
    rows = table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice", (F.col("p_size") >= 25).alias("big"))
    return op.top_per_group(rows, ["p_brand", "big"], [F.desc("p_retailprice"), F.col("p_partkey")], 5)


@query("""
select p_partkey, p_name, p_retailprice, row_number() over (order by p_retailprice desc, p_partkey) as rank, true as has_more
from part order by rank limit 25
""")
def ranked_page(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")
    return op.page(rows, [F.desc("p_retailprice"), F.col("p_partkey")], 25)


@query("""
with p as (select quantile_cont(p_retailprice, 0.9) as p90 from part)
select p90, (select min(s) from (select pow(10.0, floor(log10(p90 / 16))) * m as s from (values (1), (2), (5), (10)) v(m)) where s * 16 >= p90) as step from p
""")
def nice_scale(spark, d):
    return op.nice_step(table(spark, d, "part"), "p_retailprice")


@query("""
select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_shipdate >= timestamp '2001-01-01')
    and p_partkey not in (select l_partkey from lineitem where l_quantity > 49)
""")
def mark_and_sweep(spark, d):
    lines = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    kept = [lines.where("l_shipdate >= '2001-01-01'"), lines.where("l_quantity > 49")]
    return op.mark_and_sweep(table(spark, d, "part").select("p_partkey"), kept, "p_partkey")


@query("""
select o_orderkey, o_totalprice from orders where o_totalprice >= 100000 and o_totalprice < 400000 and o_orderpriority in ('1-URGENT', '2-HIGH')
    and o_orderstatus not in ('P') and year(o_orderdate) = 1998
""")
def facet_filter(spark, d):
    """Conjunction of half-open ranges and of allowed and refused values; all reaches the scan."""
    return (
        table(spark, d, "orders")
        .where("o_totalprice >= 100000 and o_totalprice < 400000 and o_orderdate >= '1998-01-01' and o_orderdate < '1999-01-01'")
        .where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderstatus").isin("P"))
        .select("o_orderkey", "o_totalprice")
    )


@query("""
with s as (select *, case when user_id % 7 = 0 then 'unknown' when hour(ts) between 8 and 17 then 'open' else 'closed' end as state from events)
select event_type, count(*) filter (state = 'open') as shown, count(*) filter (state = 'unknown') as unknown from s group by 1
""")
def three_valued_filter(spark, d):
    """Open rows are shown, unknown ones left out and counted."""
    state = F.when(F.col("user_id") % 7 == 0, "unknown").when(F.hour("ts").between(8, 17), "open").otherwise("closed")
    rows = table(spark, d, "events").select("event_type", state.alias("state"))
    return rows.groupBy("event_type").agg(F.count_if(F.col("state") == "open").alias("shown"), F.count_if(F.col("state") == "unknown").alias("unknown"))


@query("""
select p_partkey, case when p_type = 'SMALL' and p_size < 10 then 'hut' when p_type in ('SMALL', 'ECONOMY') then 'shelter'
    when p_size > 40 then 'summit' else 'other' end as kind from part
""")
def kind_classification(spark, d):
    """The first fitting entry of a table in order of priority."""
    rules = [("hut", "p_type = 'SMALL' and p_size < 10"), ("shelter", "p_type in ('SMALL', 'ECONOMY')"), ("summit", "p_size > 40")]
    kind = F.coalesce(*(F.when(F.expr(test), name) for name, test in rules), F.lit("other"))
    return table(spark, d, "part").select("p_partkey", kind.alias("kind"))


@query("""
select p_partkey, upper(p_brand) || ' / ' || regexp_replace(p_name, '^(small|large) ', '') as label, nullif(trim(replace(p_type, 'SMALL', '')), '') as type from part
""")
def template_projection(spark, d):
    return table(spark, d, "part").select(
        "p_partkey",
        F.format_string("%s / %s", F.upper("p_brand"), F.regexp_replace("p_name", "^(small|large) ", "")).alias("label"),
        F.nullif(F.trim(F.replace("p_type", F.lit("SMALL"), F.lit(""))), F.lit("")).alias("type"),
    )


@query("""
with x as (select l_suppkey, l_partkey, sum(l_quantity) as q from lineitem group by 1, 2), m as (select l_suppkey, max(q) as most, sum(q) as whole from x group by 1)
select l_suppkey, (list(l_partkey order by q desc, l_partkey))[1] as donor, round(max(most / whole), 6) as share from x join m using (l_suppkey) group by 1
""")
def donor_selection(spark, d):
    """The member of the greatest share; the smallest id wins a tie."""
    x = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    return x.groupBy("l_suppkey").agg(
        F.max_by("l_partkey", F.struct("q", -F.col("l_partkey"))).alias("donor"), F.round(F.max("q") / F.sum("q"), 6).alias("share")
    )


@query("""
with i as (select distinct l_orderkey as id from lineitem where l_discount > 0.09), h as (select distinct l_orderkey as id from lineitem where l_tax > 0.07)
select o_orderkey, o_orderkey in (select id from i) as inside, o_orderkey in (select id from h) as halo from orders
where o_orderkey in (select id from i) or o_orderkey in (select id from h)
""")
def crop_sets(spark, d):
    """Kept sets of a crop: ids inside, ids in the halo, from one pass over the members."""
    flags = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max(F.col("l_discount") > 0.09).alias("inside"), F.max(F.col("l_tax") > 0.07).alias("halo")
    )
    return table(spark, d, "orders").select("o_orderkey").join(flags.where("inside or halo"), "o_orderkey")
