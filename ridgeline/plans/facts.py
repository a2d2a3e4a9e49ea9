"""Facts about groups and single values, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query, table
from ..functions import values as val
from ..operators import tables as op


@query("""
select l_orderkey, round(sum(l_extendedprice), 2) as length, round(sum(l_extendedprice) filter (l_returnflag = 'A'), 2) as paved,
    round(sum(l_extendedprice) filter (l_returnflag = 'N'), 2) as gravel, round(sum(l_extendedprice) filter (l_returnflag = 'R'), 2) as unknown from lineitem group by 1
""")
def leg_totals(spark, d):
    """Totals of each route, and by surface in columns."""
    price = F.col("l_extendedprice")
    by = {"paved": "A", "gravel": "N", "unknown": "R"}
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.round(F.sum(price), 2).alias("length"), *(F.round(F.sum(F.when(F.col("l_returnflag") == v, price)), 2).alias(k) for k, v in by.items())
    )


@query("""
select l_orderkey, list(l_linenumber order by l_linenumber) as rows, to_json(list({'n': l_linenumber, 'flag': l_returnflag} order by l_linenumber, l_returnflag))::varchar as json
from lineitem group by 1
""")
def grouped_rows(spark, d):
    """Members of each key in order, as an array and as JSON; orders have few lines."""
    item = F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("flag"))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return g.select("l_orderkey", F.transform("items", lambda i: i["n"]).alias("rows"), F.to_json("items").alias("json"))


@query("""
select p_brand, count(*) as n, round(quantile_cont(p_retailprice, 0.95), 6) as p95, round(count(*) filter (p_size >= 25) / count(*), 6) as cover from part group by 1
""")
def cell_statistics(spark, d):
    """Count, 95th percentile and share of cover of each cell."""
    return table(spark, d, "part").groupBy("p_brand").agg(
        F.count("*").alias("n"), F.round(F.percentile("p_retailprice", F.lit(0.95)), 6).alias("p95"), F.round(F.count_if(F.col("p_size") >= 25) / F.count("*"), 6).alias("cover")
    )


@query("""
with j as (select s_suppkey, s_nationkey, l_orderkey, 1 << (l_linenumber % 4) as mask from supplier join lineitem on l_suppkey = s_suppkey)
select s_suppkey, bit_or(mask)::int as mask, min(l_orderkey) as entry from j group by 1 having (bit_or(mask) & 3) = 3
""")
def access_masks(spark, d):
    """Places joined to the ways through them, with the permissions of all, where two are granted."""
    ways = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", F.expr("shiftleft(1, l_linenumber % 4)").alias("mask"))
    g = ways.groupBy("l_suppkey").agg(F.bit_or("mask").alias("mask"), F.min("l_orderkey").alias("entry"))
    held = g.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    return held.where(F.col("mask").bitwiseAND(3) == 3).select(F.col("l_suppkey").alias("s_suppkey"), "mask", "entry")


@query("""
with m as (select user_id, event_type, value - avg(value) over (partition by user_id) as bias from events)
select event_type, count(*) as n, round(median(bias), 6) as bias from m group by 1 having count(*) >= 20
""")
def median_bias(spark, d):
    """Median of the differences from a base, of each model with enough samples."""
    e = table(spark, d, "events")
    base = e.groupBy("user_id").agg(F.avg("value").alias("base"))
    bias = e.join(base, "user_id").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.median(F.col("value") - F.col("base")), 6).alias("bias"))
    return bias.where("n >= 20")


@query("""
select coalesce(c_custkey, s_suppkey) as id, coalesce(c_nationkey, s_nationkey) as nation, coalesce(c_nationkey <> s_nationkey, false) as conflict
from customer full join supplier on c_custkey = s_suppkey
""")
def manifest_merge(spark, d):
    """Two manifests as one; keys that they describe differently are marked."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    return op.merged_manifests(c, s, "id", ["nation"])


@query("""
with h as (select c_custkey as id, day, c_custkey % 5 * 60 + 480 as a, c_custkey % 5 * 60 + 480 + (c_custkey * 37 % 19 + 1) * 60 as b from customer, range(7) r(day)
    where c_custkey % 11 <> 0 and (c_custkey + day) % 6 <> 0),
q as (select c_custkey as id, day, m as minute from customer, range(7) r(day), (values (30), (600), (1290)) v(m))
select q.id, q.day::int as day, q.minute::int as minute, case when q.id % 11 = 0 then 'unknown' when exists (select 1 from h where h.id = q.id and
    ((h.day = q.day and minute >= a and minute < b) or (h.day = (q.day + 6) % 7 and minute + 1440 >= a and minute + 1440 < b))) then 'open' else 'closed' end as state from q
""")
def weekly_schedule(spark, d):
    """Open, closed or unknown at times of the week; hours may end on the next day."""
    days = F.explode(F.sequence(F.lit(0), F.lit(6)))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    a = (F.col("id") % 5 * 60 + 480).alias("start")
    hours = c.select("id", days.alias("day"), a).withColumn("end", F.col("start") + (F.col("id") * 37 % 19 + 1) * 60)
    hours = hours.where("id % 11 <> 0 and (id + day) % 6 <> 0")
    asked = c.select("id", days.alias("day")).withColumn("minute", F.explode(F.array(F.lit(30), F.lit(600), F.lit(1290))))
    return op.open_states(hours, asked)


@query("""
with n as (select user_id % 20 as cell, hour(ts) // 3 as s, count(*) as n from events group by 1, 2),
r as (select cell, s, coalesce(n.n, 0) / sum(coalesce(n.n, 0)) over (partition by cell) as share from (select distinct cell from n) c cross join range(8) r(s) left join n using (cell, s)),
w as (select a.cell, a.s, any_value(a.share) as share, sum(b.share) as three from r a join r b on a.cell = b.cell and (b.s - a.s + 8) % 8 in (7, 0, 1) group by 1, 2)
select cell, s::int as sector, round(share, 9) as share, round(three, 9) as three, row_number() over (partition by cell order by round(three, 9) desc, round(share, 9) desc, s) = 1 as main from w
""")
def rose_modes(spark, d):
    """Shares of eight sectors, sums of three around each, and the main one of each cell."""
    n = table(spark, d, "events").groupBy((F.col("user_id") % 20).alias("cell"), F.expr("hour(ts) div 3").cast("int").alias("sector")).agg(F.count("*").alias("n"))
    every = n.select("cell").distinct().withColumn("sector", F.explode(F.sequence(F.lit(0), F.lit(7))))
    w = Window.partitionBy("cell")
    r = op.dense(n, every, ["cell", "sector"], ["n"]).withColumn("share", F.col("n") / F.sum("n").over(w))
    around = r.select("cell", F.explode(F.array(*(F.pmod(F.col("sector") + o, F.lit(8)) for o in (-1, 0, 1)))).alias("sector"), "share")
    three = around.groupBy("cell", "sector").agg(F.round(F.sum("share"), 9).alias("three"))
    out = r.join(three, ["cell", "sector"]).select("cell", "sector", F.round("share", 9).alias("share"), "three")
    return out.withColumn("main", F.row_number().over(w.orderBy(F.desc("three"), F.desc("share"), "sector")) == 1)


@query("""
with c as (select user_id, count(*) filter (event_type <> 'error') as known, count(*) filter (event_type = 'view') as part from events group by 1)
select user_id, (case when known = 0 then 6 when part = 0 then 0 when part = known then 5 when 4 * part >= 3 * known then 4 when 2 * part >= known then 3
    when 4 * part >= known then 2 else 1 end) as class from c
""")
def share_classes(spark, d):
    c = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("known"), F.count_if(F.col("event_type") == "view").alias("part"))
    return c.select("user_id", val.share_class(F.col("part"), F.col("known")).alias("class"))


@query("""
with r as (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders)
select o_custkey, o_orderkey, o_orderdate, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as place from r where r <= 4
""")
def largest_in_order(spark, d):
    """The largest four of each group, in the order in which they come."""
    top = op.top_per_group(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 4)
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return top.select("o_custkey", "o_orderkey", "o_orderdate", place.alias("place"))


@query("""
with o as (select o_orderstatus as kind, count(*) as n, count(distinct o_custkey) as subjects from orders group by 1),
w as (select o_orderstatus as kind, count(distinct o_custkey) as unlinked from orders where o_custkey not in (select s_suppkey from supplier) group by 1)
select kind, n, subjects, coalesce(unlinked, 0) as unlinked from o left join w using (kind)
""")
def subject_counters(spark, d):
    """Rows, distinct subjects and subjects without a link, by kind."""
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("kind"), "o_custkey")
    linked = table(spark, d, "supplier").select(F.col("s_suppkey").alias("o_custkey"), F.lit(True).alias("linked"))
    j = o.join(linked, "o_custkey", "left")
    without = F.count_distinct(F.when(F.col("linked").isNull(), F.col("o_custkey")))
    return j.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("subjects"), without.alias("unlinked"))


@query("""
with b as ((select p_partkey, 'name' as branch from part where p_name = 'red widget' order by p_retailprice, p_partkey limit 40) union all
    (select p_partkey, 'brand' from part where p_brand = 'Brand#7' order by p_retailprice, p_partkey limit 30) union all
    (select p_partkey, 'size' from part where p_size = 11 order by p_retailprice, p_partkey limit 20))
select p_partkey, min(branch) as branch, count(*) as found from b group by 1
""")
def branch_candidates(spark, d):
    """Candidates of several branches, each with its own limit, and one row for each."""
    tests = {"name": F.col("p_name") == "red widget", "brand": F.col("p_brand") == "Brand#7", "size": F.col("p_size") == 11}
    return op.branches(table(spark, d, "part"), "p_partkey", {"name": 40, "brand": 30, "size": 20}, tests, [F.col("p_retailprice"), F.col("p_partkey")])


@query("""
select p_partkey, list_contains(string_split(p_name, ' '), 'ring') as listed from part
where list_contains(string_split(p_name, ' '), 'ring') or regexp_matches(p_type, 'STAND|LARGE')
""")
def list_or_pattern(spark, d):
    """Rows whose list holds a tag, or whose name fits a pattern."""
    listed = F.array_contains(F.split("p_name", " "), "ring")
    return table(spark, d, "part").where(listed | F.col("p_type").rlike("STAND|LARGE")).select("p_partkey", listed.alias("listed"))


@query("""
with u as (select 'n' as shard, n_nationkey::bigint as id, n_name as name from nation union all select 's', s_suppkey, s_name from supplier union all select 'c', c_custkey, c_name from customer)
select id, min(shard) as shard, arg_min(name, shard) as name from u group by 1
""")
def shard_union(spark, d):
    """The same question to several shards, and one row for each identity."""
    parts = [("n", "nation", "n_nationkey", "n_name"), ("s", "supplier", "s_suppkey", "s_name"), ("c", "customer", "c_custkey", "c_name")]
    out = None
    for shard, name, key, label in parts:
        rows = table(spark, d, name).select(F.lit(shard).alias("shard"), F.col(key).cast("long").alias("id"), F.col(label).alias("name"))
        out = rows if out is None else out.unionByName(rows)
    return op.keep_first(out, "id", [F.col("shard")])


#: Some spellings of address words; a library's user gives their own.
WORDS, SUFFIXES = {"st": "street", "rd": "road"}, {"strasse": "strasse", "str": "strasse", "weg": "weg"}


@query("""
with n as (select c_custkey as id, c_custkey % 4 as k, c_custkey // 4 as n from customer),
t as (select id, case k when 0 then 'main st ' || n when 1 then 'bahnhofstr ' || n when 2 then 'holzweg' else 'old rd' end as t,
    case k when 0 then 'main street ' || n when 1 then 'bahnhof strasse ' || n when 2 then 'holz weg' else 'old road' end as canonical from n)
select id, t, canonical, substr(sha1(t), 1, 12) as address,
    list_reduce(list_prepend(0::bigint, list_transform(string_split(sha256(t), ''), lambda c: (strpos('0123456789abcdef', c) - 1)::bigint)), lambda a, b: (a * 16 + b) % 1000003) as slot from t
""")
def address_keys(spark, d):
    """Street names in canonical spelling, with keys made of their digests."""
    k, n = F.col("c_custkey") % 4, F.expr("c_custkey div 4").cast("string")
    t = F.when(k == 0, F.concat(F.lit("main st "), n)).when(k == 1, F.concat(F.lit("bahnhofstr "), n)).when(k == 2, "holzweg").otherwise("old rd")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), t.alias("t"))
    return rows.select(
        "id", "t", val.canonical_words(F.col("t"), WORDS, SUFFIXES).alias("canonical"),
        F.substring(F.sha1("t"), 1, 12).alias("address"), val.hash_slot(F.col("t"), 1_000_003).alias("slot"),
    )


@query("""
with d as (select distinct o_orderdate::date as date from orders),
s as (select date, year(date) - (month(date) < 9)::int as season, case when month(date) = 2 and day(date) = 29 then date - 1 else date end as x from d),
y as (select date, season, datediff('day', make_date(season, 9, 1), x::date) - (month(date) between 3 and 8 and day(last_day(make_date(year(date), 2, 1))) = 29)::int as n from s)
select date, season::int as season, least(182, n // 2)::int as index from y
""")
def season_days(spark, d):
    """The place of each date in its season."""
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return days.select("date", val.season_day(F.col("date")).alias("s")).select("date", "s.season", "s.index")


@query("""
with n as (select event_id, user_id, (value * 1000)::bigint - 60000 as n, row_number() over (partition by user_id order by event_id) as r from events),
z as (select event_id, n, case when d >= 0 then 2 * d else -2 * d - 1 end as z from (select *, n - coalesce(lag(n) over (partition by user_id order by r), 0) as d from n))
select event_id, case when n between -32767 and 32767 then n::smallint end as stored, z as coded, (case when z < 128 then 1 when z < 16384 then 2 when z < 2097152 then 3 else 4 end) as bytes from z
""")
def coded_deltas(spark, d):
    """Differences along a series as they are stored: small whole numbers, in bytes."""
    n = F.round(F.col("value") * 1000).cast("long") - 60_000
    e = table(spark, d, "events").select("event_id", "user_id", n.alias("n"))
    before = F.coalesce(F.lag("n").over(Window.partitionBy("user_id").orderBy("event_id")), F.lit(0))
    z = e.withColumn("coded", val.zigzag(F.col("n") - before))
    return z.select("event_id", val.quantised(F.col("n").cast("double")).alias("stored"), "coded", val.varint_bytes(F.col("coded")).alias("bytes"))


@query("""
with r as (select p_partkey, p_size, p_brand, lead(p_brand) over (order by p_partkey) as next from part),
n as (select p_partkey, regexp_extract(p_brand, '[0-9]+') as a, regexp_extract(next, '[0-9]+') as b from r where next is not null)
select p_partkey, a = b as agree from n
""")
def ref_agreement(spark, d):
    """Whether neighbours' references share a number."""
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat(F.lit("ref "), F.regexp_extract("p_brand", "([0-9]+)", 1)).alias("other"))
    return p.join(after, "p_partkey").select("p_partkey", val.refs_agree(F.col("p_brand"), F.col("other")).alias("agree"))


@query("""
select s_suppkey, case s_suppkey % 5 when 0 then 'en:Lake ' || s_suppkey when 1 then 'de:Berg & Tal/' || s_suppkey when 2 then null when 3 then null else 'fr:Mont' end as article from supplier
""")
def article_identities(spark, d):
    """Links and tags that name an article, in one form."""
    i = F.col("s_suppkey")
    n = i.cast("string")
    given = (
        F.when(i % 5 == 0, F.concat(F.lit("https://en.wikipedia.org/wiki/Lake_"), n))
        .when(i % 5 == 1, F.concat(F.lit("http://de.wikipedia.org/wiki/Berg_%26_Tal%2F"), n))
        .when(i % 5 == 2, F.concat(F.lit("https://example.org/wiki/"), n))
        .when(i % 5 == 3, F.lit("fr:Mont#Top"))
        .otherwise(F.lit("fr:Mont"))
    )
    return table(spark, d, "supplier").select("s_suppkey", val.article(given).alias("article"))


@query("""
select c_custkey, case when c_acctbal >= 0 then round(sqrt(c_acctbal), 9) end as root, round(10 - 0.0065 * c_acctbal, 6) as lapse from customer
""")
def safe_roots(spark, d):
    """Roots that are null for negative numbers, and temperatures moved to another height."""
    x = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", F.round(val.safe_sqrt(x), 9).alias("root"), F.round(10 - 0.0065 * x, 6).alias("lapse"))


@query("""
select p_partkey, case when contains(p_name, 'u') then replace(p_name, 'u', 'ü') || '|' || replace(p_name, 'u', 'ue') else p_name end as forms from part
""")
def umlaut_forms(spark, d):
    """Spellings of names that an index holds."""
    name = F.replace("p_name", F.lit("u"), F.lit("ü"))
    return table(spark, d, "part").select("p_partkey", F.array_join(val.umlaut_forms(name), "|").alias("forms"))


@query("""
with w as (select s_suppkey as id, s_nationkey % 3 as k from supplier)
select id, case k when 0 then 'same' when 1 then 'words' end as agree from w
""")
def name_agreement(spark, d):
    """How names agree: by letters, by words, or not."""
    k = F.col("s_nationkey") % 3
    other = F.when(k == 0, "north-trail 7").when(k == 1, "The North Trail (7)").otherwise("North Trail 8")
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), val.names_agree(F.lit("North Trail 7"), other).alias("agree"))
