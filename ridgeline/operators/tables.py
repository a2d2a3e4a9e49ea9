"""Relational operators on keyed tables: latest rows, merging, grouping, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; one map-side combined aggregate, no sort of whole groups."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_row.`{c}`") for c in rest))


def first_and_last(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``first_<order>`` and the last ``value`` of each key."""
    return df.groupBy(*keys).agg(F.min(order).alias(f"first_{order}"), F.max_by(value, order).alias(f"last_{value}"))


def keep_first(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row of each known key, by ``order``; rows without a key all stay."""
    known = df.where(F.col(key).isNotNull())
    rest = [c for c in df.columns if c != key]
    one = known.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    one = one.select(key, *(F.col(f"_row.`{c}`") for c in rest)).select(*df.columns)
    return one.unionByName(df.where(F.col(key).isNull()))


def merge_sources(tables: list[DataFrame], key: str) -> DataFrame:
    """Rows of all tables; of a key, only those of the first table that has it."""
    out = None
    for n, t in enumerate(tables):
        t = t.withColumn("_nth", F.lit(n))
        out = t if out is None else out.unionByName(t)
    return keep_first(out, key, [F.col("_nth")]).drop("_nth")


def drop_adjacent(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before, in order within the group."""
    before = F.lag(value).over(Window.partitionBy(*group).orderBy(*order))
    start = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) == 1
    return df.withColumn("_new", start | ~F.col(value).eqNullSafe(before)).where("_new").drop("_new")


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``base`` with rows of ``changes`` in place of those of the same key, and new ones added."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes)


def intern(df: DataFrame, value: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Distinct values with an address each, and the rows that refer to it.

    The address is a digest of the value, so partitions need not agree on a count.
    """
    address = F.substring(F.sha2(F.col(value), 256), 1, 16).alias(name)
    pool = df.where(F.col(value).isNotNull()).select(address, value).distinct()
    return pool, df.withColumn(name, address).drop(value)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group, with ``rank``."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def page(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows with ``has_more``: one row more is asked for and not shown."""
    some = df.orderBy(*order).limit(limit + 1)
    rank = F.row_number().over(Window.orderBy(*order))
    more = F.count("*").over(Window.partitionBy()) > limit
    return some.withColumns({"rank": rank, "has_more": more}).where(F.col("rank") <= limit)


def dense(df: DataFrame, keys: DataFrame, on: list[str], zero: list[str]) -> DataFrame:
    """One row for each of ``keys``; where ``df`` has none, ``zero`` columns are 0."""
    return keys.join(df, on, "left").fillna(0, subset=zero)


def two_level(df: DataFrame, inner: list[str], outer: list[str], count: str, threshold: int) -> DataFrame:
    """Counts within ``inner`` keys, then over ``outer``: totals and how many pass a threshold."""
    low = df.groupBy(*inner).agg(F.sum(count).alias("calls"))
    return low.groupBy(*outer).agg(
        F.sum("calls").alias("calls"),
        F.count("*").alias("groups"),
        F.sum((F.col("calls") >= threshold).cast("int")).alias("busy"),
    )


def mark_and_sweep(listed: DataFrame, kept: list[DataFrame], key: str) -> DataFrame:
    """Listed keys that no kept release names."""
    named = kept[0].select(key)
    for k in kept[1:]:
        named = named.unionByName(k.select(key))
    return listed.join(named, key, "left_anti")


def nice_step(df: DataFrame, value: str, bars: int = 16) -> DataFrame:
    """The least step of 1, 2 or 5 times a power of ten whose ``bars`` steps pass the 90th percentile."""
    p = df.agg(F.expr(f"percentile({value}, 0.9)").alias("p90"))
    low = F.pow(F.lit(10.0), F.floor(F.log10(F.col("p90") / bars)))
    choices = F.array(*(low * m for m in (1, 2, 5, 10)))
    return p.withColumn("step", F.array_min(F.filter(choices, lambda s: s * bars >= F.col("p90"))))


def merged_manifests(a: DataFrame, b: DataFrame, key: str, values: list[str]) -> DataFrame:
    """All keys of both, values of ``a`` first, and ``conflict`` where both know different ones."""
    other = b.withColumnsRenamed({v: f"_{v}" for v in values})
    both = a.join(other, key, "full")
    differs = F.lit(False)
    for v in values:
        differs = differs | F.coalesce(F.col(v) != F.col(f"_{v}"), F.lit(False))
    return both.select(key, *(F.coalesce(v, f"_{v}").alias(v) for v in values), differs.alias("conflict"))


def open_states(hours: DataFrame, asked: DataFrame) -> DataFrame:
    """``id, day, minute, state`` of asked times: open, closed, or unknown without any hours.

    ``hours`` has ``id, day, start, end`` in minutes; an end beyond 1440 lies on the next day.
    """
    late = hours.where("end > 1440").select("id", F.pmod(F.col("day") + 1, F.lit(7)).alias("day"), F.lit(0).alias("start"), (F.col("end") - 1440).alias("end"))
    every = hours.unionByName(late).groupBy("id", "day").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    known = hours.select("id").distinct().withColumn("known", F.lit(True))
    at = asked.join(every, ["id", "day"], "left").join(known, "id", "left")
    held = F.exists("spans", lambda s: (F.col("minute") >= s["start"]) & (F.col("minute") < s["end"]))
    return at.select("id", "day", "minute", F.when(F.col("known").isNull(), "unknown").when(held, "open").otherwise("closed").alias("state"))


def branches(df: DataFrame, key: str, limits: dict[str, int], tests: dict[str, Column], order: list[Column]) -> DataFrame:
    """``key, branch, found``: rows of several branches, each with its own limit in one order.

    A limit for each keeps one branch from crowding out the others.
    """
    out = None
    for name, test in tests.items():
        some = df.where(test).orderBy(*order).limit(limits[name]).select(key, F.lit(name).alias("branch"))
        out = some if out is None else out.unionByName(some)
    return out.groupBy(key).agg(F.min("branch").alias("branch"), F.count("*").alias("found"))
