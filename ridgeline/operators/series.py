"""Operators on ordered samples: steps, runs, gaps, windows over time, folds with memory.

A series is the rows of one key in one order. Windows partition by that key, so a series
lives in one task; keys are rides, routes or devices, whose length the recording bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order(key: list[str], order: list[str]):
    return Window.partitionBy(*key).orderBy(*order)


def runs(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Adds ``run``: the number of changes of ``value`` so far (null is a value)."""
    w = in_order(key, order)
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    return df.withColumn("_changed", changed.cast("int")).withColumn("run", F.sum("_changed").over(w)).drop("_changed")


def run_lengths(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """One row for each run of equal values: its first and last place and its rows."""
    at = order[0]
    grouped = runs(df, key, order, value).groupBy(*key, "run")
    return grouped.agg(F.first(value).alias(value), F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("rows"))


def gaps(df: DataFrame, key: list[str], at: str, least: float, then: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``gap`` to the rows that come more than ``least`` after the one before.

    Of rows of one time only the first can have a gap; ``then`` names the columns that order them.
    """
    before = F.lag(at).over(in_order(key, [at, *then]))
    return df.withColumn("gap", F.col(at) - before).where(F.col("gap") > least)


def sessions(df: DataFrame, key: list[str], at: str, most: float) -> DataFrame:
    """Adds ``session``, counted from 0: a gap of more than ``most`` begins a new one."""
    w = in_order(key, [at])
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > most).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w)).drop("_new")


def moving_mean(df: DataFrame, key: list[str], at: str, value: str, half: int, name: str) -> DataFrame:
    """Mean of the values within ``half`` units of time on either side; null stays null."""
    w = Window.partitionBy(*key).orderBy(at).rangeBetween(-half, half)
    return df.withColumn(name, F.when(F.col(value).isNotNull(), F.avg(value).over(w)))


def circular_mean(df: DataFrame, key: list[str], at: str, value: str, period: int, half: int) -> DataFrame:
    """``mean`` of each step of a period with its ``half`` neighbours, past the ends; nulls skipped."""
    near = df.select(*key, F.explode(F.array(*(F.pmod(F.col(at) + o, F.lit(period)) for o in range(-half, half + 1)))).alias(at), value)
    return near.groupBy(*key, at).agg(F.avg(value).alias("mean"))


def between_events(df: DataFrame, key: list[str], at: str, start: Column, end: Column, least: float, most: int) -> DataFrame:
    """The longest ``most`` stretches of a range without an event, of ``least`` or more."""
    ends = df.select(*key).distinct()
    marks = df.select(*key, F.col(at).alias("at")).unionByName(ends.select(*key, start.alias("at"))).unionByName(ends.select(*key, end.alias("at")))
    pairs = marks.withColumn("to", F.lead("at").over(in_order(key, ["at"]))).withColumn("length", F.col("to") - F.col("at"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("length"), "at"))
    return pairs.where(F.col("length") >= least).withColumn("rank", rank).where(F.col("rank") <= most)


def at_measure(df: DataFrame, asked: DataFrame, key: list[str], measure: str, place: str, values: list[str]) -> DataFrame:
    """Values of a series at asked places, linear between its points, null beyond its ends.

    Points and places are ordered together in one window, so no range join is needed.
    """
    known = df.select(*key, F.col(measure).alias("_m"), F.lit(False).alias("_asked"), *values)
    wanted = asked.select(*key, F.col(place).alias("_m"), F.lit(True).alias("_asked"), *(F.lit(None).cast("double").alias(v) for v in values))
    order = ["_m", "_asked"]
    back = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*key).orderBy("_m", F.desc("_asked")).rowsBetween(0, Window.unboundedFollowing)
    point = F.when(~F.col("_asked"), F.struct("_m", *values))
    both = known.unionByName(wanted).withColumn("_a", F.last(point, True).over(back)).withColumn("_b", F.first(point, True).over(ahead))
    both = both.where("_asked")
    span = F.col("_b._m") - F.col("_a._m")
    share = F.when(span > 0, (F.col("_m") - F.col("_a._m")) / span).otherwise(0.0)
    some = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    value = lambda v: F.when(some, F.col(f"_a.{v}") + (F.col(f"_b.{v}") - F.col(f"_a.{v}")) * share)
    return both.select(*key, F.col("_m").alias(place), *(value(v).alias(v) for v in values))


def steps_every(df: DataFrame, key: list[str], measure: str, step: float, name: str) -> DataFrame:
    """Places each ``step`` along a series, and its end."""
    ends = df.groupBy(*key).agg(F.min(measure).alias("_a"), F.max(measure).alias("_b"))
    n = F.floor((F.col("_b") - F.col("_a")) / step)
    inner = F.transform(F.sequence(F.lit(0).cast("long"), n), lambda i: F.col("_a") + i * step)
    places = F.array_distinct(F.concat(inner, F.array(F.col("_b"))))
    return ends.select(*key, F.explode(places).alias(name))


def dead_band(values: Column, band: float) -> Column:
    """``up`` and ``down`` of a series (an array): a change counts once it reaches ``band``."""
    zero = F.lit(0.0)
    start = F.struct(F.lit(None).cast("double").alias("ref"), zero.alias("up"), zero.alias("down"))

    def step(s: Column, v: Column) -> Column:
        move = v - s["ref"]
        book = F.abs(move) >= band
        return (
            F.when(v.isNull(), s)
            .when(s["ref"].isNull(), F.struct(v.alias("ref"), s["up"].alias("up"), s["down"].alias("down")))
            .when(
                book,
                F.struct(
                    v.alias("ref"),
                    (s["up"] + F.greatest(move, zero)).alias("up"),
                    (s["down"] + F.greatest(-move, zero)).alias("down"),
                ),
            )
            .otherwise(s)
        )

    return F.aggregate(values, start, step)


def gathered(df: DataFrame, key: list[str], order: str, values: list[str], name: str = "series") -> DataFrame:
    """Each series as one ordered array of structs."""
    return df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, *values))).alias(name))


def weighted(value: str, weight: str) -> Column:
    """Mean by weight of the values that are known."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return F.sum(F.col(value) * w) / F.nullif(F.sum(w), F.lit(0.0))


def buckets(df: DataFrame, key: list[str], at: str, value: str, low: float, high: float, count: int) -> DataFrame:
    """Least, greatest and mean value of each of ``count`` equal columns of a range."""
    n = F.least(F.floor((F.col(at) - low) / ((high - low) / count)), F.lit(count - 1)).cast("int")
    rows = df.where((F.col(at) >= low) & (F.col(at) <= high)).withColumn("bucket", n)
    return rows.groupBy(*key, "bucket").agg(F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"))


def merged_ranges(df: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """Overlapping or touching ranges as one."""
    w = Window.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_new", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1)))
    rows = rows.withColumn("_island", F.sum("_new").over(w))
    return rows.groupBy(*key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def hysteresis_zone(values: Column, cuts: list[float], margin: float) -> Column:
    """Zones of a series (an array): a neighbour is entered only past its border by ``margin``."""

    def zone(v: Column) -> Column:
        out = F.lit(0)
        for c in cuts:
            out = out + (v >= c).cast("int")
        return out

    def low(z: Column) -> Column:
        return F.element_at(F.array(*(F.lit(float(c)) for c in [-1e300, *cuts])), z + 1)

    def high(z: Column) -> Column:
        return F.element_at(F.array(*(F.lit(float(c)) for c in [*cuts, 1e300])), z + 1)

    def step(s: Column, v: Column) -> Column:
        stay = s["z"].isNotNull() & (v >= low(s["z"]) - margin) & (v < high(s["z"]) + margin)
        new = F.when(v.isNull() | stay, s["z"]).otherwise(zone(v))
        return F.struct(new.alias("z"), F.concat(s["zones"], F.array(new)).alias("zones"))

    start = F.struct(F.lit(None).cast("int").alias("z"), F.array().cast("array<int>").alias("zones"))
    return F.aggregate(values, start, step)["zones"]


#: Metres of a climb's least gain, drop that ends it, flat that ends it and
#: least length, and its least mean slope.
CLIMB = {"gain": 80.0, "drop": 25.0, "flat": 300.0, "length": 400.0, "slope": 0.03}


def climbs(series: Column, rules: dict[str, float] = CLIMB) -> Column:
    """Climbs of a profile, an ordered array of structs ``d, e`` (metres along and of height).

    A climb starts at a low and ends at its last high, once the height falls ``drop`` below
    that or nothing higher comes for ``flat``. It counts with enough gain, length and slope.
    """
    place = "struct<d:double,e:double>"
    none = F.lit(None).cast(f"struct<low:{place},top:{place},found:array<struct<start:double,end:double,gain:double>>>")

    def closed(s: Column) -> Column:
        gain, length = s["top"]["e"] - s["low"]["e"], s["top"]["d"] - s["low"]["d"]
        good = (gain >= rules["gain"]) & (length >= rules["length"]) & (gain >= length * rules["slope"])
        one = F.struct(s["low"]["d"].alias("start"), s["top"]["d"].alias("end"), gain.alias("gain"))
        return F.when(good, F.concat(s["found"], F.array(one))).otherwise(s["found"])

    def state(low: Column, top: Column, found: Column) -> Column:
        return F.struct(low.alias("low"), top.alias("top"), found.alias("found"))

    def step(s: Column, p: Column) -> Column:
        here = F.struct(p["d"].alias("d"), p["e"].alias("e"))
        empty = F.array().cast("array<struct<start:double,end:double,gain:double>>")
        over = (s["top"]["e"] - p["e"] >= rules["drop"]) | (p["d"] - s["top"]["d"] >= rules["flat"])
        return (
            F.when(p["e"].isNull(), s)
            .when(s.isNull(), state(here, here, empty))
            .when((p["e"] > s["top"]["e"]), state(s["low"], here, s["found"]))
            .when(over, state(here, here, closed(s)))
            .when((s["top"]["e"] <= s["low"]["e"]) & (p["e"] <= s["low"]["e"]), state(here, here, s["found"]))
            .otherwise(s)
        )

    return F.aggregate(series, none, step, closed)
