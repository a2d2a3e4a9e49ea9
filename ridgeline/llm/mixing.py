"""Mixing sources to target weights by Efraimidis-Spirakis sampling (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._prefix import prefix_sums
from ._store import materialize

#: A word of a text.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of sources in order of name, repeating.
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, nth, target`` from ``source, source_size``.

    Sources in order of code points, null last, have the repeating weights and share
    ``share`` times all sizes. A target stops at ``most`` times its source; the excess is
    shared again by weight until none is above. Sources are few, so this small table is
    ordered in one place.
    """
    everything = Window.partitionBy()
    nth = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    t = sizes.withColumn("nth", nth).withColumn("weight", weight)
    t = t.withColumn("cap", F.col("source_size") * most)
    t = t.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    # By rising cap for each unit of weight, sources reach their caps one after the other.
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    t = t.withColumn("cap_before", F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("weight_left", F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn(
        "full", F.col("cap") * F.col("weight_left") <= (F.col("budget") - F.col("cap_before")) * F.col("weight")
    )
    open_ = ~F.col("full")
    spent = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0))
    left = F.sum(F.when(open_, F.col("weight"))).over(everything)
    shared = F.col("weight") * (F.col("budget") - spent) / left
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(shared)
    return t.select("source", "source_size", "nth", target.alias("target"))


def quality_weight(labels: DataFrame) -> DataFrame:
    """``doc_id, weight``: 2 for label 1, a half for label 0; unlabelled ones get 1 later."""
    best = labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
    return best.agg(F.when(F.max("quality") == 1, 2.0).otherwise(0.5).alias("weight"))


def _uniform(id_col: str, seed: int) -> Column:
    """A number in (0, 1) that the id fixes, so that reruns agree."""
    text = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))
    whole = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double")
    return (whole + 0.5) / float(1 << 48)


def mix(
    docs: DataFrame,
    weights: DataFrame,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``doc_id, size, source, source_size, target, taken`` for every row of ``docs``.

    ``size`` is the number of words (0 for a null text); ``weights`` has ``doc_id, weight``
    of distinct ids, and other rows weigh 1. A source whose target holds its whole size once
    or twice takes that many complete epochs. The rest of the target takes rows in rising
    order of the key -ln(u) / weight, each row once, until the words are used up; the last row
    is cut to what is left. So a source takes its target to within a word, and a row at most
    twice its size. Rows of no words take none. Equal keys (repeated rows) stand by id and
    size. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    rows = materialize(rows.join(weights.select("doc_id", "weight"), "doc_id", "left"))
    targets = materialize(
        source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
        .withColumn("named", F.coalesce("source", F.lit("")))
        .withColumn("unnamed", F.col("source").isNull())
        .drop("source")
    )
    key = -F.log(_uniform("doc_id", seed)) / F.coalesce("weight", F.lit(1.0))
    keyed = (
        rows.withColumns(
            {"named": F.coalesce("source", F.lit("")), "unnamed": F.col("source").isNull(), "key": key}
        )
        .join(targets, ["named", "unnamed"])
        .select("doc_id", "size", "source", "source_size", "target", "nth", "key")
    )
    summed = prefix_sums(keyed, ["nth", "key", "doc_id", "size"], ["size"], "nth")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    left = F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + F.lit(0.5)).cast("long")
    part = F.least(F.greatest(left - F.col("size_before"), F.lit(0)), F.col("size"))
    return summed.withColumn("epochs", epochs).select(
        "doc_id",
        "size",
        "source",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"),
    )


def mixed_rows(
    docs: DataFrame,
    weights: DataFrame,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns, each as often as the mix takes it.

    A row that is taken in part has its text cut after that many words; a row of which the
    mix takes nothing (so every row without words) has no row. Other cases are as in ``mix``.
    """
    key = ["_doc", "_size", "_source"]
    taken = mix(docs, weights, seed, id_col, text_col, source_col).where("taken > 0")
    taken = taken.select(F.col("doc_id").alias("_doc"), F.col("size").alias("_size"), F.col("source").alias("_source"), "taken")
    taken = taken.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("taken"))))
    text = F.col(text_col)
    rows = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.col(id_col).cast("long").alias("_doc"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        F.col(source_col).alias("_source"),
    ).where("_size > 0")
    # Rows of one id, size and source are dealt in order of their texts, on the join's own keys.
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(f"row.{text_col}"))))
    same = [rows[k].eqNullSafe(taken[k]) for k in ["_doc", "_source"]]
    met = rows.join(taken, [*same, rows["_size"] == taken["_size"], rows["_nth"] == taken["_nth"]])
    met = met.select("row", "taken", rows["_size"].alias("_size"))
    times = F.array_repeat(F.col("_size"), F.floor(F.col("taken") / F.col("_size")).cast("int"))
    part = F.filter(F.array(F.col("taken") % F.col("_size")), lambda x: x > 0)
    each = met.select("row", "_size", F.explode(F.concat(times, part)).alias("words"))
    text = F.col(f"row.{text_col}")
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("words").cast("int")), "")
    whole = F.when(F.col("words") == F.col("_size"), text).otherwise(cut)
    return each.select(*(whole.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
