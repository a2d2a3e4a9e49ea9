"""Place search as joins with inverted tables: words, grams, tiers, scores.

Names and what is exploded from them are hinted to be merged: their size is told by the file,
which compresses well, so they would pass for small and be broadcast through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn

#: Points of a match by its kind, lost for each edit, for nearness and for
#: prominence at most.
TIERS = {"exact": 100, "compact": 98, "prefix": 88, "words": 74, "fuzzy": 58}
PER_EDIT, NEAR, PROMINENCE = 8, 12, 8


def index_terms(names: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Inverted table ``term, id``: every distinct word of each name."""
    return names.select(F.explode(F.array_distinct(fn.words(F.col(name_col)))).alias("term"), F.col(id_col).alias("id"))


def lexicon(terms: DataFrame, least: int = 5, most: int = 80) -> DataFrame:
    """Distinct terms of a length, with their number of rows."""
    return terms.where(F.length("term").between(least, most)).groupBy("term").agg(F.count("*").alias("held"))


def all_words(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """``query, id`` of names that hold all words of a query, the last one as a prefix.

    ``queries`` has ``query`` in normal form. A word meets its term by an equal join; the
    last one meets terms by each term's prefixes. A query without words finds nothing.
    """
    asked = queries.select("query", F.array_distinct(fn.words(F.col("query"))).alias("w"))
    # Prefixes are made of distinct terms only, which are far fewer than rows.
    distinct = terms.select("term").distinct()
    prefixes = distinct.select("term", F.explode(F.transform(F.sequence(F.lit(1), F.length("term")), lambda n: F.substring("term", F.lit(1), n))).alias("part"))
    last = asked.select("query", F.try_element_at("w", F.lit(-1)).alias("part"), F.size("w").alias("n"), (F.size("w") - 1).alias("place"))
    first = asked.select("query", F.posexplode(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0)))).alias("place", "term"), F.size("w").alias("n"))
    meets = first.select("query", "place", "term", "n").unionByName(last.join(prefixes.hint("merge"), "part").select("query", "place", "term", "n"))
    hits = meets.join(terms.hint("merge"), "term").groupBy("query", "id", "n").agg(F.count_distinct("place").alias("found"))
    return hits.where("found = n").select("query", "id")


def corrections(queries: DataFrame, lexicon_: DataFrame, most: int = 8) -> DataFrame:
    """``query, term, edits`` of the lexicon's terms within the budget of edits, the nearest ``most``.

    A term is a candidate when it and the query become the same by leaving out letters of
    each, at most as many as the budget. Every edit leaves out at most one of either, so no term is missed.
    """
    budget = fn.edit_budget(F.col("query"))
    asked = queries.select("query", budget.alias("budget"), F.explode(fn.shortened("query", budget)).alias("key"))
    # The longest query that may reach the term has the largest budget.
    reach = F.when(F.length("term") < 4, 0).when(F.length("term") < 6, 1).otherwise(2)
    held = lexicon_.select("term", F.explode(fn.shortened("term", reach)).alias("key"))
    near = F.abs(F.length("query") - F.length("term")) <= F.col("budget")
    pairs = asked.join(held.hint("merge"), "key").where(near).select("query", "term", "budget").distinct()
    found = pairs.withColumn("edits", fn.edits("query", "term", "budget")).where("edits <= budget")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("edits", "term"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most).select("query", "term", "edits", "rank")


def tier(query: Column, name: Column) -> Column:
    """The kind of a match of two normal forms."""
    return (
        F.when(name == query, "exact")
        .when(fn.compact(name) == fn.compact(query), "compact")
        .when(name.startswith(query), "prefix")
        .otherwise("words")
    )


def score(kind: Column, edits: Column, km: Column, prominence: Column) -> Column:
    points = F.coalesce(*(F.when(kind == k, float(v)) for k, v in TIERS.items()))
    return points - PER_EDIT * edits + NEAR / (1 + km / 20) + F.least(prominence, F.lit(float(PROMINENCE)))


def ranked(scored: DataFrame, group: str, limit: int) -> DataFrame:
    """The best ``limit`` of each query, by score, then id."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def house_numbers(queries: DataFrame, streets: DataFrame, houses: DataFrame) -> DataFrame:
    """``query, street, house, note``: a house of a street, else the street with a note.

    ``queries`` has ``query`` as street and number; ``streets`` has ``name, street``;
    ``houses`` has ``street, house``.
    """
    asked = queries.select(
        "query", F.trim(F.regexp_extract("query", r"^(.*?)\s*([0-9]+[a-z]?)$", 1)).alias("name"),
        F.regexp_extract("query", r"([0-9]+[a-z]?)$", 1).alias("house"),
    )
    at = asked.join(streets, "name")
    exact = at.join(houses.distinct(), ["street", "house"]).select("query", "street", "house", F.lit(None).cast("string").alias("note"))
    rest = at.join(exact.select("query").distinct(), "query", "left_anti")
    return exact.unionByName(rest.select("query", "street", F.lit(None).cast("string").alias("house"), F.lit("number not found").alias("note")))


def resolved(queries: DataFrame, names: DataFrame, limit: int) -> DataFrame:
    """``query, id, read_as, score, rank``: the best ``limit`` rows of each request.

    Names that hold all words come first to hand. A request without any is read again, each
    word as the nearest term within its budget of edits (if there is one), and its rows score as
    corrected ones. ``queries`` has ``query``; ``names`` has ``id, name, km, prominence``, both
    texts in normal form. A request that still finds nothing has no row.
    """
    terms = index_terms(names, "id", "name")
    exact = all_words(queries.select("query").distinct(), terms)
    rest = queries.select("query").distinct().join(exact.select("query").distinct(), "query", "left_anti")
    each = rest.select("query", F.posexplode(fn.words(F.col("query"))).alias("place", "word"))
    fix = corrections(each.select(F.col("word").alias("query")).distinct(), lexicon(terms), 1)
    fixed = each.join(fix.select(F.col("query").alias("word"), "term", "edits"), "word", "left")
    read = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("term", "word").alias("w")))), lambda x: x["w"]), " ")
    fixed = fixed.groupBy("query").agg(read.alias("read_as"), F.sum(F.coalesce("edits", F.lit(0))).alias("edits"))
    again = all_words(fixed.select(F.col("read_as").alias("query")).distinct(), terms).withColumnRenamed("query", "read_as")
    again = again.join(fixed, "read_as").select("query", "id", "read_as", "edits", F.lit("fuzzy").alias("kind"))
    hits = exact.select("query", "id", F.col("query").alias("read_as"), F.lit(0).cast("long").alias("edits"), F.lit(None).cast("string").alias("kind"))
    hits = hits.unionByName(again).join(names.hint("merge"), "id")
    kind = F.coalesce("kind", tier(F.col("query"), F.col("name")))
    hits = hits.withColumn("score", score(kind, F.col("edits"), F.col("km"), F.col("prominence")))
    return ranked(hits, "query", limit).select("query", "id", "read_as", "score", "rank")
