"""URL filtering by association rules that FP-growth mines from labelled pages.

A URL becomes a set of tokens: labels of its host with their place, path segments with
their place (numbers as one token), names of query fields, a file suffix and a fragment
mark. FP-growth mines the frequent sets among labelled URLs together with the block label;
sets whose share of blocked URLs is high become rules. A rule goes where leaving out one of
its tokens loses no confidence. Tokens that the labelled URLs hold always together are one
item of the mining, since their sets would double with each of them; a rule asks for any one
of them, which is what all those sets as rules would. Rules match through an inverted index:
each is filed under its rarest item, so common tokens lead to few rules, and is then tested
whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize

#: The given rules as (verdict, host, path).
GIVEN = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Item that stands for the block label in a transaction; no token begins like it.
BLOCK = "!block"
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE = 0.002, 5, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host_col: Column, path_col: Column, rules=GIVEN) -> tuple[Column, Column]:
    """The longest fitting rule as ``host`` + ``path``, and its verdict; nulls where none fits."""
    name = verdict = F.lit(None).cast("string")
    # From short to long, so that the longest is tested first.
    for say, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, say).otherwise(verdict)
    return name, verdict


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL; none for a null URL or one without ``://``."""
    labels = F.reverse(F.split(host(url), r"\."))
    steps = F.split(F.regexp_replace(path(url), "^/", ""), "/")
    query = F.regexp_extract_all(F.regexp_extract(url, r"^[^#?]*\?([^#]*)", 1), F.lit(r"([^=&]+)(?:=[^&]*)?"), F.lit(1))
    parts = F.concat(
        F.transform(labels, lambda x, i: F.concat(F.lit("h"), i, F.lit(":"), x)),
        F.transform(steps, lambda x, i: F.concat(F.lit("p"), i, F.lit(":"), F.regexp_replace(x, "[0-9]+", "#"))),
        F.transform(query, lambda x: F.concat(F.lit("q:"), x)),
        F.array(F.when(url.contains("#"), "fragment")),
    )
    used = F.filter(parts, lambda x: x.isNotNull() & ~x.endswith(":"))
    return F.when(url.contains("://"), F.array_distinct(used)).otherwise(F.array().cast("array<string>"))


def mine(
    labelled: DataFrame,
    url_col: str = "url",
    block_col: str = "block",
    min_support: float = MIN_SUPPORT,
    min_count: int = MIN_COUNT,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """Rules ``rule, tokens, same, support, confidence`` from URLs with a boolean label.

    ``support`` counts the blocked URLs that hold all tokens; ``confidence`` is their share
    of all URLs that do. ``same`` has for each token all those that come always with it. Rows
    with a null URL or label, and URLs without tokens, teach nothing; repeated rows count
    each. No labelled row, or none blocked, gives no rule. Sets still double with tokens that
    hold each other in a chain of falling counts, such as the directories of one deep path
    that branches at every step.
    """
    spark = labelled.sparkSession
    rows = labelled.select(tokens(F.col(url_col)).alias("tokens"), F.col(block_col).alias("block"))
    rows = rows.where(F.col("block").isNotNull() & (F.size("tokens") > 0))
    rows = materialize(rows.withColumn("n", F.monotonically_increasing_id()))
    n = rows.count()
    empty = spark.createDataFrame([], "rule string, tokens array<string>, same array<array<string>>, support long, confidence double")
    if not n:
        return empty
    least = max(min_support * n, min_count)
    each = rows.select("n", "block", F.explode("tokens").alias("token"))
    # Two sums over the rows of a token tell sets of rows apart. Frequent tokens are at most
    # the tokens of a URL over the support, so Spark may broadcast them.
    held = each.groupBy("token").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("n")).alias("x"), F.bit_xor(F.xxhash64("n", F.lit(7))).alias("y"))
    same = held.where(F.col("c") >= least).groupBy("c", "x", "y").agg(F.array_sort(F.collect_list("token")).alias("same"))
    same = materialize(same.select(F.col("same")[0].alias("item"), "same"))
    known = same.select("item", F.explode("same").alias("token"))
    items = each.join(known, "token").groupBy("n", "block").agg(F.collect_set("item").alias("items"))
    items = materialize(items.select(F.when(F.col("block"), F.concat("items", F.array(F.lit(BLOCK)))).otherwise(F.col("items")).alias("items")))
    number = items.count()
    if not number:
        return empty
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / number), minConfidence=min_confidence).fit(items)
    sets = materialize(model.freqItemsets.select(F.array_sort("items").alias("tokens"), F.col("freq").cast("long").alias("freq")))
    blocked = sets.where(F.array_contains("tokens", BLOCK) & (F.size("tokens") > 1)).select(
        F.array_remove("tokens", BLOCK).alias("tokens"), F.col("freq").alias("support")
    )
    share = F.col("support") / F.col("freq")
    rules = materialize(
        blocked.where(F.col("support") >= min_count)
        .join(sets, "tokens")
        .withColumn("confidence", share)
        .where(F.col("confidence") >= min_confidence)
        .select(F.array_join("tokens", " ").alias("rule"), "tokens", "support", "confidence")
    )
    # A rule with one token less and the same confidence or more makes it redundant.
    wider = rules.select("rule", "confidence", F.explode("tokens").alias("one"), "tokens").select(
        F.col("rule").alias("narrow"), "confidence", F.array_join(F.array_remove("tokens", F.col("one")), " ").alias("rule")
    )
    known = rules.select("rule", F.col("confidence").alias("wide"))
    redundant = wider.join(known, "rule").where("wide >= confidence").select(F.col("narrow").alias("rule"))
    kept = materialize(rules.join(redundant, "rule", "left_anti"))
    named = kept.select("rule", F.posexplode("tokens").alias("nth", "item")).join(same, "item").groupBy("rule")
    named = named.agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "same"))), lambda x: x["same"]).alias("same"))
    return materialize(kept.join(named, "rule").select("rule", "tokens", "same", "support", "confidence"))


def match(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``url, mined_rule, confidence`` of each distinct URL that a mined rule fits.

    The rule of highest confidence counts, then of highest support, then the smallest name.
    """
    used = rules.select("rule", F.posexplode("same").alias("nth", "any")).select("rule", "nth", "any", F.explode("any").alias("token"))
    # Rarity is measured over the URLs to match, for the few tokens that rules hold.
    told = urls.select(F.col(url_col).alias("url")).distinct().select("url", tokens(F.col("url")).alias("has"))
    seen = told.select(F.explode("has").alias("token")).join(used.select("token").distinct(), "token")
    seen = seen.groupBy("token").agg(F.count("*").alias("seen"))
    rarest = used.join(seen, "token", "left").groupBy("rule", "nth", "any").agg(F.sum(F.coalesce("seen", F.lit(0))).alias("seen"))
    rarest = rarest.groupBy("rule").agg(F.min_by("any", F.struct("seen", "nth")).alias("any"))
    index = materialize(rules.join(rarest, "rule").select(F.explode("any").alias("token"), "rule", "same", "support", "confidence"))
    # Rules are as many as supports allow; Spark broadcasts the written table only below its limit.
    hits = (
        told.select("url", "has", F.explode("has").alias("token"))
        .join(index, "token")
        .where(F.forall("same", lambda c: F.arrays_overlap(c, F.col("has"))))
    )
    best = F.min(F.struct(-F.col("confidence"), -F.col("support"), "rule")).alias("best")
    return hits.groupBy("url").agg(best).select("url", F.col("best.rule").alias("mined_rule"), (-F.col("best.col1")).alias("confidence"))


def judge(
    pages: DataFrame,
    labels: DataFrame,
    rules=GIVEN,
    id_col: str = "page_id",
    url_col: str = "url",
    **limits,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined_rule, confidence`` for every row of ``pages``.

    A given rule decides where one fits (the longest); else a fitting mined rule blocks, and
    every other row is allowed. ``labels`` has ``page_id, block`` (boolean; the largest of an
    id counts). A null URL, or one without ``://``, has empty host and path and is allowed.
    Repeated rows and null ids are judged like any other; an empty table gives an empty
    result; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    known = labels.where("page_id is not null and block is not null").groupBy("page_id").agg(F.max("block").alias("block"))
    mined = mine(rows.join(known, "page_id").select("url", "block"), **limits)
    hits = materialize(match(rows, mined))
    judged = rows.join(hits, "url", "left").withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    rule, verdict = given_rule(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "mined_rule", "confidence"
    )


def block_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``page_id, block``: low quality or toxic counts as block; one null among them as no."""
    flags = [F.coalesce(F.col("quality") == 0, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False))]
    told = F.col("quality").isNotNull() | F.col("toxic").isNotNull()
    return labels.where(told).select(F.col(id_col).cast("long").alias("page_id"), reduce(Column.__or__, flags).alias("block"))
