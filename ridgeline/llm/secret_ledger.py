"""Secret scans by an incremental blob ledger (native).

Every version of a text is addressed by its SHA-256. The ledger is a folder with the spans found
in each blob under each version of the rules; a folder beside it, of the same name and
``-paths``, has the blob of each path in every revision that was scanned. A run appends its paths, scans only
pairs of blob and rule version that the ledger lacks, each blob once however many paths hold
it, and joins the findings back to all paths. Runs at the same time may both scan a blob;
readers count its rows once.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize, unused

#: The kinds in their order, patterns, and the group and least length that count.
RULES = (
    (
        "assign",
        r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    # A maximal run of [A-Z0-9] or [0-9a-f] that is too short holds no match, so these two may
    # ask for the length at once.
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
SPANS = "array<struct<start:int,nth:int,kind:string,stop:int,first:int,last:int>>"
#: Items of an array that are walked together.
CHUNK = 256
#: Most addresses (of 64 bytes) that are broadcast.
FEW = 100_000


def rule_version(rules=RULES) -> str:
    """Names a set of rules by their contents, so that other rules never meet its findings."""
    return hashlib.sha256(repr(tuple(rules)).encode()).hexdigest()[:16]


def _walk(items: Column, zero: Column, none: Column, advance, emit) -> Column:
    """``emit(state, item)`` for each item, where ``advance`` makes the next state; not for empty arrays.

    Appending to an array copies it, so items are walked in chunks, and what is appended to
    stays short: the work grows with the items, not with their square.
    """
    numbers = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))
    chunks = F.transform(numbers, lambda n: F.slice(items, n * CHUNK + 1, F.lit(CHUNK)))
    states = F.aggregate(
        chunks,
        F.struct(zero.alias("at"), F.slice(F.array(zero), 1, 0).alias("all")),
        lambda acc, c: F.struct(
            F.aggregate(c, acc["at"], advance).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")
        ),
    )["all"]
    made = F.zip_with(
        chunks,
        states,
        lambda c, state: F.aggregate(
            c,
            F.struct(state.alias("at"), none.alias("out")),
            lambda acc, x: F.struct(advance(acc["at"], x).alias("at"), F.concat(acc["out"], emit(acc["at"], x)).alias("out")),
        )["out"],
    )
    return F.flatten(made)


def _spans(text: Column, nth: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of a rule's leftmost matches that do not overlap, in code points and in bytes.

    The pieces between the matches (``split``) and the matches give the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, b: F.struct(m.alias("m"), b.alias("b")))
    none = F.from_json(F.lit("[]"), SPANS)

    def advance(at: Column, x: Column) -> Column:
        return F.struct(
            (at["n"] + F.length(x["b"]) + F.length(x["m"])).alias("n"),
            (at["k"] + F.octet_length(x["b"]) + F.octet_length(x["m"])).alias("k"),
        )

    def emit(at: Column, x: Column) -> Column:
        start, first = at["n"] + F.length(x["b"]), at["k"] + F.octet_length(x["b"])
        span = F.struct(
            start.alias("start"), F.lit(nth).alias("nth"), F.lit(kind).alias("kind"), (start + F.length(x["m"])).alias("stop"),
            first.alias("first"), (first + F.octet_length(x["m"])).alias("last"),
        )
        return F.when(F.length(F.regexp_extract(x["m"], pattern, group)) >= least, F.array(span)).otherwise(none)

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"))
    return F.when(text.rlike(pattern), _walk(pairs, zero, none, advance, emit)).otherwise(none)


def find_spans(text: Column, rules=RULES) -> Column:
    """All spans of a text by start, then kind."""
    return F.array_sort(F.concat(*(_spans(text, n, *rule) for n, rule in enumerate(rules))))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, with commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def address(text_col: str) -> Column:
    return F.sha2(F.coalesce(text_col, F.lit("")).cast("binary"), 256)


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _paths(ledger: str) -> str:
    return f"{ledger.rstrip('/')}-paths"


def findings(spark, ledger: str, rules=RULES) -> DataFrame:
    """``blob, spans`` of all blobs with spans under these rules, one row each."""
    held = spark.read.parquet(ledger).where((F.col("version") == rule_version(rules)) & (F.size("spans") > 0))
    return held.groupBy("blob").agg(F.any_value("spans").alias("spans"))


def history(spark, ledger: str, rules=RULES) -> DataFrame:
    """``revision, doc_id, blob, spans``: what every path held in every revision that was scanned."""
    spans = F.coalesce("spans", F.from_json(F.lit("[]"), SPANS))
    paths = spark.read.schema("revision string, doc_id long, blob string").parquet(_paths(ledger))
    return paths.join(findings(spark, ledger, rules), "blob", "left").select("revision", "doc_id", "blob", spans.alias("spans"))


def update(docs: DataFrame, ledger: str, rules=RULES, text_col: str = "text") -> None:
    """Scan the blobs of ``docs`` that the ledger lacks under these rules, and append their findings.

    ``ledger`` is a folder that all executors share; it need not exist.
    """
    spark, version, few = docs.sparkSession, rule_version(rules), True
    blobs = docs.select(address(text_col).alias("blob"), F.coalesce(text_col, F.lit("")).alias("text"))
    if _exists(spark, ledger):
        seen = spark.read.parquet(ledger).where(F.col("version") == version).select("blob")
        # Addresses meet first. Where few are left, texts of the others do not travel.
        unseen = materialize(blobs.select("blob").distinct().join(seen, "blob", "left_anti"))
        few = unseen.count() <= FEW
        if few:
            blobs = blobs.join(F.broadcast(unseen), "blob", "left_semi")
    # Copies in a task become one row before they travel.
    new = blobs.groupBy("blob").agg(F.any_value("text").alias("text"))
    if not few:
        new = new.join(unseen, "blob", "left_semi")
    found = new.select("blob", F.lit(version).alias("version"), find_spans(F.col("text"), rules).alias("spans"))
    found.write.mode("append").parquet(ledger)


def scan(docs: DataFrame, ledger: str, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` (an array, by start and kind) for every row of ``docs``, as one revision.

    A null text counts as empty and has no span; repeated rows and rows of a null id each
    have their spans. Texts are scanned whole. An empty table gives an empty result; other
    columns, of any name, are ignored.
    """
    spark, revision = docs.sparkSession, uuid.uuid4().hex
    paths = docs.select(F.lit(revision).alias("revision"), F.col(id_col).cast("long").alias("doc_id"), address(text_col).alias("blob"))
    paths.write.mode("append").partitionBy("revision").parquet(_paths(ledger))
    update(docs, ledger, rules, text_col)
    return history(spark, ledger, rules).where(F.col("revision") == revision).select("doc_id", "spans")


def redact(docs: DataFrame, ledger: str, rules=RULES, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mark``; overlapping spans become one.

    All columns stay, of any name; a null text stays null. Repeated rows are each cleaned, and
    an empty table gives an empty result. Texts are cleaned whole, by places in their bytes.
    """
    update(docs, ledger, rules, text_col)
    blob, spans = unused(docs, "blob"), unused(docs, "spans")
    found = findings(docs.sparkSession, ledger, rules).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    text = F.col(f"`{text_col}`")
    # The text between the spans before and this one; null where they touch or overlap.
    piece = lambda at, s: F.struct(F.when(s["first"] > at, at).alias("from"), s["first"].alias("to"), (s["first"] >= at).alias("apart"))
    none = F.slice(F.array(piece(F.lit(0), F.element_at(spans, 1))), 1, 0)
    gaps = _walk(F.col(spans), F.lit(0), none, lambda at, s: F.greatest(at, s["last"]), lambda at, s: F.array(piece(at, s)))
    raw = text.cast("binary")
    cut = lambda a, n: F.substring(raw, a + 1, n).cast("string")
    before = F.transform(
        F.filter(gaps, lambda g: g["apart"]), lambda g: F.concat(F.coalesce(cut(g["from"], g["to"] - g["from"]), F.lit("")), F.lit(mark))
    )
    end = F.array_max(F.transform(spans, lambda s: s["last"]))
    clean = F.concat(F.array_join(before, ""), cut(end, F.octet_length(text)))
    rows = docs.withColumn(blob, address(text_col)).join(found, blob, "left")
    clean = F.when(F.col(spans).isNull(), text).otherwise(clean)
    return rows.select(*(clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
