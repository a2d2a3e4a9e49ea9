"""Spelling variants: pairs of words one edit apart, by merging light subtrees of a trie.

The words stand in a trie. Of each node's children the one with the most words is heavy; the
others, and a word that ends at the node, are light. Two words that differ by one edit part at
a node, and one of them leaves it by a light child. So only light subtrees are merged into what
else hangs at the node, the small into the large: their words with the next character skipped,
replaced by the heavy one, or preceded by it meet the node's words, and with that character
replaced by any they meet each other. Terminals that coincide are pairs one edit apart. Each
pair is found at one node and by one of these merges, and a word is merged once for each
light edge above it, at most log2 of the number of words: the work does not grow with the
square of the length of words, as that of a table of all deletions would.

Words are dealt to tasks by ranges in their order, so the subtree of a node is within one task
but for the nodes above the borders of ranges. Words of those nodes' subtrees are counted by
task first, which tells the heavy children, and their errata meet in a join.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import discard, materialize
from ._vectors import groups_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of letters of lower-cased texts.
RUN = "[a-zÀ-ÿ]+"
#: Of so many (document, run) one loses a character.
ONE_OF = 97
#: Words of a task, on average.
TASK_WORDS = 200_000
#: Characters of pairs and errata that a task gives at once.
GIVEN = 4 << 20
#: Stands for any character in errata; no word holds it.
ANY = "\0"
MERGED = "a string, an long, b string, bn long, key string"


def words(docs: DataFrame, least_length: int = 5, least_count: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: runs of letters of all texts after the deletions, with their occurrences.

    A run is a maximal one of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased. Where the crc32 of
    ``<doc_id>:<run>`` is a multiple of ``ONE_OF``, its character at that crc32 modulo its length
    goes. A null text has no run, and a null id counts as empty.
    """
    runs = F.regexp_extract_all(F.translate(text_col, UPPER, LOWER), F.lit(RUN), F.lit(0))
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    each = each.where(F.length("run") >= least_length)
    h = F.crc32(F.concat("doc", F.lit(":"), "run"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % ONE_OF == 0, cut).otherwise(F.col("run"))
    counted = each.withColumn("h", h).select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.col("n") >= least_count) & (F.length("word") >= least_length))


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] is common, a[:high] is not
    while high - low > 1:
        at = (low + high) // 2
        low, high = (at, high) if a[low:at] == b[low:at] else (low, at)
    return low


def _end(words: list[str], prefix: str, low: int, high: int) -> int:
    """Where the words with ``prefix``, the first ones of a slice, end."""
    while low < high:
        at = (low + high) // 2
        low, high = (at + 1, high) if words[at].startswith(prefix) else (low, at)
    return low


def _children(words: list[str], depth: int, start: int, end: int) -> list[tuple[str, int, int]]:
    """Children of a node over a slice: their character (empty: the word that ends there) and slices."""
    found = []
    while start < end:
        first = words[start]
        stop = start + 1 if len(first) == depth else _end(words, first[: depth + 1], start, end)
        found.append((first[depth : depth + 1], start, stop))
        start = stop
    return found


class Borders:
    """Ranges of words by their first and last ones (``part, first, last``), and the trie nodes above several."""

    def __init__(self, ends: list[tuple[int, str, str]]):
        ends = sorted(ends, key=lambda e: e[1])
        self.at = {part: k for k, (part, _, _) in enumerate(ends)}
        self.whole = [common_prefix(first, last) for _, first, last in ends]
        #: Length of the prefix that the words on both sides of the border after a range share; -1 after the last.
        self.shared = [common_prefix(a[2], b[1]) for a, b in zip(ends, ends[1:])] + [-1]

    def spans(self, k: int) -> tuple[int, int]:
        """Depths down to which the first, and the last, word of a range hangs below a node above another range."""
        return self.shared[k - 1] if k else -1, self.shared[k]

    def node(self, border: int, depth: int) -> tuple[int, int]:
        """A node's name: the first border that the node of this depth above ``border`` lies above, and the depth."""
        while border and self.shared[border - 1] >= depth and self.whole[border] >= depth:
            border -= 1
        return border, depth

    def nodes(self, k: int, words: list[str]) -> Iterator[tuple[tuple[int, int], list[tuple[str, int, int]]]]:
        """Nodes above a range and another one: their name and their children within the range."""
        before, after = self.spans(k)
        n = len(words)
        left = [-common_prefix(words[0], w) for w in words]
        right = [common_prefix(words[-1], w) for w in words]
        for d in range(before + 1):
            end, inner = bisect_left(left, 1 - d), bisect_left(left, -d)
            child = [(words[0][d], 0, inner)] if inner else []
            yield self.node(k - 1, d), child + _children(words, d, inner, end)
        for d in range(after + 1):
            if d <= before and d <= self.whole[k]:
                continue  # the same node as above
            start, inner = bisect_left(right, d), bisect_left(right, d + 1)
            child = [(words[-1][d], inner, n)] if inner < n else []
            yield self.node(k, d), _children(words, d, start, inner) + child


def _inner(words: list[str]) -> Iterator[tuple[int, list[int]]]:
    """Branching nodes of the trie of sorted words: depth, starts of the children and the end."""
    stack: list[tuple[int, list[int]]] = []
    for i in range(1, len(words) + 1):
        depth = common_prefix(words[i - 1], words[i]) if i < len(words) else -1
        start = i - 1
        while stack and stack[-1][0] > depth:
            d, starts = stack.pop()
            yield d, [*starts, i]
            start = starts[0]
        if depth >= 0:
            if not stack or stack[-1][0] < depth:
                stack.append((depth, [start]))
            stack[-1][1].append(i)


def _errata(word: str, depth: int, heavy: str) -> Iterator[str]:
    """What a word that leaves a node of this depth by a light child, or ends there, is merged as.

    Those with ``ANY`` meet each other, the others meet words.
    """
    head, gone, tail = word[:depth], word[depth : depth + 1], word[depth + 1 :]
    if gone:
        if not tail.startswith(gone):  # else the words part further down
            yield head + tail
        yield head + heavy + tail
        yield head + ANY + tail
    yield head + heavy + gone + tail


def _light(children: list[tuple[str, int, int]], heavy: str) -> Iterator[int]:
    """The words below light children, and one that ends at the node."""
    for char, start, end in children:
        if char != heavy:
            yield from range(start, end)


def _counted(borders: Borders):
    """Words of each range below each child of the nodes above borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in groups_of(batches, "part"):
            words = t.column("word").to_pylist()
            rows = [(*node, c, end - start) for node, children in borders.nodes(borders.at[part], words) for c, start, end in children]
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["border", "depth", "char", "n"])

    return run


def _merged(borders: Borders, heavy: dict[tuple[int, int], str]):
    """Pairs that part below the borders, each once (``key`` null), and errata of nodes above borders (``b`` null)."""

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["a", "an", "b", "bn", "key"])

    def found(k: int, words: list[str], n: list[int]) -> Iterator[tuple]:
        for node, children in borders.nodes(k, words):
            if h := heavy.get(node):  # none where it does not branch
                for x in _light(children, h):
                    for e in _errata(words[x], node[1], h):
                        yield words[x], n[x], None, None, e
        index = {w: y for y, w in enumerate(words)}
        before, after = borders.spans(k)
        for d, starts in _inner(words):
            if starts[0] == 0 and d <= before or starts[-1] == len(words) and d <= after:
                continue  # above a border, so done
            children = [(words[i][d : d + 1], i, j) for i, j in zip(starts, starts[1:])]
            h = min((i - j, c) for c, i, j in children if c)[1]
            met: dict[str, list[int]] = {}
            for x in _light(children, h):
                for e in _errata(words[x], d, h):
                    if ANY in e:
                        others = met.setdefault(e, [])
                        yield from ((words[x], n[x], words[y], n[y], None) for y in others)
                        others.append(x)
                    elif (y := index.get(e)) is not None:
                        yield words[x], n[x], words[y], n[y], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in groups_of(batches, "part"):
            rows: list[tuple] = []
            size = 0
            for row in found(borders.at[part], t.column("word").to_pylist(), t.column("n").to_pylist()):
                rows.append(row)
                size += len(row[0]) + 32
                if size > GIVEN:
                    yield table(rows)
                    rows, size = [], 0
            yield table(rows)

    return run


def one_edit_pairs(counted: DataFrame, task_words: int = TASK_WORDS) -> DataFrame:
    """``a, an, b, bn``: each two words of ``counted`` (distinct ``word``, with ``n``) one edit apart, once.

    An edit inserts, deletes or replaces one character (code point).
    """
    tasks = max(1, math.ceil(counted.count() / task_words))
    # Ranges are sampled and need not repeat themselves, so they are written once.
    dealt = materialize(counted.select("word", "n").repartitionByRange(tasks, "word").withColumn("part", F.spark_partition_id()))
    # One row for each task, and one for each branching node above a border, come to the driver.
    ends = dealt.groupBy("part").agg(F.min("word").alias("first"), F.max("word").alias("last")).collect()
    borders = Borders([(e.part, e.first, e.last) for e in ends])
    ranges = dealt.repartition(tasks, "part").sortWithinPartitions("part", "word")
    heavy: dict[tuple[int, int], str] = {}
    if len(ends) > 1:
        below = ranges.mapInArrow(_counted(borders), "border int, depth int, char string, n long")
        below = below.groupBy("border", "depth", "char").agg(F.sum("n").alias("n"))
        most = F.max_by("char", F.when(F.col("char") != "", F.struct("n", "char")))
        branching = below.groupBy("border", "depth").agg(most.alias("char"), F.count("*").alias("children")).where("children > 1")
        heavy = {(r.border, r.depth): r.char for r in branching.collect()}
    made = materialize(ranges.mapInArrow(_merged(borders, heavy), MERGED))
    pairs = made.where("key is null").select("a", "an", "b", "bn")
    errata = made.where("key is not null").select("key", "a", "an")
    wild = F.contains("key", F.lit(ANY))
    exact = errata.where(~wild).join(dealt.select(F.col("word").alias("key"), F.col("n").alias("bn")), "key")
    # Of a node and rest of a word there is one erratum for each letter at most.
    met = errata.where(wild).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("a", "an"))).alias("all")).where(F.size("all") > 1)
    each = met.select("all", F.posexplode("all").alias("at", "x"))
    each = each.select("x.*", F.explode(F.slice("all", F.col("at") + 2, F.size("all"))).alias("y"))
    return (
        pairs.unionByName(exact.select("a", "an", F.col("key").alias("b"), "bn"))
        .unionByName(each.select("a", "an", F.col("y.a").alias("b"), F.col("y.an").alias("bn")))
    )


def variants(counted: DataFrame, task_words: int = TASK_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``counted`` (``word, n``).

    ``n_near`` is the number of words one edit away, and ``form`` that of them with the largest
    ``n`` (the smallest in code-point order of equals) where this is at least twice the word's
    own; ``root`` is the end of the chain of forms. As ``n`` doubles with each form, a chain has
    at most 62 of them, and six rounds that double the steps see its end. Words are distinct
    and not null; of any length. An empty table gives an empty result.
    """
    counted = materialize(counted.select("word", "n"))
    pairs = one_edit_pairs(counted, task_words)
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), "b", "bn"), F.struct(F.col("b").alias("word"), F.col("a").alias("b"), F.col("an").alias("bn"))))
    near = pairs.select(both.alias("p")).select("p.*")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min_by(F.struct("b", "bn"), F.struct(-F.col("bn"), F.col("b"))).alias("best"))
    is_form = F.col("best.bn") >= 2 * F.col("n")
    rows = counted.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.b")).alias("form"), F.when(is_form, F.col("best.bn")).alias("form_n"),
    )
    rows = materialize(rows)
    at = rows.where("form is not null").select("word", F.col("form").alias("root"))
    for n in range(6):
        up = at.select(F.col("word").alias("root"), F.col("root").alias("above"))
        further = materialize(at.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("went")))
        if n:
            discard(before)
        before, at = further, further.select("word", "root")
        if further.where("went").isEmpty():
            break
    return rows.join(at, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
