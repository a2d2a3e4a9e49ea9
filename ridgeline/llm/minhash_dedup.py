"""MinHash near-duplicates: SuperMinHash, banding, verification, union-find grouping.

1. Every text becomes its set of distinct five-word shingles (64-bit hashes), a
   SuperMinHash signature and a key of the set. Rows of equal sets form one class;
   everything after works on classes.
2. Signatures are cut into bands; classes that share a band key meet in a bucket.
3. Each bucket's first class leads it: the others are compared with their leaders alone, by
   sizes and signatures first. Only texts of pairs that pass travel, and are tested on the full
   sets. Confirmed links are grouped by union-find. A family of copies, however large, is
   mostly settled here, and each of its texts has travelled once or a few times.
4. What is left are buckets of more than one group. There the largest group is closed, and
   only the open classes meet all others: by signatures first, then, in families of groups
   that have similar signatures, on the full sets. Open classes and all classes are split into
   blocks, and a pair of blocks is one unit of work.
5. Components of all confirmed links, named by the smallest id, go back to all rows.

Bands are chosen so that a pair just at the threshold is missed about once in 10**5 times
or less often; pairs are tested from 4.5 standard deviations below the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._components import Forest, connected_components
from ._store import discard, give_back, materialize, pieces, unused
from ._superminhash import signatures, similarity
from ._text import common, set_key, shingle_sets

SLOTS = 252
#: Most members of a unit of work: of a leader's block, open ones, and all ones; and its shingles.
LED, OPEN, ALL, SHINGLES = 256, 128, 512, 1_000_000


def band_rows(percent: int) -> int:
    """Rows of a band: the most of 4, 6, 7, 9 that keep a pair at the threshold."""
    j = percent / 100
    fit = [r for r in (4, 6, 7, 9) if (1 - j**r) ** (SLOTS // r) <= 1e-5]
    return max(fit, default=3)


def least_estimate(percent: int) -> float:
    j = percent / 100
    return j - 4.5 * math.sqrt(j * (1 - j) / SLOTS)


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            texts = [(t or "").encode() for t in b.column("text").to_pylist()]
            sets = shingle_sets(texts, width)
            keys = [set_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([k[0] for k in keys], pa.int64()),
                    pa.array([k[1] for k in keys], pa.int64()),
                    pa.array([r.tobytes() for r in signatures(sets, SLOTS)], pa.binary()),
                ],
                ["doc_id", "n_shingles", "k1", "k2", "sig"],
            )

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows that arrive sorted by ``keys``; a few complete groups at a time."""
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        if not held.num_rows:
            continue
        last = np.zeros(held.num_rows, bool)
        for k in keys:
            col = held.column(k).to_numpy()
            last |= col != col[-1]
        n = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if n:
            yield held.slice(0, n)
            held = held.slice(n)
    if held is not None and held.num_rows:
        yield held
    del held
    give_back()


def _spans(t: pa.Table, keys: list[str]) -> list[tuple[int, int]]:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        col = t.column(k).to_numpy()
        new[1:] |= col[1:] != col[:-1]
    at = np.flatnonzero(new)
    return list(zip(at.tolist(), [*at[1:].tolist(), t.num_rows]))


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())],
        ["a", "b"],
    )


def _verified(t: pa.Table, rows: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """The row number and shingle set of those ``rows`` whose text is of the class they stand for.

    Rows of one id may hold several texts, and all come with it.
    """
    text, k1, k2 = (t.column(c) for c in ("text", "k1", "k2"))
    for k in range(0, len(rows), 32):
        some = rows[k : k + 32].tolist()
        for n, s in zip(some, shingle_sets([(text[n].as_py() or "").encode() for n in some], width)):
            if set_key(s) == (k1[n].as_py(), k2[n].as_py()):
                yield n, s


def _signatures(t: pa.Table | pa.RecordBatch, column: str = "sig") -> np.ndarray:
    return np.frombuffer(b"".join(t.column(column).to_pylist()), np.uint8).reshape(-1, SLOTS)


def _similar(least: float):
    """Pairs of a leader and a member whose signatures may be of a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = similarity(_signatures(b), _signatures(b, "lead_sig")) >= least
                yield b.select(["lead", "node"]).filter(pa.array(near))

    return run


def _led(percent: int, width: int):
    """Links of each leader to members of its block that hold on the full sets."""
    keys = ["lead", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, keys):
            found: list[tuple[int, int]] = []
            for i, j in _spans(table, keys):
                t = table.slice(i, j - i)
                node, lead = t.column("node").to_numpy(), t.column("lead")[0].as_py()
                _, first = next(_verified(t, np.flatnonzero(node == lead), width))
                for n, other in _verified(t, np.flatnonzero(node != lead), width):
                    both = common(first, other)
                    if 100 * both >= percent * (len(first) + len(other) - both):
                        found.append((lead, int(node[n])))
            yield _edges(found)

    return run


def _unit(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, Forest]:
    """Nodes of a unit, the rows of its open side, those of all, and the groups they have."""
    node, group, left = t.column("node").to_numpy(), t.column("label").to_numpy(), t.column("left").to_numpy(zero_copy_only=False)
    forest = Forest(len(node))
    _, first, which = np.unique(group, return_index=True, return_inverse=True)
    for n, f in enumerate(first[which].tolist()):
        forest.union(n, f)
    return node, np.flatnonzero(left), np.flatnonzero(~left), forest


def _alike(least: float):
    """Of each unit of a bucket, a forest over its groups of classes with similar signatures."""
    keys = ["bucket", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, keys):
            found: list[tuple[int, int]] = []
            for i, j in _spans(table, keys):
                t = table.slice(i, j - i)
                node, left, right, forest = _unit(t)
                label = t.column("label").to_numpy()
                sig = _signatures(t)
                for x in left.tolist():
                    near = right[similarity(sig[right], sig[x]) >= least]
                    found += [(int(label[x]), int(label[y])) for y in near.tolist() if forest.union(x, y)]
            yield _edges(found)

    return run


def _tested(percent: int, width: int, least: float):
    """Of each unit of a family, a forest of links that hold on the full sets, most similar first."""
    keys = ["family", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, keys):
            found: list[tuple[int, int]] = []
            for i, j in _spans(table, keys):
                t = table.slice(i, j - i)
                node, left, right, forest = _unit(t)
                size, label, sig = t.column("n_shingles").to_numpy(), t.column("label").to_numpy(), _signatures(t)
                sets = dict(_verified(t, np.arange(len(node)), width))
                left, right = (x[np.isin(x, list(sets))] for x in (left, right))
                xs, ys, es = [], [], []
                for x in left.tolist():
                    near = similarity(sig[right], sig[x])
                    ok = (near >= least) & (label[right] != label[x])
                    ok &= 100 * np.minimum(size[right], size[x]) >= percent * np.maximum(size[right], size[x])
                    y = right[ok]
                    xs.append(np.full(len(y), x)), ys.append(y), es.append(near[ok])
                x, y, e = (np.concatenate(c) if c else np.zeros(0, int) for c in (xs, ys, es))
                for n in np.argsort(-e, kind="stable").tolist():
                    p, q = int(x[n]), int(y[n])
                    if forest.find(p) == forest.find(q):
                        continue
                    both = common(sets[p], sets[q])
                    if 100 * both >= percent * (int(size[p]) + int(size[q]) - both):
                        forest.union(p, q)
                        found.append((int(label[p]), int(label[q])))
            yield _edges(found)

    return run


def _units(members: DataFrame, by: str, heavy: bool = False) -> DataFrame:
    """Members (``by, node, label, ...``) of groups with more than one label, dealt to units ``i, j``.

    The largest label of a group is closed. Open members, as the left side, are in blocks
    ``i`` and meet every block ``j`` of all members. ``heavy`` also bounds shingles of a unit.
    """
    weight = F.sum("n_shingles") if heavy else F.lit(0)
    counts = materialize(members.groupBy(by, "label").agg(F.count("*").alias("n"), weight.alias("w")))
    total = counts.groupBy(by).agg(
        F.max_by("label", F.struct("n", "label")).alias("closed"), F.count("*").alias("labels"),
        F.sum("n").alias("all"), F.max("n").alias("most"), F.sum("w").alias("w"), F.max_by("w", F.struct("n", "label")).alias("wc"),
    ).where("labels > 1")
    count = lambda n, most, w: F.greatest(F.ceil(n / most), F.ceil(w / SHINGLES)).cast("int")
    opened = count(F.col("all") - F.col("most"), OPEN, F.col("w") - F.col("wc"))
    plan = materialize(total.select(by, "closed", opened.alias("ni"), count(F.col("all"), ALL, F.col("w")).alias("nj")))
    hot = F.pmod(F.xxhash64("node"), F.col("nj")).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.col("ni")).cast("int")
    met = members.join(plan, by)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = met.withColumns({"left": F.lit(False), "j": hot}).withColumn("i", every("ni"))
    left = met.where("label <> closed").withColumns({"left": F.lit(True), "i": own}).withColumn("j", every("nj"))
    return right.unionByName(left.select(*right.columns)).drop("closed", "ni", "nj")


def _dealt(star: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lead, block, node``: members dealt to blocks of about ``LED`` of their leader, and the leader once a block."""
    blocks = materialize(star.groupBy("lead").agg(F.ceil(F.count("*") / LED).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    led = star.join(blocks, "lead").select("lead", block.alias("block"), "node")
    leaders = blocks.select("lead", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("lead").alias("node"))
    return led, leaders


def _labelled(df: DataFrame, label: DataFrame) -> DataFrame:
    """Adds ``label`` to rows with ``node``; a node without a link is its own."""
    return df.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _grouped(docs: DataFrame, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` (``doc_id, text``) with the key of their class, and the groups of the classes.

    The second table has ``n_shingles, k1, k2``, the group's smallest id ``component``, and
    ``first``, which is true for one class of each group that holds this id.
    """
    spark = docs.sparkSession
    least, rows = least_estimate(percent), band_rows(percent)
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = materialize(docs.mapInArrow(_signed(width), "doc_id long, n_shingles long, k1 long, k2 long, sig binary"))
    classes = materialize(
        signed.where("n_shingles > 0 and doc_id is not null")
        .groupBy("n_shingles", "k1", "k2")
        .agg(F.min("doc_id").alias("rep"), F.max("sig").alias("sig"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(SLOTS // rows - 1)),
        lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * rows + 1, F.lit(rows))),
    )
    banded = classes.select("node", F.explode(bands).alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("members"), F.min("node").alias("lead")).where("members > 1")
    met = materialize(banded.join(buckets, "bucket").select("bucket", "node", "lead"))
    whole = classes.select("node", "rep", "n_shingles", "k1", "k2", "sig")
    once = docs.withColumnRenamed("doc_id", "rep")
    if not signed.groupBy("doc_id").count().where("count > 1").isEmpty():
        once = once.dropDuplicates()

    def read(rows: DataFrame) -> DataFrame:
        return rows.join(whole, "node").join(once, "rep")

    # Sizes and signatures tell which members are worth reading beside their leader.
    star = materialize(met.where("node <> lead").select("lead", "node").distinct())
    led, leaders = _dealt(star)
    slim = classes.select("node", "n_shingles", "sig")
    first = leaders.join(slim, "node").select("lead", "block", F.col("n_shingles").alias("lead_n"), F.col("sig").alias("lead_sig"))
    pairs = led.join(slim, "node").join(first, ["lead", "block"])
    fit = 100 * F.least("n_shingles", "lead_n") >= percent * F.greatest("n_shingles", "lead_n")
    near = materialize(pairs.where(fit).select("lead", "node", "sig", "lead_sig").mapInArrow(_similar(least), "lead long, node long"))
    led, leaders = _dealt(near)
    linked = materialize(
        read(led.unionByName(leaders))
        .select("lead", "block", "node", "k1", "k2", "text")
        .repartition(number, "lead", "block")
        .sortWithinPartitions("lead", "block", "node")
        .mapInArrow(_led(percent, width), "a long, b long")
    )
    label = connected_components(linked).withColumnRenamed("component", "label")

    # Buckets of several groups: which groups may belong together, by signatures.
    units = _units(_labelled(met.select("bucket", "node"), label), "bucket").join(classes.select("node", "sig"), "node")
    alike = (
        units.select("bucket", "i", "j", "node", "label", "left", "sig")
        .repartition(number, "bucket", "i", "j")
        .sortWithinPartitions("bucket", "i", "j", "node")
        .mapInArrow(_alike(least), "a long, b long")
    )
    family = connected_components(alike).select(F.col("node").alias("label"), F.col("component").alias("family"))
    members = materialize(_labelled(whole.drop("sig"), label).join(family, "label"))
    units = read(_units(members.select("family", "node", "label", "n_shingles"), "family", True).drop("n_shingles"))
    tested = (
        units.select("family", "i", "j", "node", "label", "left", "n_shingles", "k1", "k2", "sig", "text")
        .repartition(number, "family", "i", "j")
        .sortWithinPartitions("family", "i", "j", "node")
        .mapInArrow(_tested(percent, width, least), "a long, b long")
    )
    joined = connected_components(tested).select(F.col("node").alias("label"), F.col("component").alias("above"))
    group = _labelled(whole.drop("sig"), label).join(joined, "label", "left").withColumn("label", F.coalesce("above", "label"))
    group = materialize(group.select("n_shingles", "k1", "k2", "rep", "node", "label"))
    names = group.groupBy("label").agg(F.min(F.struct("rep", "node")).alias("name"))
    named = group.join(names, "label").select(
        "n_shingles", "k1", "k2", F.col("name.rep").alias("component"), (F.col("name.node") == F.col("node")).alias("first")
    )
    named = materialize(named)
    discard(star, near, linked, members, group, met, classes)
    return signed, named


def near_duplicates(
    docs: DataFrame, percent: int = 85, width: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Two rows link where their shingle sets have a Jaccard similarity of ``percent`` in 100
    or more; ``component_id`` is the smallest id reachable by links. Null and blank texts
    have no shingle and link with nothing. A null id links with nothing and its row is kept,
    with a null component. Rows of one id are documents of their own, each returned, which
    link by their texts only. Texts of any length are read whole; a task holds the shingles of
    one text and of one unit of work (about a million) at a time. An empty table gives an
    empty result; other columns, of any name, are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed, named = _grouped(docs, percent, width)
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return (
        signed.drop("sig")
        .join(named, ["n_shingles", "k1", "k2"], "left")
        .select("doc_id", "n_shingles", own.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def keep_one(
    docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with one row of each group of near copies, with all its columns.

    A row of the group's smallest id stays. Blank texts and rows of a null id all stay. Rows of
    one id whose texts are no near copies of each other are documents of their own, so each of
    them that leads a group stays; of rows of one id and equal shingles, the one of the
    smallest columns (as text) stays. An empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed, named = _grouped(slim, percent, width)
    rows = signed.drop("sig").where("doc_id is not null").join(named, ["n_shingles", "k1", "k2"], "left")
    stays = F.coalesce(F.col("first") & (F.col("doc_id") == F.col("component")), F.lit(True))
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or(stays).alias("kept"))
    name = {c: unused(docs, c) for c in ("odd", "n", "k1", "k2", "nth")}
    odd = materialize(ids.where("n > 1 or not kept").select(F.col("doc_id").alias(name["odd"]), "n", "kept"))
    # Only rows of a repeated id need to meet, so texts of the others stay where they are.
    same = F.col(id_col).cast("long") == F.col(name["odd"])
    plain = docs.join(odd, same, "left_anti")
    repeated = docs.join(odd.where("kept and n > 1").select(name["odd"]), same)
    keyed = repeated.mapInArrow(_keyed(text_col, width, [name[c] for c in ("n", "k1", "k2")]), _with_keys(repeated, name))
    lead = rows.where(stays).join(odd.where("n > 1"), F.col("doc_id") == F.col(name["odd"]), "left_semi")
    lead = lead.select(F.col("doc_id").alias(name["odd"]), *(F.col(c).alias(name[k]) for k, c in (("n", "n_shingles"), ("k1", "k1"), ("k2", "k2"))))
    key = [name[c] for c in ("odd", "n", "k1", "k2")]
    met = keyed.join(lead.distinct(), key, "left_semi")
    order = Window.partitionBy(*key).orderBy(*(F.col(f"`{c}`").cast("string") for c in docs.columns))
    # All blank rows stay; of other classes one row does.
    nth = F.when(F.col(name["n"]) == 0, F.lit(1)).otherwise(F.row_number().over(order))
    one = met.withColumn(name["nth"], nth).where(F.col(name["nth"]) == 1)
    return plain.unionByName(one.select(*(F.col(f"`{c}`") for c in docs.columns)))


def _with_keys(df: DataFrame, name: dict[str, str]) -> StructType:
    more = [StructField(name[c], LongType()) for c in ("n", "k1", "k2")]
    return StructType([*df.schema.fields, *more])


def _keyed(text_col: str, width: int, names: list[str]):
    """The key of the class of each row beside its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text_col):
            sets = shingle_sets([(t or "").encode() for t in b.column(text_col).to_pylist()], width)
            keys = [(len(s), *set_key(s)) for s in sets]
            for n, c in enumerate(names):
                b = b.append_column(c, pa.array([k[n] for k in keys], pa.int64()))
            yield b

    return run
