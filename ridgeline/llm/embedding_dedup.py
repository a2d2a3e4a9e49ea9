"""Embedding near-duplicates by PCA-ordered tiled comparison.

Exact copies collapse to one node. The second-moment matrix of all unit vectors (summed in
tasks, a few small matrices reach the driver) gives the rotation into principal directions.
Vectors are put in order of a tree of balanced cuts and cut into tiles, and tiles into units;
pairs of units, and then of tiles, whose boxes in the leading directions lie too far apart
for the threshold are dropped. A pair of tiles multiplies the leading dimensions, adds the
product of the suffix lengths as the bound of the rest (Cauchy-Schwarz), and goes on to further
dimensions only with pairs that can still reach the threshold; survivors are tested on the
original vectors in double precision. It passes on link counts and a spanning forest, never the
pairs.

The boxes spare what the data's spread allows: well spread or clustered vectors meet few
others, and vectors without any structure meet all, which no exact method avoids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import connected_components
from ._store import give_back, materialize
from ._vectors import cosine, matrix, unit, usable, width
from .vector_graph import LEAVES, SAMPLE, SAMPLE_BYTES, fit_tree

#: Vectors of a tile, most tiles of a unit, and leading directions of a box.
TILE, TILES, BOX = 2048, 32, 8
#: Dimensions that each step of the comparison adds.
STEPS = (16, 16, 32)


def _moments(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            if b.num_rows:
                u = unit(matrix(b.column("vec"), dim))
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    return run


def _summed(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim * dim)
        for b in batches:
            for x in b.column("m"):
                total += np.frombuffer(x.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    return run


def principal(vectors: DataFrame, dim: int) -> np.ndarray:
    """Directions as columns, by falling second moment, over all vectors."""
    parts = vectors.select("vec").mapInArrow(_moments(dim), "m binary")
    few = parts.repartition(8).mapInArrow(_summed(dim), "m binary").collect()
    total = sum((np.frombuffer(r.m) for r in few), np.zeros(dim * dim)).reshape(dim, dim)
    return np.linalg.eigh(total)[1][:, ::-1].copy()


def _placed(dim: int, turn: np.ndarray, tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u = unit(matrix(b.column("vec"), dim))
                b = b.append_column("leaf", pa.array(tree.value.leaf(u), pa.int64()))
                yield b.append_column("at", pa.array(u @ turn[:, 0]))

    return run


def _units(dim: int, kind: str, turn: np.ndarray, most: int):
    """A row for each unit: at most ``most`` vectors in order, and their box."""

    def made(rows: pa.Table) -> pa.RecordBatch:
        x = matrix(rows.column("vec"), dim, kind)
        z = unit(x.astype(np.float64)) @ turn[:, :BOX]
        data = [rows.column("node").to_numpy(), rows.column("copies").to_numpy(), x]
        return pa.RecordBatch.from_arrays(
            [pa.array([z.min(0).tolist()]), pa.array([z.max(0).tolist()])] + [pa.array([d.tobytes()], pa.binary()) for d in data],
            ["lo", "hi", "ids", "copies", "vecs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= most:
                rows = pa.Table.from_batches(held)
                while rows.num_rows >= most:
                    yield made(rows.slice(0, most))
                    rows = rows.slice(most)
                held = rows.to_batches()
        if sum(h.num_rows for h in held):
            yield made(pa.Table.from_batches(held))

    return run


def _close_units(units: DataFrame, reach: float) -> DataFrame:
    """``a, b`` with ``a <= b``: units whose boxes are within ``reach``.

    Units meet in bands of the first direction, each as wide as the reach: one side in those
    that it touches, the other also in those next to them, and a pair counts in its first band.
    """
    band = lambda c: F.floor(c / reach)
    slim = units.select("unit", "lo", "hi")
    first, last = band(F.col("lo")[0]), band(F.col("hi")[0])
    a = slim.withColumn("from_a", first).withColumn("band", F.explode(F.sequence(first, last))).withColumnsRenamed({"unit": "a", "lo": "lo_a", "hi": "hi_a"})
    b = slim.withColumn("from_b", first - 1).withColumn("band", F.explode(F.sequence(first - 1, last + 1))).withColumnsRenamed({"unit": "b", "lo": "lo_b", "hi": "hi_b"})
    met = a.join(b, "band").where((F.col("a") <= F.col("b")) & (F.col("band") == F.greatest("from_a", "from_b")))
    gap = lambda p, q: F.zip_with(f"lo_{p}", f"hi_{q}", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    gaps = F.zip_with(gap("a", "b"), gap("b", "a"), lambda x, y: x * x + y * y)
    return met.where(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) <= reach * reach).select("a", "b")


def _compared(dim: int, kind: str, turn: np.ndarray, least: float):
    cuts = np.minimum(np.cumsum(STEPS), dim)
    cuts = sorted({*cuts.tolist(), dim})
    reach = chord(least)

    def read(ids, copies, vecs):
        x = np.frombuffer(vecs, kind).reshape(-1, dim)
        z = unit(x.astype(np.float64)) @ turn
        rest = np.sqrt(np.maximum(0, np.cumsum((z * z)[:, ::-1], 1)[:, ::-1]))
        suffix = np.stack([rest[:, c] if c < dim else np.zeros(len(z)) for c in cuts], 1)
        return np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64), x, z, suffix

    def tiles(z):
        """Bounds of the tiles, and their boxes."""
        at = np.arange(0, len(z), TILE)
        return at, np.minimum.reduceat(z[:, :BOX], at), np.maximum.reduceat(z[:, :BOX], at)

    def linked(a, b, same: bool):
        """Row numbers of linked pairs, of all pairs of tiles that lie close enough."""
        (at_a, lo_a, hi_a), (at_b, lo_b, hi_b) = tiles(a[3]), tiles(b[3])
        for i, m in enumerate(at_a.tolist()):
            gap = np.maximum(np.maximum(lo_b - hi_a[i], lo_a[i] - hi_b), 0)
            for j in np.flatnonzero((gap * gap).sum(1) <= reach * reach).tolist():
                if same and j < i:
                    continue
                n = int(at_b[j])
                for p, q in pairs([c[m : m + TILE] for c in a], [c[n : n + TILE] for c in b], same and i == j):
                    yield p + m, q + n

    def pairs(a, b, same: bool):
        """Row numbers of linked pairs of two tiles, in pieces."""
        (za, sa), (zb, sb) = (a[3], a[4]), (b[3], b[4])
        c = cuts[0]
        right = np.hstack([zb[:, :c], sb[:, :1]]).astype(np.float32).T
        for n in range(0, len(za), 1024):
            left = np.hstack([za[n : n + 1024, :c], sa[n : n + 1024, :1]]).astype(np.float32)
            i, j = np.divmod(np.flatnonzero((left @ right).ravel() >= least - 1e-4), len(zb))
            i += n
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 200_000):
                p, q = i[k : k + 200_000], j[k : k + 200_000]
                dot = (za[p, :c] * zb[q, :c]).sum(1)
                for s in range(1, len(cuts)):
                    lo, hi = cuts[s - 1], cuts[s]
                    dot = dot + (za[p, lo:hi] * zb[q, lo:hi]).sum(1)
                    may = dot + sa[p, s] * sb[q, s] >= least - 1e-9
                    p, q, dot = p[may], q[may], dot[may]
                good = cosine(a[2][p], b[2][q]) >= least
                yield p[good], q[good]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a = read(r["ids"], r["copies"], r["vecs"])
                same = r["a"] == r["b"]
                b = a if same else read(r["ids_b"], r["copies_b"], r["vecs_b"])
                na, nb = np.zeros(len(a[0]), np.int64), np.zeros(len(b[0]), np.int64)
                ids = np.concatenate([a[0], b[0]])
                root = np.arange(len(ids))
                shift = 0 if same else len(a[0])
                for p, q in linked(a, b, same):
                    na += np.bincount(p, b[1][q], len(na)).astype(np.int64)
                    nb += np.bincount(q, a[1][p], len(nb)).astype(np.int64)
                    root = _joined(root, p, q + shift)
                if same:
                    na, nb = na + nb, np.zeros(0, np.int64)
                counts = np.concatenate([na, nb])
                hit = np.flatnonzero(counts)
                tree = np.flatnonzero(root != np.arange(len(root)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat([0, 1], [len(hit), len(tree)])),
                        pa.array(np.concatenate([ids[hit], ids[tree]])),
                        pa.array(np.concatenate([counts[hit], ids[root[tree]]])),
                    ],
                    ["kind", "x", "y"],
                )

    return run


def _joined(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Roots after linking p to q: hook to the smaller root and halve paths until stable."""
    while True:
        a, b = root[p], root[q]
        open_ = a != b
        if not open_.any():
            return root
        p, q, a, b = p[open_], q[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def chord(threshold: float) -> float:
    """How far apart unit vectors of this cosine are, and a bit more for rounding."""
    return math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Two rows link where their cosine in double precision is ``threshold`` or more; copies
    of a vector link too. Null, empty or zero vectors, vectors with a null or non-finite
    component, and rows of a null id link with nothing (a null id has a null component, and
    its row is kept). Vectors of different lengths compare as if padded with zeros. A repeated
    row (same id and vector) counts once as a link, and each has its row; rows of one id with
    different vectors are vectors of their own. An empty table gives an empty result; other
    columns, of any name, are ignored.
    """
    spark = vectors.sparkSession
    kind = "<f4" if "float" in dict(vectors.dtypes)[vec_col] else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    good = rows.where(F.col("vec_id").isNotNull() & usable("vec"))
    each = good.distinct().groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = materialize(each.withColumn("node", F.monotonically_increasing_id()))
    dim, n = width(classes, "vec"), classes.count()
    if not n:
        return rows.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    turn = principal(classes, dim)
    # The order of the tree comes from a bounded sample: the rows of the smallest hashes.
    some = min(SAMPLE, max(256, SAMPLE_BYTES // (8 * dim)))
    sample = unit(matrix(classes.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(some).toArrow().column("vec"), dim))
    # Only the order of the leaves counts here, so no probes are chosen.
    tree = spark.sparkContext.broadcast(fit_tree(sample, min(LEAVES, math.ceil(n / TILE)), 0))
    del sample
    give_back()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Units as large as leave some pairs of them for each task; at most TILES tiles.
    sides = max(1, math.floor(math.sqrt(8 * parts)))
    most = TILE * min(TILES, max(1, math.ceil(n / TILE / sides)))
    held = classes.schema["vec"].dataType.simpleString()
    units = materialize(
        classes.select("node", "copies", "vec")
        .mapInArrow(_placed(dim, turn, tree), f"node long, copies long, vec {held}, leaf long, at double")
        .repartitionByRange(max(1, min(parts, math.ceil(n / most))), "leaf", "at", "node")
        .sortWithinPartitions("leaf", "at", "node")
        .mapInArrow(_units(dim, kind, turn, most), "lo array<double>, hi array<double>, ids binary, copies binary, vecs binary")
        .withColumn("unit", F.monotonically_increasing_id())
    )
    todo = materialize(_close_units(units, chord(threshold)))
    own = units.select(F.col("unit").alias("a"), "ids", "copies", "vecs")
    other = units.select("unit", "ids", "copies", "vecs").toDF("b", "ids_b", "copies_b", "vecs_b")
    found = materialize(
        todo.join(own, "a")
        .join(other, "b")
        .repartition(4 * parts, "a", "b")
        .mapInArrow(_compared(dim, kind, turn, threshold), "kind long, x long, y long")
    )
    counts = found.where("kind = 0").groupBy(F.col("x").alias("node")).agg(F.sum("y").alias("links"))
    linked = connected_components(found.where("kind = 1"), "x", "y").withColumnRenamed("component", "label")
    group = classes.join(counts, "node", "left").join(linked, "node", "left")
    group = materialize(
        group.select("vec", "rep", F.coalesce("label", "node").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    names = group.groupBy("label").agg(F.min("rep").alias("component"))
    named = materialize(group.join(names, "label").select("vec", "n_links", "component"))
    mine = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    # Rows that take no part stand apart, so that they do not meet on one null key.
    part = rows.withColumn("ok", F.col("vec_id").isNotNull() & usable("vec"))
    met = part.where("ok").join(named, "vec", "left").select("vec_id", "n_links", "component")
    rest = part.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component"))
    return (
        met.unionByName(rest)
        .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), mine.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
