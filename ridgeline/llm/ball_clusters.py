"""Centroid clustering with ball trees that decide for whole balls of vectors.

Each task builds metric trees over blocks of its vectors, once, and writes them: a node has a
centre, a radius that holds all its vectors, their count and their integer sum. In each round a
ball keeps the centroids that can be nearest to some vector of it: by the triangle inequality,
one whose distance less the radius exceeds the least distance plus the radius cannot be. A ball
with one centroid left goes to it whole, by its count and sum; others go down to the leaves,
where distances to the centroids left are exact integers. A task gives one row of sums a
centroid, which Spark adds up, so that the driver gets as many rows as there are centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import discard, materialize
from ._vectors import matrix

#: Components are ``SCALE`` times the vectors', and stop at ``MOST`` either way, so that squares fit a long.
SCALE, MOST = 256, 1 << 27
#: Vectors of a tree, and of a leaf.
BLOCK, LEAF = 4096, 32
#: Up to this size of components, products are exact in double precision for any width to 512.
EXACT = 1 << 21
TREE = "ids binary, nulls binary, points binary, centre binary, sums binary, node binary, radius binary, dim int"


def whole(vec: Column) -> Column:
    """A vector's components as integers."""
    return F.transform(vec, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(MOST))), F.lit(float(-MOST)))))


def kept(vectors: DataFrame, dim: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, point``: vectors of ``dim`` components, none null or not finite, as integers."""
    finite = F.forall(vec_col, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    rows = vectors.where((F.size(vec_col) == dim) & finite)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), whole(F.col(vec_col)).alias("point"))


def starts(rows: DataFrame, count: int) -> np.ndarray:
    """The first centroids: the ``count`` rows with the smallest SHA-256 of ``2:<vec_id>``."""
    digest = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id is not null").select(digest.alias("h"), "point").orderBy("h", "point").limit(count)
    return np.array([r.point for r in first.collect()], np.int64)


def _split(points: np.ndarray) -> tuple[np.ndarray, list[list[int]], list[np.ndarray]]:
    """The order of points in the tree, its nodes (first, end, left child; -1: a leaf) and their centres."""
    order, nodes, centres, todo = np.arange(len(points)), [[0, len(points), -1]], [], 0
    while todo < len(nodes):
        first, end, _ = nodes[todo]
        own = points[order[first:end]].astype(np.float64)
        centre = own.mean(0)
        centres.append(centre)
        if end - first > LEAF:
            # From the point farthest off the centre to the one farthest from that.
            one = own[((own - centre) ** 2).sum(1).argmax()]
            far = ((own - one) ** 2).sum(1)
            if far.max() > 0:
                along = own @ (own[far.argmax()] - one)
                half = (end - first) // 2
                order[first:end] = order[first:end][np.argpartition(along, half, kind="introselect")]
                nodes[todo][2] = len(nodes)
                nodes += [[first, first + half, -1], [first + half, end, -1]]
        todo += 1
    return order, nodes, centres


def _tree(ids: pa.Array, points: np.ndarray) -> list:
    """A block as one row of ``TREE``."""
    order, nodes, centres = _split(points)
    points, centre = points[order], np.array(centres)
    sums = np.array([points[a:b].sum(0) for a, b, _ in nodes])
    radius = [np.sqrt(((points[a:b] - c) ** 2).sum(1).max()) for (a, b, _), c in zip(nodes, centre)]
    number = np.array(ids.fill_null(0).to_pylist(), np.int64)[order]
    nulls = np.array(ids.is_null().to_pylist(), np.uint8)[order]
    held = (number, nulls, points, centre, sums, np.array(nodes, np.int64), np.array(radius))
    return [*(x.tobytes() for x in held), points.shape[1]]


def _trees(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def give():
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            row = _tree(t.column("vec_id").combine_chunks(), matrix(t.column("point"), dim, np.int64))
            kinds = [pa.binary()] * 7 + [pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], [c.split()[0] for c in TREE.split(", ")])

        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                held.append(b.slice(at, BLOCK))
                if sum(x.num_rows for x in held) >= BLOCK:
                    yield give()
        if held:
            yield give()

    return run


class Tree:
    """A block read back."""

    def __init__(self, row: dict):
        dim = row["dim"]
        read = lambda c, kind: np.frombuffer(row[c], kind)
        self.ids, self.nulls = read("ids", np.int64), read("nulls", np.uint8).astype(bool)
        self.points = read("points", np.int64).reshape(-1, dim)
        self.centre, self.radius = read("centre", np.float64).reshape(-1, dim), read("radius", np.float64)
        self.sums, self.nodes = read("sums", np.int64).reshape(-1, dim), read("node", np.int64).reshape(-1, 3)

    def parts(self, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Nodes in which one centroid is nearest to every vector, or leaves, with the centroids left."""
        near = np.sqrt(((self.centre[:, None, :] - centroids) ** 2).sum(2))
        # The distances are rounded, so a centroid goes only if it is farther by more than that.
        slack = 1e-9 * (1 + near.max(initial=0) + self.radius.max(initial=0))
        todo = [(0, np.arange(len(centroids)))]
        while todo:
            n, left = todo.pop()
            d = near[n, left]
            left = left[d - self.radius[n] <= d.min() + self.radius[n] + slack]
            child = int(self.nodes[n, 2])
            if len(left) == 1 or child < 0:
                yield n, left
            else:
                todo += [(child, left), (child + 1, left)]

    def nearest(self, n: int, left: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's centroid and exact squared distance within a node."""
        a, b, _ = self.nodes[n]
        d = squared(self.points[a:b], centroids[left])
        at = d.argmin(1)  # the first of equals has the smallest number
        return left[at], d[np.arange(len(at)), at]


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows, exact."""
    if max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) <= EXACT and x.shape[1] <= 512:
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return ((x[:, None, :] - y) ** 2).sum(2)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Tree]:
    for b in batches:
        for n in range(b.num_rows):
            yield Tree({c: b.column(c)[n].as_py() for c in b.schema.names})


def _summed(centroids: np.ndarray):
    """Count and sum of the vectors of each centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
        for tree in _blocks(batches):
            for n, left in tree.parts(centroids):
                a, b, _ = tree.nodes[n]
                if len(left) == 1:
                    count[left[0]] += b - a
                    total[left[0]] += tree.sums[n]
                else:
                    which, _ = tree.nearest(n, left, centroids)
                    np.add.at(count, which, 1)
                    np.add.at(total, which, tree.points[a:b])
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree in _blocks(batches):
            which, far = np.zeros(len(tree.ids), np.int32), np.zeros(len(tree.ids), np.int64)
            for n, left in tree.parts(centroids):
                a, b, _ = tree.nodes[n]
                which[a:b], far[a:b] = tree.nearest(n, left, centroids)
            yield pa.RecordBatch.from_arrays([pa.array(tree.ids, mask=tree.nulls), pa.array(which), pa.array(far)], ["vec_id", "cluster", "distance"])

    return run


def cluster(
    vectors: DataFrame, count: int = 40, rounds: int = 5, dim: int = 64, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector.

    Vectors that are null, have another number of components than ``dim``, or a component that
    is null or not finite, have no row; components are integers, floor(256 x), and those beyond
    ``MOST`` count as ``MOST``. Centroids start as ``starts`` says (fewer than ``count`` where
    fewer vectors are kept). Each round gives every vector to the nearest centroid (ties: the
    smaller number) and moves centroids with vectors to the floor of their mean; then vectors are
    given once more. Rows of a null id are clustered, but start no centroid; repeated rows each
    count; without any start there is no row. Sums are exact while they fit a long. The centroids, ``count`` rows, come to
    the driver each round; a task holds one tree of ``BLOCK`` vectors at a time, so a vector's
    width must be such that this fits. An empty table gives an empty result; other columns, of
    any name, are ignored.
    """
    rows = kept(vectors, dim, id_col, vec_col)
    at = starts(rows, count)
    if not len(at):
        none = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return rows.where("false").select("vec_id", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in none.split(", ")))
    trees = materialize(rows.mapInArrow(_trees(dim), TREE))
    for _ in range(rounds):
        sums = trees.mapInArrow(_summed(at), "cluster int, n long, sums array<long>")
        moved = sums.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(dim))).collect()
        at = at.copy()
        for r in moved:
            at[r.cluster] = np.array(r[2:], np.int64) // r.n
    given = materialize(trees.mapInArrow(_assigned(at), "vec_id long, cluster int, distance long"))
    discard(trees)
    # One row a centroid.
    inertia = {r.cluster: r.n for r in given.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    facts = [(k, n, sum(inertia.values()), hashlib.sha256(",".join(map(str, at[k].tolist())).encode()).hexdigest()) for k, n in inertia.items()]
    known = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return given.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
