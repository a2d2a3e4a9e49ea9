"""Approximate nearest neighbours by robust-pruned directed graphs.

Vectors are dealt to shards of near ones by a tree of balanced cuts, fitted on a bounded
sample. In each shard, points enter the graph in growing batches: a greedy beam search from
the medoid proposes the points it expands, and relaxed distance pruning keeps a point only
if no kept neighbour is nearer to it by the factor alpha, so short and long edges stay.
Reverse edges are added and overfull lists are pruned again. A query goes to the shards that
lie nearest, as many as held the neighbours of sample rows; there the beam is scored on the
original vectors in double precision, and the shards' best are merged. Distances in the graph are
doubles too: of vectors that differ by 1e-4 of their length, floats do not tell the near ones.

Points of one direction (positive multiples, up to rounding) are one node of the graph, and
all its members are scored; so pruning at distance 0 separates nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialize
from ._vectors import cosine, groups_of, matrix, unit, usable, width

#: Points of a shard, most leaves of the tree (shards grow beyond), queries of a block.
SHARD, LEAVES, QUERY_BLOCK = 16_384, 4096, 2048
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 32, 96, 200, 1.1
#: Points of a beam expanded together.
AT_ONCE = 4
#: Most rows, and bytes of them, that the tree and the number of probes are fitted on.
SAMPLE, SAMPLE_BYTES = 65_536, 64 << 20
#: Rows of the sample that are looked at together, to cut it and against all of it; these bound the driver's memory, not the sample.
AT_A_TIME, ROWS = 4096, 16
#: Share of the sample's true neighbours that the probed leaves hold.
COVERED = 0.99


@dataclass
class Tree:
    """Balanced cuts of unit vectors; ``children`` below 0 are leaves, ``-1 - number``."""

    planes: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    centres: np.ndarray
    probes: int = 1
    reach: float = 1.0

    def leaf(self, u: np.ndarray) -> np.ndarray:
        at = np.zeros(len(u), np.int64) if len(self.cuts) else np.full(len(u), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            right = np.einsum("ij,ij->i", u[inner], self.planes[node]) > self.cuts[node]
            at[inner] = self.children[node, right.astype(int)]
        return -1 - at

    def far(self, u: np.ndarray) -> np.ndarray:
        """Squared distances to the centres of all leaves."""
        return np.maximum(1 + (self.centres**2).sum(1) - 2 * (u @ self.centres.T), 0)

    def nearest(self, u: np.ndarray) -> list[np.ndarray]:
        """The leaves that each row searches: ``probes`` nearest, and all as near as ``reach`` allows."""
        far = self.far(u)
        order = np.argsort(far, 1, kind="stable")
        far = np.take_along_axis(far, order, 1)
        many = np.maximum((far <= self.reach * far[:, :1] + 1e-12).sum(1), self.probes)
        return [row[:n] for row, n in zip(order, many)]


def fit_tree(u: np.ndarray, leaves: int, k: int) -> Tree:
    """Cut the sample ``u`` in halves at the median of its widest direction, and choose the probes.

    ``probes`` is the least number of nearest leaves that hold ``COVERED`` of the ``k``
    nearest of up to 1,024 rows within the sample (all leaves for no ``k``): few where the data have clusters, about all
    where they have none. ``reach`` is the same as a ratio of squared distances, so that a row
    between clusters, which is about as far from all of them, searches more than most rows.
    """
    planes, cuts, children, centres = [], [], [], []
    dim = u.shape[1]

    def runs(rows: np.ndarray) -> Iterator[np.ndarray]:
        """Some of the rows at a time, so that no second copy of the sample is held."""
        return (u[rows[n : n + AT_A_TIME]] for n in range(0, len(rows), AT_A_TIME))

    def widest(rows: np.ndarray, mean: np.ndarray) -> np.ndarray:
        spread = sum((y.T @ y for y in (x - mean for x in runs(rows))), np.zeros((dim, dim)))
        return np.linalg.eigh(spread / len(rows))[1][:, -1]

    def grow(rows: np.ndarray, want: int) -> int:
        mean = sum((x.sum(0) for x in runs(rows)), np.zeros(dim)) / max(1, len(rows))
        if want > 1 and len(rows) > 1:
            plane = widest(rows, mean)
            along = np.concatenate([x @ plane for x in runs(rows)])
            cut = float(np.quantile(along, (want // 2) / want))
            low = along <= cut
            if low.any() and not low.all():
                n = len(cuts)
                planes.append(plane), cuts.append(cut), children.append([0, 0])
                children[n] = [grow(rows[low], want // 2), grow(rows[~low], want - want // 2)]
                return n
        centres.append(mean)
        return -len(centres)

    grow(np.arange(len(u)), leaves)
    tree = Tree(np.array(planes).reshape(-1, dim), np.array(cuts), np.array(children, int).reshape(-1, 2), np.array(centres))
    if len(centres) > 1:
        most, tops = min(k, len(u) - 1), []
        if not most:
            tree.probes, tree.reach = len(centres), math.inf
            return tree
        q = np.linspace(0, len(u) - 1, min(1024, len(u))).astype(int)
        for n in range(0, len(q), ROWS):
            near = u[q[n : n + ROWS]] @ u.T
            near[np.arange(len(near)), q[n : n + ROWS]] = -2
            tops.append(np.argpartition(np.negative(near, near), most - 1, 1)[:, :most].copy())
        leaf, far = np.concatenate([tree.leaf(u[rows].reshape(-1, dim)).reshape(rows.shape) for rows in tops]), tree.far(u[q])
        rank = np.argsort(np.argsort(far, 1, kind="stable"), 1)
        at = math.ceil(COVERED * leaf.size) - 1
        tree.probes = int(np.sort(np.take_along_axis(rank, leaf, 1).ravel())[at]) + 1
        ratio = np.take_along_axis(far, leaf, 1) / np.maximum(far.min(1, keepdims=True), 1e-12)
        tree.reach = float(np.sort(ratio.ravel())[at])
    return tree


def beam_search(x, graph, start: int, q, beam: int, trace: bool = False):
    """Row numbers and squared distances of each query's beam, nearest first, and the points seen.

    With ``trace``, of all expanded points instead (-1 where there are fewer).
    """
    m, n = len(q), len(x)
    ids = np.full((m, beam), -1, np.int64)
    far = np.full((m, beam), np.inf)
    done = np.ones((m, beam), bool)
    seen = np.zeros((m, n), bool)
    ids[:, 0], far[:, 0], done[:, 0] = start, 2 - 2 * (q @ x[start]), False
    seen[:, start] = True
    steps_ids, steps_far = [], []
    live = np.arange(m)
    while len(live):
        rank = np.argsort(done[live], 1, kind="stable")[:, :AT_ONCE]
        cur = np.where(np.take_along_axis(done[live], rank, 1), -1, np.take_along_axis(ids[live], rank, 1))
        if trace:
            wide = np.full((m, AT_ONCE), -1, np.int64)
            wide_far = np.full((m, AT_ONCE), np.inf)
            wide[live] = cur
            wide_far[live] = np.where(cur < 0, np.inf, np.take_along_axis(far[live], rank, 1))
            steps_ids.append(wide)
            steps_far.append(wide_far)
        flags = done[live]
        np.put_along_axis(flags, rank, True, 1)
        new = np.where(cur[:, :, None] < 0, -1, graph[cur]).reshape(len(live), -1)
        new[seen[live[:, None], new]] = -1
        new.sort(1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        row, col = np.nonzero(new >= 0)
        seen[live[row], new[row, col]] = True
        d = np.full(new.shape, np.inf)
        d[row, col] = 2 - 2 * np.einsum("ij,ij->i", x[new[row, col]], q[live[row]])
        all_far = np.hstack([far[live], d])
        keep = np.argsort(all_far, 1, kind="stable")[:, :beam]
        far[live] = np.take_along_axis(all_far, keep, 1)
        ids[live] = np.take_along_axis(np.hstack([ids[live], new]), keep, 1)
        done[live] = np.take_along_axis(np.hstack([flags, d == np.inf]), keep, 1)
        live = live[~done[live].all(1)]
    if trace:
        return np.hstack(steps_ids), np.hstack(steps_far), seen.sum(1)
    return ids, far, seen.sum(1)


def robust_prune(x, cand, far, degree: int, alpha: float):
    """Each row's kept candidates (-1 where fewer), nearest first."""
    keep = np.argsort(far, 1, kind="stable")[:, : max(96, 2 * degree)]
    cand, far = np.take_along_axis(cand, keep, 1), np.take_along_axis(far, keep, 1)
    v = x[cand]
    between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
    live = (cand >= 0) & np.isfinite(far)
    out = np.full((len(cand), degree), -1, np.int64)
    rows = np.arange(len(cand))
    for k in range(degree):
        best = live.argmax(1)
        some = live[rows, best]
        if not some.any():
            break
        out[some, k] = cand[rows[some], best[some]]
        live[rows, best] = False
        live &= ~(alpha * alpha * between[rows, best] <= far) | ~some[:, None]
    return out


def build_graph(x, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA):
    """Adjacency (-1 padded) of unit vectors, and the row to start from."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int64)
    start = int((x @ x.mean(0)).argmax())
    order = np.random.default_rng(7).permutation(n)
    order = order[order != start]
    at = 0
    while at < len(order):
        batch = order[at : at + min(256, max(8, at // 2))]
        at += len(batch)
        cand, far, _ = beam_search(x, graph, start, x[batch], beam, trace=True)
        far[cand == batch[:, None]] = np.inf
        graph[batch] = robust_prune(x, cand, far, degree, alpha)
        _reverse(x, graph, batch, alpha)
    return graph, start


def _reverse(x, graph, batch, alpha: float) -> None:
    degree = graph.shape[1]
    to, frm = graph[batch].ravel(), np.repeat(batch, degree)
    frm, to = frm[to >= 0], to[to >= 0]
    order = np.argsort(to, kind="stable")
    to, frm = to[order], frm[order]
    heads, first, many = np.unique(to, return_index=True, return_counts=True)
    wide = np.full((len(heads), degree + int(many.max(initial=0))), -1, np.int64)
    wide[:, :degree] = graph[heads]
    wide[np.repeat(np.arange(len(heads)), many), degree + np.arange(len(to)) - np.repeat(first, many)] = frm
    wide.sort(1)
    wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
    wide.sort(1)
    wide = wide[:, ::-1]
    full = (wide >= 0).sum(1) > degree
    graph[heads[~full]] = wide[~full, :degree]
    for k in range(0, int(full.sum()), 512):
        h, c = heads[full][k : k + 512], wide[full][k : k + 512]
        far = 2 - 2 * np.einsum("ijk,ik->ij", x[c], x[h])
        graph[h] = robust_prune(x, c, np.where(c < 0, np.inf, far), degree, alpha)


def directions(u: np.ndarray) -> np.ndarray:
    """For each unit vector the number of its direction, by first row; rounding is overlooked."""
    axis = np.random.default_rng(3).normal(size=u.shape[1])
    order = np.argsort(u @ axis, kind="stable")
    apart = np.abs(np.diff(u[order], axis=0)).max(1, initial=0) > 1e-6
    group = np.empty(len(u), np.int64)
    group[order] = np.concatenate([[0], np.cumsum(apart)])
    first = np.full(group.max() + 1, len(u))
    np.minimum.at(first, group, np.arange(len(u)))
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    return rank[group]


def _run(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers ``first[i] ... first[i] + many[i] - 1`` of all i in a row."""
    return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.int64), np.diff(column.offsets.to_numpy()).astype(np.int64)


def _indexed(dim: int, kind: str):
    """A row for each shard: vectors by direction, their ids, and the graph of the directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, t in groups_of(batches, "shard"):
            x, (ids, sizes) = matrix(t.column("vec"), dim, kind), _lists(t.column("ids"))
            u = unit(x.astype(np.float64))
            group = directions(u)
            order = np.argsort(group, kind="stable")
            members = np.bincount(group)
            graph, start = build_graph(u[order[np.cumsum(members) - members]])
            ids = ids[_run((np.cumsum(sizes) - sizes)[order], sizes[order])]
            data = [x[order], ids, sizes[order], members, graph.astype(np.int32), np.array([start])]
            names = ["vecs", "ids", "sizes", "members", "graph", "start"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64())] + [pa.array([d.tobytes()], pa.binary()) for d in data], ["shard", *names]
            )

    return run


def _blocks(dim: int, kind: str):
    """A row for each block of queries of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, t in groups_of(batches, "shard"):
            for n in range(0, t.num_rows, QUERY_BLOCK):
                s = t.slice(n, QUERY_BLOCK)
                data = [matrix(s.column("vec"), dim, kind), s.column("vec_id").to_numpy()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int64())] + [pa.array([d.tobytes()], pa.binary()) for d in data], ["shard", "q_vecs", "q_ids"]
                )

    return run


def _searched(dim: int, kind: str, k: int, beam: int):
    beam = max(beam, 2 * k + 2)

    def best(x, ids, sizes, first, members, graph, start, u, q, qids):
        got, far, seen = beam_search(u, graph, start, unit(q.astype(np.float64)), beam)
        held = np.where(got >= 0, members[got], 0)
        # All directions up to k + 1 members count, and some more for the rounding of distances.
        enough = (np.cumsum(held, 1) <= k).sum(1) + 16
        row, col = np.nonzero((got >= 0) & (np.arange(got.shape[1]) < enough[:, None]))
        at = got[row, col]
        row, at = np.repeat(row, members[at]), _run((np.cumsum(members) - members)[at], members[at])
        score = np.concatenate([np.zeros(0), *(cosine(q[row[n : n + 100_000]], x[at[n : n + 100_000]]) for n in range(0, len(row), 100_000))])
        many = sizes[at]
        row, score, found = np.repeat(row, many), np.repeat(score, many), ids[_run(first[at], many)]
        other = found != qids[row]
        row, score, found = row[other], score[other], found[other]
        order = np.lexsort((found, -score, row))
        row, score, found = row[order], score[order], found[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        top = nth < k
        # What the search of this shard cost stands on the first row of each query.
        cost = np.where(nth[top] == 0, seen[row[top]], 0)
        return qids[row[top]], found[top], score[top], cost

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["vecs"], kind).reshape(-1, dim)
                ids, sizes, members = (np.frombuffer(r[c], np.int64) for c in ("ids", "sizes", "members"))
                graph = np.frombuffer(r["graph"], np.int32).reshape(len(members), -1).astype(np.int64)
                u = unit(x[np.cumsum(members) - members].astype(np.float64))
                q, qids = np.frombuffer(r["q_vecs"], kind).reshape(-1, dim), np.frombuffer(r["q_ids"], np.int64)
                start, step = int(np.frombuffer(r["start"], np.int64)[0]), max(1, min(256, (32 << 20) // len(u)))
                for n in range(0, len(q), step):
                    found = best(x, ids, sizes, np.cumsum(sizes) - sizes, members, graph, start, u, q[n : n + step], qids[n : n + step])
                    nodes = np.full(len(found[0]), len(members))
                    columns = [pa.array(c.astype(t)) for c, t in zip((*found, nodes), ("i8", "i8", "f8", "i8", "i8"))]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score", "visited", "nodes"])

    return run


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    beam: int = SEARCH_BEAM,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    shard: int = SHARD,
) -> DataFrame:
    """``query_id, rank, vec_id, score, visited, searched``: each query's ``k`` nearest rows by cosine.

    Queries are the rows of ``vectors`` where ``is_query`` (of column ``vec_id``) holds;
    a query is never its own neighbour. Score is the cosine in double precision; ties go to
    the smaller id, and fewer than ``k`` other rows give fewer ranks. ``visited`` counts the
    distances that the query computed, ``searched`` the nodes of the shards it went to.
    Rows with a null id, and vectors that are null, empty, zero or hold a null or non-finite
    component take no part. Vectors of different lengths compare as if padded with zeros. A
    repeated row (same id and vector) counts once; rows of one id with different vectors are
    each searched and found, under one query. An empty table gives an empty result; other
    columns are ignored. Neighbours are approximate: see the README for the measured recall.

    A leaf of over twice ``shard`` points (many of one direction) is dealt by hash to parts
    that are all searched. Vectors are arrays of bounded length, so a shard fits a task.
    """
    spark = vectors.sparkSession
    kind = "<f4" if "float" in dict(vectors.dtypes)[vec_col] else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    good = rows.where(F.col("vec_id").isNotNull() & usable("vec"))
    dim = max(1, width(good, "vec"))
    # Of equal vectors, k + 1 ids are enough: any query takes k besides itself.
    nth = F.dense_rank().over(Window.partitionBy("vec").orderBy("vec_id"))
    points = good.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("vec").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    points = materialize(points)
    leaves = min(LEAVES, max(1, math.ceil(points.count() / shard)))
    some = min(SAMPLE, max(256, SAMPLE_BYTES // (8 * dim)))
    # Bounded: the rows of the smallest hashes; one leaf needs no sample.
    sample = points.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(some if leaves > 1 else 1).toArrow()
    u = unit(matrix(sample.column("vec"), dim)) if sample.num_rows else np.ones((1, dim))
    tree = spark.sparkContext.broadcast(fit_tree(u, leaves, k))

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.append_column("leaf", pa.array(tree.value.leaf(unit(matrix(b.column("vec"), dim))), pa.int64()))

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = pa.array(tree.value.nearest(unit(matrix(b.column("vec"), dim))), pa.list_(pa.int64()))
                yield b.append_column("leaves", near)

    held = points.schema["vec"].dataType.simpleString()
    placed = materialize(points.mapInArrow(leaf, f"vec {held}, ids array<bigint>, leaf long"))
    # At most LEAVES rows.
    sizes = placed.groupBy("leaf").count().orderBy("leaf").collect()
    parts = [(r.leaf, max(1, math.ceil(r["count"] / shard)) if r["count"] > 2 * shard else 1) for r in sizes]
    starts = np.cumsum([0, *(n for _, n in parts)]).tolist()
    known = spark.createDataFrame([(a, n, s) for (a, n), s in zip(parts, starts)], "leaf long, parts int, first long")
    deal = F.col("first") + F.pmod(F.xxhash64("vec", F.lit(11)), F.col("parts"))
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = materialize(
        placed.join(F.broadcast(known), "leaf")
        .select(deal.alias("shard"), "vec", "ids")
        .repartition(number, "shard")
        .sortWithinPartitions("shard", F.col("ids")[0])
        .mapInArrow(_indexed(dim, kind), "shard long, vecs binary, ids binary, sizes binary, members binary, graph binary, start binary")
    )
    asked = good.where(is_query).distinct().mapInArrow(probed, f"vec_id long, vec {held}, leaves array<bigint>")
    asked = asked.select("vec_id", "vec", F.explode("leaves").alias("leaf")).join(F.broadcast(known), "leaf")
    each = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1))
    queries = (
        asked.select("vec_id", "vec", each.alias("shard"))
        .repartition(number, "shard", F.pmod("vec_id", F.lit(64)))
        .sortWithinPartitions("shard", "vec_id")
        .mapInArrow(_blocks(dim, kind), "shard long, q_vecs binary, q_ids binary")
    )
    found = materialize(
        queries.join(index, "shard").mapInArrow(
            _searched(dim, kind, k, beam), "query_id long, vec_id long, score double, visited long, nodes long"
        )
    )
    whole = Window.partitionBy("query_id")
    once = F.when(F.col("visited") > 0, F.col("nodes")).otherwise(0)
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.sum("visited").alias("visited"), F.sum(once).alias("nodes"))
    return (
        merged.withColumns({"visited": F.sum("visited").over(whole), "searched": F.sum("nodes").over(whole)})
        .withColumn("rank", F.row_number().over(whole.orderBy(F.desc("score"), "vec_id")))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score", "visited", "searched")
    )
