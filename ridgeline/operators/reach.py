"""What seeds reach in a bounded number of steps, as packed nodes of each root.

A row of the search is a root with many nodes as one binary, each node in as few bytes as the range of all
takes. Lists of edges travel to the roots and are made distinct inside the tasks; what the last step finds,
most of all rows, is given out there and never dealt or written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.store import cut, drop, written

#: Edges of a list, nodes of a packed row, rows given out at once, and nodes of a root that are held before they are made distinct.
LIST, PACK, OUT, HELD = 1024, 1024, 1 << 16, 1 << 23
#: Nodes that a task is offered, on average.
TASK_NODES = 1 << 25
WHOLE = {"tinyint", "smallint", "int", "bigint"}
STATE = "root long, piece int, nodes binary"


def whole(edges: DataFrame, seeds: DataFrame) -> bool:
    """Whether all ids are whole numbers."""
    return {t for df, c in ((edges, "src"), (edges, "dst"), (seeds, "root"), (seeds, "node")) for n, t in df.dtypes if n == c} <= WHOLE


def packed(x: np.ndarray, width: int) -> np.ndarray:
    """The lowest bytes of numbers."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def unpacked(raw: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = raw.reshape(-1, width)
    return out.view("<u8").ravel()


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of binaries without nulls, and where each begins and ends."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return np.frombuffer(raw, np.uint8) if raw else np.empty(0, np.uint8), at


def _pack(base: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("dsts")
            raw = packed(lists.flatten().to_numpy() - np.int64(base), width)
            at = (lists.offsets.to_numpy() - lists.offsets[0].as_py()) * width
            binary = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([b.column("src"), b.column("piece"), binary], ["src", "piece", "nodes"])

    return run


def _unpack(base: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = _bytes(b.column("nodes"))
            root, i = b.column("root").to_numpy(), 0
            while i < len(root):
                j = max(i + 1, int(np.searchsorted(at, at[i] + OUT * width, "right")) - 1)
                nodes = unpacked(raw[at[i] : at[j]], width).view(np.int64) + np.int64(base)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(root[i:j], np.diff(at[i : j + 1]) // width)), pa.array(nodes)], ["root", "node"])
                i = j

    return run


def _merged(base: int, width: int, last: bool):
    """New nodes of each root: those of offers that are not known. Known rows of a root come first."""

    def given(root: int, piece: int, known: list, offers: list) -> Iterator[pa.RecordBatch]:
        new = np.unique(np.concatenate(offers)) if offers else np.empty(0, np.uint64)
        if known and len(new):
            old = np.sort(np.concatenate(known))
            new = new[old[np.minimum(np.searchsorted(old, new), len(old) - 1)] != new]
        if last:
            for k in range(0, len(new), OUT):
                some = new[k : k + OUT].view(np.int64) + np.int64(base)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), root, np.int64)), pa.array(some)], ["root", "node"])
        elif len(new):
            rows = [packed(new[k : k + PACK], width).tobytes() for k in range(0, len(new), PACK)]
            yield pa.RecordBatch.from_arrays([pa.array([root] * len(rows), pa.int64()), pa.array([piece] * len(rows), pa.int32()), pa.array(rows, pa.binary())], ["root", "piece", "nodes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, known, offers, held = None, [], [], 0
        for b in batches:
            if not b.num_rows:
                continue
            root, piece, old = (b.column(c).to_numpy(zero_copy_only=False) for c in ("root", "piece", "known"))
            raw, at = _bytes(b.column("nodes"))
            new = np.ones(len(root), bool)
            new[1:] = (root[1:] != root[:-1]) | (piece[1:] != piece[:-1]) | (old[1:] != old[:-1])
            starts = np.flatnonzero(new)
            for i, j in zip(starts, np.append(starts[1:], len(root))):
                if key != (root[i], piece[i]):
                    if key is not None:
                        yield from given(*key, known, offers)
                    key, known, offers, held = (root[i], piece[i]), [], [], 0
                nodes = unpacked(raw[at[i] : at[j]], width)
                (known if old[i] else offers).append(nodes)
                held += 0 if old[i] else len(nodes)
                if held > HELD + 2 * len(offers[0] if offers else ()):
                    offers, held = [np.unique(np.concatenate(offers))], 0
        if key is not None:
            yield from given(*key, known, offers)

    return run


def steps(edges: DataFrame, seeds: DataFrame, most: int) -> DataFrame | None:
    """``root, node, depth`` of what ``seeds`` (``root, node``) reach over ``most`` steps at most; None where an id is null.

    Where roots are few, the nodes of each are dealt in pieces.
    """
    spark = edges.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = lambda df, *c: df.select(*(F.col(n).cast("long").alias(n) for n in c))
    e, s = written(named(edges, "src", "dst").where("src is not null").distinct()), cut(named(seeds, "root", "node").distinct())
    seen = e.agg(F.count("*"), F.count_if(F.col("dst").isNull()), F.min("dst"), F.max("dst"), F.approx_count_distinct("src")).first()
    there = s.agg(F.count_if(F.col("root").isNull() | F.col("node").isNull()), F.min("node"), F.max("node"), F.approx_count_distinct("root")).first()
    if seen[1] or there[0]:
        drop(e)
        return None
    known = [v for v in (*seen[2:4], *there[1:3]) if v is not None]
    base, pieces = min(known, default=0), max(1, min(4 * parts, math.ceil(4 * parts / max(1, there[3]))))
    width = max(1, (max(known, default=0) - base).bit_length() + 7 >> 3)
    piece = lambda c: F.pmod(F.xxhash64(c), F.lit(pieces)).cast("int").alias("piece")
    many = F.ceil(F.count("*").over(Window.partitionBy("src", "piece")) / LIST)
    edge = e.repartition(max(parts, math.ceil(seen[0] / TASK_NODES)), "src").withColumn("piece", piece("dst"))
    each = edge.withColumn("nth", F.pmod(F.xxhash64("dst", F.lit(1)), many)).groupBy("src", "piece", "nth").agg(F.collect_list("dst").alias("dsts"))
    lists = cut(each.select("src", "piece", "dsts").mapInArrow(_pack(base, width), "src long, piece int, nodes binary").repartition(max(parts, math.ceil(seen[0] / TASK_NODES)), "src").sortWithinPartitions("src"))
    drop(e)
    degree = seen[0] / max(1, seen[4])
    first = s.select("root", piece("node"), F.array("node").alias("dsts"))
    found = [written(first.withColumnRenamed("root", "src").mapInArrow(_pack(base, width), "src long, piece int, nodes binary").withColumnRenamed("src", "root"))]
    end = None
    for depth in range(1, most + 1):
        size = (found[-1].agg(F.sum(F.length("nodes"))).first()[0] or 0) / width
        if not size:
            break
        tasks = max(parts, math.ceil(size * degree / TASK_NODES))
        at = found[-1].select("root", "nodes").mapInArrow(_unpack(base, width), "root long, node long")
        offers = at.join(lists.hint("merge"), F.col("node") == F.col("src")).select("root", "piece", "nodes", F.lit(False).alias("known"))
        for old in found:
            offers = offers.unionByName(old.withColumn("known", F.lit(True)))
        dealt = offers.repartition(tasks, "root", "piece").sortWithinPartitions("root", "piece", F.desc("known"))
        if depth == most:
            end = dealt.mapInArrow(_merged(base, width, True), "root long, node long").withColumn("depth", F.lit(depth))
        else:
            found.append(written(dealt.mapInArrow(_merged(base, width, False), STATE)))
    out = None
    for depth, rows in enumerate(found):
        rows = rows.select("root", "nodes").mapInArrow(_unpack(base, width), "root long, node long").withColumn("depth", F.lit(depth))
        out = rows if out is None else out.unionByName(rows)
    return out if end is None else out.unionByName(end)
