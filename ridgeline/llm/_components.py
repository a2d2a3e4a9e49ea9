"""Union-find grouping of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import discard, materialize


def _jump(parent: DataFrame) -> DataFrame:
    """Replace every parent by the parent's parent (path halving)."""
    up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
    return parent.join(up, "parent", "left").select(
        "node", F.coalesce("above", "parent").alias("parent")
    )


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` of an undirected graph; component is its smallest node.

    Each round hooks every node to its smallest neighbour, halves the paths, and
    contracts the edges onto the parents. The number of edges falls from round to
    round; only its emptiness reaches the driver. Nodes without an edge (or with
    only a loop) have no row. Null ends are ignored.
    """
    e = materialize(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") < F.col("b")))
        .where(edges[a].isNotNull() & edges[b].isNotNull())
        .distinct()
    )
    label = None
    while not e.isEmpty():
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
        parent = materialize(parent.select("node", F.least("node", "parent").alias("parent")))
        jumped = materialize(_jump(_jump(parent)))
        discard(parent)
        pa = jumped.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        pb = jumped.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        after = materialize(
            e.join(pa, "a")
            .join(pb, "b")
            .where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct()
        )
        discard(e)
        e = after
        if label is None:
            label = jumped.select("node", F.col("parent").alias("component"))
            label._ridgeline_path = jumped._ridgeline_path
        else:
            up = jumped.select(F.col("node").alias("component"), F.col("parent").alias("above"))
            new = materialize(
                label.join(up, "component", "left").select(
                    "node", F.coalesce("above", "component").alias("component")
                )
            )
            discard(label)
            discard(jumped)
            label = new
    if label is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label


class Forest:
    """Union-find over the integers below ``n``, smallest member as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True
