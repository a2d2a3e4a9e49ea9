"""Bounded steps over packed nodes, against a plain search."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from ridgeline.operators import graph, reach


def stepped(edges, seeds, most):
    out, found = {}, {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    new = set(seeds)
    for depth in range(most + 1):
        new = {p for p in new if p not in found}
        found |= dict.fromkeys(new, depth)
        new = {(r, b) for r, a in new for b in out.get(a, ())}
    return {(r, n, d) for (r, n), d in found.items()}


@pytest.mark.parametrize("shift, seeds, small", [(0, 3, False), (-(1 << 40), 60, True)])
def test_steps_equal_a_plain_search(spark, monkeypatch, shift, seeds, small):
    if small:
        for name, n in (("LIST", 4), ("PACK", 5), ("OUT", 7), ("HELD", 9), ("TASK_NODES", 50)):
            monkeypatch.setattr(reach, name, n)
    r = random.Random(8)
    edges = [(shift * (k % 2) + r.randrange(150), shift * (k % 2) + r.randrange(150)) for k in range(500)] + [(1, k) for k in range(90)] * 2 + [(None, 5)]
    start = [(k, shift * (k % 2) + k) for k in range(seeds)] + [(0, 7), (900, 901), (0, 7)]
    got = graph.closure(spark.createDataFrame(edges, "src long, dst int" if not shift else "src long, dst long"), spark.createDataFrame(start, "root int, node long"), 3)
    assert got.dtypes == [("root", "int"), ("node", "bigint"), ("depth", "int")]
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == stepped([e for e in edges if e[0] is not None], start, 3)


def test_the_last_step_is_not_written(spark):
    """Of a star's ten thousand ends, all one step away, none goes to disk before it is asked for."""
    spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.checkpoint.dir')}/reach")
    edges, seeds = spark.range(10_000).selectExpr("0L as src", "id as dst"), spark.createDataFrame([(k, 0) for k in range(50)], "root long, node long")
    got = graph.closure(edges, seeds, 1)
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    assert sum(f.stat().st_size for f in folder.rglob("*") if f.is_file()) < 1 << 20
    assert got.count() == 50 * 10_000


def test_null_ids_and_names_go_row_by_row(spark):
    edges, seeds = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string"), spark.createDataFrame([("x", "a")], "root string, node string")
    assert {tuple(r) for r in graph.closure(edges, seeds, 2).collect()} == {("x", "a", 0), ("x", "b", 1), ("x", "c", 2)}
    edges, seeds = spark.createDataFrame([(1, 2), (1, None)], "src long, dst long"), spark.createDataFrame([(5, 1)], "root long, node long")
    assert {tuple(r) for r in graph.closure(edges, seeds, 1).collect()} == {(5, 1, 0), (5, 2, 1), (5, None, 1)}
    assert graph.closure(edges.where("src > 5"), seeds, 2).collect() == [(5, 1, 0)]
    assert graph.closure(edges.where("dst = 2"), seeds.where("root > 5"), 2).collect() == []
    assert [tuple(r) for r in graph.closure(edges, seeds, 0).collect()] == [(5, 1, 0)]


def test_merging_holds_few_nodes_at_once(monkeypatch):
    for name, n in (("PACK", 3), ("OUT", 4), ("HELD", 5)):
        monkeypatch.setattr(reach, name, n)
    r, base, width = random.Random(2), -70_000, 3
    rows, want = [], {}
    for root, piece in ((1, 0), (1, 1), (2, 0), (7, 3)):
        known, offers = [{r.randrange(base, 70_000) // 9 * 9 for _ in range(k)} for k in (root * 3 - 3, 40)]
        offers |= set(list(known)[:2])
        want[root] = want.get(root, set()) | offers - known
        rows += [(root, piece, reach.packed(np.array(x) - base, width).tobytes(), old) for old, all_ in ((True, known), (False, offers)) for x in ([*all_][k::6] for k in range(6)) if x]
        rows += rows[-1:]
    kinds = pa.int64(), pa.int32(), pa.binary(), pa.bool_()
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 5]), kinds)], ["root", "piece", "nodes", "known"]) for k in range(0, len(rows), 5)]
    state = list(reach._merged(base, width, False)(iter(batches)))
    for out in (reach._merged(base, width, True)(iter(batches)), reach._unpack(base, width)(b.select(["root", "nodes"]) for b in state)):
        got = [x for b in out for x in zip(*(c.to_pylist() for c in b.columns))]
        assert sorted(got) == sorted((root, n) for root, all_ in want.items() for n in all_)
