"""Streams of riders along one route: matching, trails, what comes next.

A route and its places are parameters: one recording's length, not a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _fold(stream: DataFrame, key: str, at: str, columns: list[str], out: str, held: str, step) -> DataFrame:
    """Rows of each key in order of time through ``step(state, row) -> (state, row or None)``."""

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).dropna(subset=columns).sort_values(at, kind="stable")
        now, made = (state.get if state.exists else None), []
        for t, *values in rows[[at, *columns]].itertuples(index=False):
            now, got = step(now, values)
            made += [(keys[0], t, *got)] if got is not None else []
        if now is not None:
            state.update(now)
        yield pd.DataFrame(made, columns=[key, at, *names])

    types = dict(stream.dtypes)
    names = [c.split()[0] for c in out.split(", ")]
    schema = f"{key} {types[key]}, {at} {types[at]}, {out}"
    return stream.select(key, at, *columns).groupBy(key).applyInPandasWithState(run, schema, held, "append", GroupStateTimeout.NoTimeout)


def matched(
    stream: DataFrame, key: str, at: str, route: list[tuple[float, float]], behind: float = 50.0, ahead: float = 500.0, leave: float = 25.0, back: float = 15.0
) -> DataFrame:
    """Each position's place ``along`` the route, its distance ``off`` it, and ``on``.

    A rider on the route is looked for from ``behind`` to ``ahead`` of the last place, so a
    way back over the same road is not taken for the way out. Only beyond ``leave`` metres is
    the route left; the whole of it is then searched, and joined again within ``back``. Of
    equal distances the first place counts. Positions are columns ``x, y`` in metres.
    """
    p = np.array(route, "f8").reshape(-1, 2)
    a, d = p[:-1], np.diff(p, axis=0)
    size = np.hypot(d[:, 0], d[:, 1])
    start = np.concatenate([[0.0], np.cumsum(size)])

    def nearest(x: float, y: float, low: float, high: float) -> tuple[float, float]:
        w = np.flatnonzero((start[1:] >= low) & (start[:-1] <= high))
        if not len(w):
            return float("inf"), low
        v, long = np.array([x, y]) - a[w], np.where(size[w] > 0, size[w], 1.0)
        # Segments at the ends of the window count only as far as it reaches.
        t = (v * d[w]).sum(1) / long**2
        t = np.clip(t, np.clip((low - start[w]) / long, 0, 1), np.clip((high - start[w]) / long, 0, 1))
        far = np.hypot(*(v - d[w] * t[:, None]).T)
        k = int(far.argmin())
        return float(far[k]), float(start[w[k]] + t[k] * size[w[k]])

    def step(state, row):
        place, on = state if state is not None else (0.0, False)
        off, along = nearest(*row, place - behind, place + ahead) if on else nearest(*row, 0.0, float("inf"))
        on = off <= (leave if on else back)
        place = along if on else place
        return (place, on), (place, off, on)

    return _fold(stream, key, at, ["x", "y"], "along double, off double, on boolean", "place double, on boolean", step)


def trail(stream: DataFrame, key: str, at: str, least: float = 5.0, recent: int = 32, spine: int = 256) -> DataFrame:
    """The way so far, in at most ``recent`` + ``spine`` points, after each position that adds one.

    A position adds a point once it is ``least`` away from the last. Points that leave the
    recent ones join the spine; a full spine drops the inner point that spans the smallest
    triangle with its neighbours, never its first. The trail is two arrays, oldest first.
    """

    def step(state, row):
        xs, ys = (list(state[0]), list(state[1])) if state is not None else ([], [])
        if xs and np.hypot(row[0] - xs[-1], row[1] - ys[-1]) < least:
            return (xs, ys), None
        xs, ys = [*xs, row[0]], [*ys, row[1]]
        if len(xs) > recent + spine:
            p = np.array([xs, ys])[:, : spine + 1]
            u, v = p[:, 1:-1] - p[:, :-2], p[:, 2:] - p[:, :-2]
            drop = 1 + int(np.abs(u[0] * v[1] - u[1] * v[0]).argmin())
            del xs[drop], ys[drop]
        return (xs, ys), (list(xs), list(ys))

    arrays = "xs array<double>, ys array<double>"
    return _fold(stream, key, at, ["x", "y"], arrays, arrays, step)


def next_ahead(stream: DataFrame, key: str, at: str, places: list[tuple[float, str]], refresh: float = 500.0, drift: float = 50.0) -> DataFrame:
    """The way to the next of ``places`` (along, name) from each ``along``; null past the last.

    The next place is looked up again once the rider has come ``refresh`` on, or over
    ``drift`` back, since the last time, or has passed it.
    """
    where = sorted(places)
    ways = np.array([w for w, _ in where])

    def step(state, row):
        along = float(row[0])
        anchor, k = state if state is not None else (None, 0)
        passed = anchor is not None and k < len(where) and ways[k] < along
        if anchor is None or passed or not -drift <= along - anchor < refresh:
            anchor, k = along, int(np.searchsorted(ways, along))
        got = (where[k][1], float(ways[k] - along)) if k < len(where) else (None, None)
        return (anchor, k), got

    return _fold(stream, key, at, ["along"], "name string, metres double", "anchor double, k int", step)
