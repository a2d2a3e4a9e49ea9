"""Sensor streams with bounded state: buckets behind a watermark, folds with memory.

The watermark is a choice of this library: rows later than it are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def buckets(stream: DataFrame, key: str, at: str, value: str, width: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Mean and count of each bucket, once the watermark has passed it."""
    rows = stream.withWatermark(at, late)
    made = rows.groupBy(key, F.window(at, width)).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return made.select(key, F.col("window.start").alias("bucket"), "mean", "n")


def sessions(stream: DataFrame, key: str, at: str, gap: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Runs of samples without a pause of ``gap``."""
    rows = stream.withWatermark(at, late)
    made = rows.groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("n"))
    return made.select(key, F.col("session_window.start").alias("first"), F.col("session_window.end").alias("end"), "n")


def distinct(stream: DataFrame, keys: list[str], at: str, late: str = "1 minute") -> DataFrame:
    """The first row of each key; keys are forgotten behind the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def zones(stream: DataFrame, key: str, at: str, value: str, cuts: list[float], margin: float) -> DataFrame:
    """Each sample's zone; a zone is left only past its border by ``margin``.

    The state of a key is one number. Samples of a batch are taken in order of time; null
    values keep the zone.
    """
    borders = [float("-inf"), *cuts, float("inf")]

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        zone = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(at, kind="stable")
        out = []
        for v in rows[value]:
            stay = zone is not None and borders[zone] - margin <= v < borders[zone + 1] + margin
            if not pd.isna(v) and not stay:
                zone = sum(v >= c for c in cuts)
            out.append(zone)
        if zone is not None:
            state.update((zone,))
        yield pd.DataFrame({key: keys[0], at: rows[at].values, "zone": pd.array(out, "Int32")})

    types = dict(stream.dtypes)
    schema = f"{key} {types[key]}, {at} {types[at]}, zone int"
    return stream.select(key, at, value).groupBy(key).applyInPandasWithState(step, schema, "zone int", "append", GroupStateTimeout.NoTimeout)


def gated_mean(
    stream: DataFrame, key: str, at: str, value: str, warm: int = 300, gate: float = 40.0, run: int = 60, near: float = 12.0
) -> DataFrame:
    """A slow mean that outliers do not move: ``mean`` after each sample.

    The first ``warm`` samples are averaged evenly, later ones weigh 1 / ``warm``. A sample
    over ``gate`` away is left out; ``run`` of them in a row, within ``near`` of each other's
    mean, start the mean anew there.
    """

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean, n, out_n, out_mean = state.get if state.exists else (0.0, 0, 0, 0.0)
        rows = pd.concat(list(batches)).dropna(subset=[value]).sort_values(at, kind="stable")
        means = []
        for v in rows[value]:
            if n and abs(v - mean) > gate:
                close = out_n and abs(v - out_mean) <= near
                out_n, out_mean = (out_n + 1, out_mean + (v - out_mean) / (out_n + 1)) if close else (1, v)
                if out_n >= run:
                    mean, n, out_n = out_mean, out_n, 0
            else:
                n, out_n = min(n + 1, warm), 0
                mean += (v - mean) / n
            means.append(mean)
        state.update((float(mean), int(n), int(out_n), float(out_mean)))
        yield pd.DataFrame({key: keys[0], at: rows[at].values, "mean": means})

    types = dict(stream.dtypes)
    schema = f"{key} {types[key]}, {at} {types[at]}, mean double"
    held = "mean double, n int, out_n int, out_mean double"
    return stream.select(key, at, value).groupBy(key).applyInPandasWithState(step, schema, held, "append", GroupStateTimeout.NoTimeout)
