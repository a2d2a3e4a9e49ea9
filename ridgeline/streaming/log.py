"""Appending a stream to a log so that no row is lost or doubled, and folds over device clocks.

Spark may give a batch again after a failure, with the same number and the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def append_log(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Start a query that appends ``stream`` to the log at ``path``; ``trigger`` is Spark's.

    Each batch is a folder of its writer (the query's lasting id, from the checkpoint) and number.
    A batch that is given again finds its folder whole or replaces it, so a kill between
    the write and Spark's note of it makes no double rows; a folder without Spark's mark
    of success is not part of the log (``read_log``). Batches without rows leave an empty folder.
    A new checkpoint is a new writer, whose batches stand beside the old ones.
    """
    writer = []

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not writer:
            writer.append(json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"])
        folder = f"{path}/writer={writer[0]}/batch={number}"
        if not _whole(spark, folder):
            batch.write.mode("overwrite").parquet(folder)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def _whole(spark: SparkSession, folder: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def whole_batches(spark: SparkSession, path: str) -> list[str]:
    """The folders of a log whose write came to its end."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/writer=*/batch=*/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    return sorted(f.getPath().getParent().toString() for f in found)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all whole batches, with their ``writer`` and ``batch``."""
    folders = whole_batches(spark, path)
    if not folders:
        return spark.createDataFrame([], f"{schema}, writer string, batch int")
    return spark.read.schema(f"{schema}, writer string, batch int").option("basePath", path).parquet(*folders)


def recent_mean(stream: DataFrame, key: str, order: str, clock: str, value: str, seconds: int = 10, idle: str = "1 hour") -> DataFrame:
    """``key, order, mean``: after each sample, the mean of the latest values of the last ``seconds`` seconds.

    Samples count in the order they came in (``order``), which is not that of ``clock``, the
    milliseconds a device gives: a clock that goes back, or a gap of ``seconds`` or more,
    empties the window. A null value or clock gives no row and changes nothing. State is one
    value a second; a key silent for ``idle`` of processing time is forgotten. Spark looks for
    silent keys in batches without rows too, so under ``availableNow`` such a query ends only
    where ``spark.sql.streaming.noDataMicroBatches.enabled`` is false.
    """
    millis = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest, window = None, {}
        if state.exists:
            newest, at, values = state.get
            window = dict(zip(at, values, strict=True))
        rows = pd.concat(list(batches)).dropna(subset=[clock, value]).sort_values(order, kind="stable")
        means = []
        for now, v in zip(rows[clock].astype("int64") // 1000, rows[value].astype("float64"), strict=True):
            if newest is not None and (now < newest or now - newest >= seconds):
                window = {}
            window = {s: w for s, w in window.items() if s > now - seconds}
            window[now], newest = v, now
            means.append(sum(window.values()) / len(window))
        if newest is not None:
            state.update((int(newest), [int(s) for s in window], [float(w) for w in window.values()]))
            state.setTimeoutDuration(millis)
        yield pd.DataFrame({key: [keys[0]] * len(rows), order: rows[order].values, "mean": means})

    types = dict(stream.dtypes)
    schema = f"{key} {types[key]}, {order} {types[order]}, mean double"
    held = "newest long, at array<long>, values array<double>"
    rows = stream.select(key, order, clock, value).where(F.col(key).isNotNull())
    return rows.groupBy(key).applyInPandasWithState(step, schema, held, "append", GroupStateTimeout.ProcessingTimeTimeout)
