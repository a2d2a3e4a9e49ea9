"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a table that is written go with the job, not when the driver happens to collect garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _folder(spark: SparkSession) -> str:
    """The checkpoint folder of this session."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='ridgeline-')}")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that all executors share.

    The folder is the one that ``spark.checkpoint.dir`` names. Where none is set, a session of
    one process uses a folder of its own, and any other raises an error.
    """
    _folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as packed columns in the same folder, until ``drop`` deletes them."""
    spark = df.sparkSession
    path, before = f"{_folder(spark)}/round-{uuid.uuid4().hex}", spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._ridgeline_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` wrote and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._ridgeline_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
