"""Global prefix sums from per-partition totals (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialize


def prefix_sums(df: DataFrame, order: list[str], values: list[str], group: str | None = None) -> DataFrame:
    """Add ``<value>_before``, the exclusive running sum in ``order``, to every row.

    Rows are dealt to partitions by range of ``order``, so a large group spans many of
    them. The totals of partitions (and groups) are few and are summed first; each row
    then adds its partition's offset to the running sum inside the partition. ``group``
    must lead ``order`` where it is given. The dealt rows are written once, since range
    partitioning samples and need not repeat itself.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["_part", *([group] if group else [])]
    dealt = materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy(*keys).agg(*(F.sum(v).alias(v) for v in values))
    earlier = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy("_part")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(
        totals.select(*keys, *(F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_{v}") for v in values))
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.select("*", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_in_{v}") for v in values))
    rows = rows.join(offsets, keys)
    sums = {f"{v}_before": F.col(f"_{v}") + F.col(f"_in_{v}") for v in values}
    drop = ["_part", *(f"_{v}" for v in values), *(f"_in_{v}" for v in values)]
    return rows.withColumns(sums).drop(*drop)
