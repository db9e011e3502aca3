"""Positions and running sums over a global order, without one task for all rows.

A window without partitions sorts everything in one task. Here rows are range-partitioned and sorted; each
partition's count and sum go to the driver (two numbers a partition), and every row adds its partition's
start to a window within the partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def with_offsets(df: DataFrame, order: list[str], size: str = "size") -> DataFrame:
    """``df`` with ``position`` (from 1) and ``offset`` (sum of ``size`` before) in ``order``, which must
    tell rows apart; null sizes count as zero."""
    keys = [F.asc_nulls_first(c) for c in order]
    bytes_: Column = F.coalesce(F.col(size), F.lit(0)).cast("long")
    dealt = checkpointed(df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))
    totals = dealt.groupBy("__part").agg(F.count("*").alias("n"), F.sum(bytes_).alias("b")).orderBy("__part").collect()
    starts, n, b = [], 0, 0
    for r in totals:
        starts.append((r["__part"], n, b))
        n, b = n + r.n, b + (r.b or 0)
    spark = df.sparkSession
    begin = F.broadcast(spark.createDataFrame(starts or [(-1, 0, 0)], "__part int, __n long, __b long"))
    own = Window.partitionBy("__part").orderBy(*keys)
    before = F.coalesce(F.sum(bytes_).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(begin, "__part").select(*df.columns, (F.col("__n") + F.row_number().over(own)).cast("long").alias("position"), (F.col("__b") + before).cast("long").alias("offset"))
