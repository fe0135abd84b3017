"""Ordered computations without a single-task window.

Rows are range-partitioned by the order, each partition is scanned on its own,
and the partitions' totals (one row each) are summed up before being added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import ensure_checkpoint_dir


def running_total(rows: DataFrame, order: list[Column], value: Column, name: str, partitions: int | None = None) -> DataFrame:
    """rows plus ``name``: the sum of ``value`` up to and with the row. The order must be total."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    width = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("_v", value).repartitionByRange(width, *order).withColumn("_p", F.spark_partition_id()).checkpoint()
    totals = ranged.groupBy("_p").agg(F.sum("_v").alias("_t"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_p", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn(name, F.sum("_v").over(inside)).join(F.broadcast(offsets), "_p").withColumn(name, F.col(name) + F.col("_before")).drop("_p", "_v", "_before")


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows plus their place in the order, from 1."""
    return running_total(rows, order, F.lit(1).cast("long"), name)


def dense_codes(ids: DataFrame, column: str) -> DataFrame:
    """Every distinct value of ``column`` with a code from 0 in its order."""
    distinct = ids.select(column).where(F.col(column).isNotNull()).distinct()
    return ranked(distinct, [F.col(column)], "_r").select(column, (F.col("_r") - 1).alias("code"))
