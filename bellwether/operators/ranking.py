"""Global row numbers without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bellwether.session import join_counted, materialize


def global_row_number(df: DataFrame, order: list[str], name: str = "rn") -> DataFrame:
    """``df`` with the position (from 1) of each row in the order of ``order``, which must end in a unique
    column; nulls first.

    Rows are range-partitioned and numbered within their partition; how many rows come before a partition is
    summed up over the partitions' counts, a row each, and joined."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    parts = materialize(df.repartitionByRange(*keys).withColumn("__p", F.spark_partition_id()))
    counts = parts.groupBy("__p").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = counts.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    w = Window.partitionBy("__p").orderBy(*keys)
    numbered = parts.withColumn("__rn", F.row_number().over(w).cast("bigint"))
    return join_counted(numbered, offsets, "__p").withColumn(name, F.col("__rn") + F.col("__before")).drop("__p", "__rn", "__before")


def shards(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Rows dealt to ``n`` shards in the order of ``order``."""
    return global_row_number(df, order).withColumn("shard", ((F.col("rn") - 1) % n).cast("int")).drop("rn")


def chunks(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Rows cut into chunks of ``size`` in the order of ``order``."""
    return global_row_number(df, order).withColumn("chunk", F.floor((F.col("rn") - 1) / size).cast("bigint")).drop("rn")
