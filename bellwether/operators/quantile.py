"""Exact grouped medians that stay distributed for a hot group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets a factor of e apart in value; the bucket of a median holds a thin slice of a group.
BUCKETS_PER_E = 256


def exact_median(df: DataFrame, key: str, value: str, name: str = "median") -> DataFrame:
    """One row (``key``, ``name``) per non-null key: the exact median of its non-null values ≥ 0.

    Values are counted by (key, logarithmic bucket) with map-side combination, the buckets that hold
    the two middle ranks are found from the counts, and only values inside them are ranked.  No task
    gets a whole group.  Even counts give the mean of both middle values.  Infinity and, above it, what is
    no number have buckets of their own, as they order in SQL.  Keys without values and empty input give no
    row; ties are ranks of equal values."""
    v = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).where("k is not null and v is not null")
    bucket = F.when(F.isnan("v"), 10**9 + 1).when(F.col("v") == float("inf"), 10**9).when(F.col("v") <= 0, -(10**9)).otherwise(F.floor(F.log("v") * BUCKETS_PER_E).cast("int"))
    v = v.withColumn("b", bucket)
    counts = v.groupBy("k", "b").count()
    w = Window.partitionBy("k").orderBy("b")
    c = counts.select("k", "b", "count", F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("count").over(Window.partitionBy("k")).alias("n"))
    c = c.withColumn("lo", F.expr("(n + 1) div 2")).withColumn("hi", F.expr("n div 2 + 1")).withColumn("before", F.expr("upto - count"))
    hit = c.where("(before < lo and lo <= upto) or (before < hi and hi <= upto)").select("k", "b", "before", "lo", "hi")
    inside = v.join(hit, ["k", "b"]).groupBy("k", "b", "before", "lo", "hi", "v").count()
    r = Window.partitionBy("k", "b").orderBy("v")
    ranked = inside.withColumn("last", F.col("before") + F.sum("count").over(r.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("first", F.col("last") - F.col("count") + 1)

    def at(rank: str) -> Column:
        return F.max(F.when((F.col("first") <= F.col(rank)) & (F.col(rank) <= F.col("last")), F.col("v")))

    return ranked.groupBy("k").agg(((at("lo") + at("hi")) / 2).alias(name)).withColumnRenamed("k", key)
