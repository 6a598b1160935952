"""As-of joins and rolling lists over time, split by period so that a hot key is no single task.

Both sides are merged and windowed within (key, month) only; what earlier months leave behind is one
small row per key and month, carried forward in a second, tiny window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each group of ``keys`` by ``order``, which should end in a unique column.

    Combined before the shuffle; null keys are a group like any other.  Nulls order first."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*(F.struct(F.col(c).isNotNull(), F.col(c)) for c in order))).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, "__row.*").select(*df.columns)


def asof_backward(left: DataFrame, right: DataFrame, by: str, on: str, right_on: str | None = None, strict: bool = False) -> DataFrame:
    """Each row of ``left`` with the last row of ``right`` of the same ``by`` at or before ``on`` (before
    it, if ``strict``), as columns; nulls where there is none.

    ``right`` must be unique by (``by``, ``right_on``); its other columns must not clash with those of
    ``left``.  The row is carried whole: a null in the newest row is not filled from an older one.
    Rows of ``left`` with a null key or date keep nulls, rows of ``right`` with one are never met.
    ``on`` is a date."""
    right_on = right_on or on
    payload = [c for c in right.columns if c != by]
    side = F.lit(1 if not strict else -1)
    a = left.select(F.col(by).alias("k"), F.col(on).alias("t"), side.alias("s"), F.struct(*left.columns).alias("l"), F.lit(None).cast(right.select(F.struct(*payload).alias("r")).schema["r"].dataType).alias("r"))
    b = right.where(F.col(by).isNotNull() & F.col(right_on).isNotNull()).select(F.col(by).alias("k"), F.col(right_on).alias("t"), F.lit(0).alias("s"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType).alias("l"), F.struct(*payload).alias("r"))
    both = a.unionByName(b).withColumn("m", F.trunc("t", "MM"))
    within = Window.partitionBy("k", "m").orderBy("t", "s").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("r", F.last("r", ignorenulls=True).over(within)).where("s <> 0")
    # What the months leave behind: the last row of each, carried to the months that ask.
    left_over = b.withColumn("m", F.trunc("t", "MM")).groupBy("k", "m").agg(F.max_by("r", "t").alias("c"))
    asks = a.where("k is not null and t is not null").select("k", F.trunc("t", "MM").alias("m")).distinct()
    months = left_over.join(asks.withColumn("ask", F.lit(True)), ["k", "m"], "full")
    before = Window.partitionBy("k").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    carried = months.withColumn("c", F.last("c", ignorenulls=True).over(before)).where("ask and c is not null").select("k", "m", "c")
    joined = met.join(carried, ["k", "m"], "left").withColumn("r", F.coalesce("r", "c"))
    return joined.select("l.*", *(F.when(F.col("k").isNotNull() & F.col("t").isNotNull(), F.col("r")[c]).alias(c) for c in payload))


def rolling_last(df: DataFrame, by: str, on: str, tie: str, value: Column, n: int, name: str) -> DataFrame:
    """(``by``, ``on``, ``name``): per key and date the last ``n`` values up to that date, oldest first.

    Rows are ordered by date and then ``tie``; one row per (key, date)."""
    rows = df.where(F.col(by).isNotNull() & F.col(on).isNotNull()).select(by, on, F.trunc(on, "MM").alias("__m"), F.struct(F.col(tie).alias("t"), value.alias("v")).alias("__v"))
    days = rows.groupBy(by, on, "__m").agg(F.array_sort(F.collect_list("__v")).alias("__d"))
    w = Window.partitionBy(by, "__m").orderBy(on).rowsBetween(-(n - 1), 0)
    tail = lambda a: F.slice(a, F.greatest(F.lit(1), F.size(a) - (n - 1)), n)
    within = days.withColumn("__w", tail(F.flatten(F.collect_list("__d").over(w))))
    months = within.groupBy(by, "__m").agg(F.max_by("__w", on).alias("__e"))
    before = Window.partitionBy(by).orderBy("__m").rowsBetween(-n, -1)
    carried = months.withColumn("__c", tail(F.flatten(F.collect_list("__e").over(before)))).select(by, "__m", "__c")
    out = within.join(carried, [by, "__m"], "left")
    return out.select(by, on, F.transform(tail(F.concat("__c", "__w")), lambda x: x["v"]).alias(name))
