"""Point-in-time index membership from the present members and a log of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: The grid of dates is held on the driver.
MAX_DATES = 10_000


def universe_asof(current: DataFrame, changes: DataFrame, dates: DataFrame, delisted: DataFrame) -> DataFrame:
    """(t, ticker) of the members at each date.

    ``current`` (ticker); ``changes`` (ticker, kind 'Added' or 'Removed', d, change_id unique); ``dates``
    (t); ``delisted`` (ticker).  Undoing all changes after t from the newest back leaves the oldest of
    them to decide: a ticker removed after t was a member, one added after t was none, one without a
    later change is a member if it is one now.  On one day a removal counts as the earlier change.
    Null and empty tickers are dropped, null dates and kinds ignored; repeated changes decide once."""
    log = changes.where("ticker is not null and d is not null and kind in ('Added', 'Removed')")
    order = F.struct(F.col("d"), F.when(F.col("kind") == "Removed", 0).otherwise(1), F.col("change_id"))
    # The dates are a short grid: every row meets them as an array, so no join is needed.
    grid = [r.t for r in dates.select("t").distinct().orderBy("t").limit(MAX_DATES + 1).collect()]
    if len(grid) > MAX_DATES:
        raise ValueError(f"more than {MAX_DATES} dates")
    at = F.array(*(F.lit(t) for t in grid)).cast("array<date>")
    later = log.select("ticker", "kind", order.alias("o"), F.explode(F.filter(at, lambda t: t < F.col("d"))).alias("t"))
    first = later.groupBy("t", "ticker").agg(F.min_by("kind", "o").alias("first_kind"))
    members = current.where("ticker is not null").select("ticker").distinct().select("ticker", F.explode(at).alias("t")).withColumn("now", F.lit(True))
    both = members.join(first, ["t", "ticker"], "full")
    was = both.where(F.when(F.col("first_kind").isNull(), F.col("now")).otherwise(F.col("first_kind") == "Removed"))
    return was.where("length(ticker) > 0").select("t", "ticker").join(delisted.select("ticker"), "ticker", "left_anti").select("t", "ticker")
