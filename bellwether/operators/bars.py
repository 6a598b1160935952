"""Price bars: one per symbol and day, windows of them, labels from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bellwether.functions.numbers import quotient
from bellwether.functions.tickers import market_symbol
from bellwether.operators.asof import asof_backward, keep_last

#: A split day changes the price level, so a label across it means nothing.
BACK_DAYS, FORWARD_DAYS = 40, 10
SERIES = ("open", "high", "low", "close", "volume")


def daily_bars(raw: DataFrame) -> DataFrame:
    """(symbol, d, open, high, low, close, volume, split): of repeated bars the latest fetched.

    Symbols in another spelling are one symbol; rows without symbol or day are dropped.  After this a
    symbol has at most one row a day, so windows over a symbol are bounded by the calendar."""
    named = raw.where("ticker is not null and bar_date is not null").select(market_symbol(F.col("ticker")).alias("symbol"), F.col("bar_date").alias("d"), *(F.col(f"{c}_price").alias(c) for c in SERIES[:4]), "volume", F.coalesce("stock_splits", F.lit(0.0)).alias("split"), "fetched_at", "bar_id")
    return keep_last(named, ["symbol", "d"], ["fetched_at", "bar_id"]).drop("fetched_at", "bar_id")


def by_symbol() -> Window:
    return Window.partitionBy("symbol").orderBy("d")


def last_values(bars: DataFrame, keys: DataFrame, days: int = 365, points: int = 256) -> DataFrame:
    """Per key (symbol, t) the series of the bars in [t − days, t), at most ``points`` each; nulls are
    left out series by series, so series may differ in length.  Keys without bars have empty series."""
    low = F.date_sub("t", days)
    joined = keys.join(bars, (keys["symbol"] == bars["symbol"]) & (bars["d"] >= low) & (bars["d"] < keys["t"]), "left").select(keys["symbol"], "t", "d", *SERIES)

    def series(c: str) -> Column:
        kept = F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("d", c))))
        values = F.transform(kept, lambda x: x[c].cast("double"))
        return F.slice(values, F.greatest(F.lit(1), F.size(values) - (points - 1)), points).alias(c)

    return joined.groupBy("symbol", "t").agg(*(series(c) for c in SERIES))


def following_values(bars: DataFrame, keys: DataFrame, first: int = 1, days: int = 90) -> DataFrame:
    """Per key (symbol, t) the series of the bars in [t + first, t + days)."""
    shifted = keys.select("symbol", F.date_add("t", days).alias("t")).distinct()
    return last_values(bars, shifted, days - first, days).withColumn("t", F.date_sub("t", days))


def direction(change: Column, band: float = 0.0) -> Column:
    """1, −1 or, within ``band`` of no change, 0."""
    return F.when(F.abs(change) <= band, 0).when(change > 0, 1).when(change < 0, -1)


def label_forward(keys: DataFrame, bars: DataFrame) -> DataFrame:
    """Keys (symbol, t) with the first two bars on or after t within ten days; keys without two drop out.

    A key meets its days by equality: ten rows a key, no range join."""
    days = keys.select("symbol", "t", F.explode(F.expr(f"sequence(t, date_add(t, {FORWARD_DAYS - 1}))")).alias("d"))
    met = days.join(bars.select("symbol", "d", "close"), ["symbol", "d"])
    two = met.groupBy("symbol", "t").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "close"))), 1, 2).alias("two")).where("size(two) = 2")
    out = two.select("symbol", "t", F.expr("two[0].d").alias("base_date"), F.expr("two[0].close").alias("base_close"), F.expr("two[1].d").alias("next_date"), F.expr("two[1].close").alias("next_close"))
    return out.withColumn("direction", direction(F.col("next_close") - F.col("base_close")))


def label_backward(keys: DataFrame, bars: DataFrame, band: float = 0.005) -> DataFrame:
    """Keys (symbol, t) with the last bar on or before t and the one after it; keys drop out without
    either, if they lie outside [t − 40, t + 10), or if the next day is a split day.

    From a close of zero any change is infinite; zero after zero is not a number, which orders above all
    numbers, so its direction is 1 as in the SQL."""
    w = by_symbol()
    nxt = [F.lead(c).over(w).alias(f"next_{n}") for c, n in (("d", "date"), ("open", "open"), ("close", "close"), ("split", "split"))]
    right = bars.select("symbol", F.col("d").alias("base_date"), F.col("close").alias("base_close"), *nxt)
    met = asof_backward(keys, right, "symbol", "t", "base_date")
    ok = met.where(f"base_date >= date_sub(t, {BACK_DAYS}) and next_date < date_add(t, {FORWARD_DAYS}) and next_split = 0").drop("next_split")
    return ok.withColumn("direction", direction(quotient(F.col("next_close") - F.col("base_close"), F.col("base_close")), band))


def movement_targets(bars: DataFrame, null_last: bool = False) -> DataFrame:
    """Bars with target = 1 if the next close is higher, else 0; the last bar's is 0, or null on request."""
    nxt = F.lead("close").over(by_symbol())
    target = (nxt > F.col("close")).cast("int")
    return bars.withColumn("target", target if null_last else F.coalesce(target, F.lit(0)))


def trailing_closes(bars: DataFrame, rows: int = 31) -> DataFrame:
    """(symbol, d, history): the closes of the last ``rows`` bars up to each, oldest first."""
    w = by_symbol().rowsBetween(-(rows - 1), 0)
    return bars.select("symbol", "d", F.collect_list("close").over(w).alias("history"))


def series_bounds(df: DataFrame, names: tuple[str, ...] = SERIES) -> DataFrame:
    """Each series with its least and greatest value; an empty one has 0 and 1."""
    for c in names:
        df = df.withColumn(f"{c}_min", F.coalesce(F.array_min(c), F.lit(0.0))).withColumn(f"{c}_max", F.coalesce(F.array_max(c), F.lit(1.0)))
    return df


def date_spine(spark, start: str, end: str, step_days: int, name: str = "t") -> DataFrame:
    """Dates from ``start`` to ``end`` inclusive, every ``step_days`` days."""
    return spark.sql(f"SELECT explode(sequence(DATE '{start}', DATE '{end}', INTERVAL {step_days} DAY)) AS {name}")


def business_days(start: Column, end: Column) -> Column:
    """Mondays to Fridays between two dates, inclusive; null if one is null, empty if end is before start."""
    days = F.when(end >= start, F.sequence(start, end)).when(end < start, F.array().cast("array<date>"))
    return F.filter(days, lambda x: F.weekday(x) < 5)
