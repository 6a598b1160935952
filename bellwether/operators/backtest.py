"""Portfolio simulations and baselines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from bellwether.functions.numbers import quotient
from bellwether.operators.bars import business_days, by_symbol
from bellwether.session import materialize
from bellwether.operators.scoring import CONFIDENCE

CAPITAL, COST, RISK_FREE, YEAR = 100_000.0, 0.0005, 0.04, 252
#: The shares of cash spent and of stock sold by risk profile.
PROFILES = {"Conservative": (0.50, 1.00), "M.Conservative": (0.70, 1.00), "M.Aggressive": (1.00, 0.50), "Aggressive": (1.00, 0.30)}


def positions(up: Column, down: Column, threshold: float = CONFIDENCE) -> Column:
    """1 if up is confident, −1 if down is (which decides if both are), else 0."""
    return F.when(down > threshold, -1).when(up > threshold, 1).otherwise(0)


def simulate(rows: DataFrame, model: str = "model") -> DataFrame:
    """(model, annual_return, sharpe, max_drawdown) of equal-weight daily portfolios.

    ``rows``: model, symbol, d, position, intraday.  A day's return is the mean over all its rows, those
    without a position included; business days of the whole period without rows earn the risk-free
    rate.  The daily series of a model is bounded by the calendar."""
    daily_rate = (1 + RISK_FREE) ** (1 / YEAR) - 1
    trade = F.col("position") * F.col("intraday") - F.abs("position") * COST
    daily = materialize(rows.groupBy(model, "d").agg((F.sum(trade) / F.count("symbol")).alias("ret")))
    span = daily.agg(F.min("d").alias("a"), F.max("d").alias("b"))
    return _simulated(daily, span.first(), model, daily_rate)


def _simulated(daily: DataFrame, period: Row | None, model: str, rate: float) -> DataFrame:
    if period is None or period.a is None:
        return daily.select(model).distinct().select(model, *(F.lit(0.0).alias(c) for c in ("annual_return", "sharpe", "max_drawdown")))
    spine = daily.select(model).distinct().withColumn("d", F.explode(business_days(F.lit(period.a), F.lit(period.b))))
    w = Window.partitionBy(model).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    full = spine.join(daily, [model, "d"], "left").withColumn("ret", F.coalesce("ret", F.lit(rate)))
    full = full.withColumn("value", F.product(1 + F.col("ret")).over(w) * CAPITAL)
    full = full.withColumn("fall", F.col("value") / F.max("value").over(w) - 1)
    spread = F.stddev_samp(F.col("ret") - rate)
    g = full.groupBy(model).agg(F.max_by("value", "d").alias("last"), F.count("*").alias("n"), F.avg(F.col("ret") - rate).alias("mean"), spread.alias("sd"), F.min("fall").alias("max_drawdown"))
    annual = F.pow(F.col("last") / CAPITAL, F.lit(float(YEAR)) / F.col("n")) - 1
    sharpe = F.when(F.col("sd") > 0, F.col("mean") / F.col("sd") * YEAR**0.5).otherwise(0.0)
    return g.select(model, annual.alias("annual_return"), sharpe.alias("sharpe"), "max_drawdown")


def reversal_baseline(bars: DataFrame) -> DataFrame:
    """Bars with a position by the sign of the last change but one, and their intraday return."""
    ok = bars.where("open is not null and close is not null and open <> 0")
    w = by_symbol()
    sign = F.signum(F.lag("close", 1).over(w) - F.lag("close", 2).over(w))
    return ok.select("symbol", "d", F.coalesce(sign, F.lit(0.0)).cast("int").alias("position"), ((F.col("close") - F.col("open")) / F.col("open")).alias("intraday"))


def random_baseline(bars: DataFrame) -> DataFrame:
    """Bars with a position that looks random but is the same in every run: a congruence of day and symbol."""
    ok = bars.where("open is not null and close is not null and open <> 0")
    day = F.datediff(F.col("d"), F.lit("1970-01-01").cast("date")).cast("bigint")
    letters = F.aggregate(F.split("symbol", ""), F.lit(7).cast("bigint"), lambda a, c: F.when(c == "", a).otherwise((a * 31 + F.ascii(c)) % 1000003))
    return ok.select("symbol", "d", ((letters * 7919 + day * 104729) % 1000003 % 3 - 1).cast("int").alias("position"), ((F.col("close") - F.col("open")) / F.col("open")).alias("intraday"))


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, which is computed once however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def _day(s: Column, r: Column) -> Column:
    """The state ``s`` of a profile's fold after the day ``r``."""
    buys, sells = (r["p"] == 1) & (s["cash"] > 1), (r["p"] == 0) & (s["shares"] > 0)
    cash = F.when(buys, s["cash"] - s["cash"] * F.col("buy")).when(sells, s["cash"] + s["shares"] * F.col("sell") * r["c"]).otherwise(s["cash"])
    shares = F.when(buys, s["shares"] + quotient(s["cash"] * F.col("buy"), r["c"])).when(sells, s["shares"] - s["shares"] * F.col("sell")).otherwise(s["shares"])

    def after(h: Column, value: Column, step: Column, mean: Column) -> Column:
        top = F.greatest(s["top"], value)
        fall = F.greatest(s["fall"], (top - value) / top)
        squares = s["squares"] + (step - mean) * (step - s["mean"])
        state = {"cash": h["cash"], "shares": h["shares"], "value": value, "top": top, "fall": fall, "n": s["n"] + 1, "sum": s["sum"] + step, "mean": mean, "squares": squares}
        return F.struct(*(x.alias(k) for k, x in state.items()))

    def stepped(h: Column, value: Column) -> Column:
        return _with(quotient(value, s["value"]) - 1, lambda step: _with(s["mean"] + (step - s["mean"]) / (s["n"] + 1), lambda mean: after(h, value, step, mean)))

    return _with(F.struct(cash.alias("cash"), shares.alias("shares")), lambda h: _with(h["cash"] + h["shares"] * r["c"], lambda value: stepped(h, value)))


def risk_profiles(rows: DataFrame) -> DataFrame:
    """(profile, symbol, annual_return, max_drawdown, sharpe) of cash-and-shares simulations.

    ``rows``: symbol, d, close, prediction (1 buy, 0 sell); one row a day, null closes left out.  The
    recursion has no closed form, so each symbol's days are folded in order; they are bounded by the
    calendar.  The fold carries sums and extremes, not the path: its work is in proportion to the days.
    Symbols with all rows on one day have no annual return.  What is worth nothing after a close
    of zero rises without bound, or by no number from zero to zero: Sharpe ratios of such paths are no numbers."""
    buy = F.explode(F.array(*(F.struct(F.lit(k).alias("profile"), F.lit(b).alias("buy"), F.lit(s).alias("sell")) for k, (b, s) in PROFILES.items())))
    days = rows.where("close is not null and prediction is not null").groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("d", F.col("prediction").cast("int").alias("p"), F.col("close").cast("double").alias("c")))).alias("days"))
    x = days.select("symbol", "days", buy.alias("o")).select("symbol", "days", "o.*")
    start = {"cash": CAPITAL, "shares": 0.0, "value": CAPITAL, "top": CAPITAL, "fall": 0.0, "n": 0.0, "sum": 0.0, "mean": 0.0, "squares": 0.0}
    folded = F.aggregate("days", F.struct(*(F.lit(v).alias(k) for k, v in start.items())), _day)
    y = x.select("profile", "symbol", F.expr("datediff(element_at(days, -1).d, days[0].d)").alias("span"), folded.alias("f")).select("profile", "symbol", "span", "f.*")
    sd = F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1)))
    y = y.withColumn("sd", sd)
    annual = F.when(F.col("span") > 0, F.pow(F.col("value") / CAPITAL, F.lit(365.0) / F.col("span")) - 1)
    sharpe = F.when(F.col("sd") == 0, 0.0).otherwise(F.col("sum") / F.col("n") / F.col("sd") * YEAR**0.5)
    return y.select("profile", "symbol", annual.alias("annual_return"), F.col("fall").alias("max_drawdown"), sharpe.alias("sharpe"))
