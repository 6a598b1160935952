"""Predictions against what happened: scores per prediction, metrics per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bellwether.functions.numbers import quotient
from bellwether.operators.bars import label_backward
from bellwether.operators.quantile import exact_median

#: Columns of a prediction: model, symbol, t, pred_direction, pred_price, p_up, p_down, p_unchanged.
UNCHANGED_BAND = 0.005
CONFIDENCE = 0.55
#: The classes of a direction, in the order of their rank.
CLASSES = (-1, 0, 1)


def normalised(p: Column, total: Column) -> Column:
    return F.when(total > 0, p / total)


def brier(up: Column, down: Column, unchanged: Column, actual: Column) -> Column:
    """Sum of squared errors over the three classes."""
    parts = zip((up, down, unchanged), (1, -1, 0), strict=True)
    return sum(((p - (actual == c).cast("double")) * (p - (actual == c).cast("double")) for p, c in parts), F.lit(0.0))


def ranked_probability(down: Column, unchanged: Column, actual: Column) -> Column:
    """Squared errors of the cumulated probabilities, from down over unchanged to up."""
    first = down - (actual <= -1).cast("double")
    second = down + unchanged - (actual <= 0).cast("double")
    return first * first + second * second


def score_predictions(predictions: DataFrame, bars: DataFrame, band: float = UNCHANGED_BAND) -> DataFrame:
    """One row per prediction with a label: actual values, normalised probabilities, Brier, RPS, APE.

    Predictions without market data drop out; one without a value keeps its row with nulls.  A total
    probability of zero or less gives no probabilities."""
    keys = predictions.select("symbol", "t").distinct()
    labels = label_backward(keys, bars, band).withColumnRenamed("direction", "actual_direction")
    x = predictions.join(labels, ["symbol", "t"])
    total = F.coalesce("p_up", F.lit(0.0)) + F.coalesce("p_down", F.lit(0.0)) + F.coalesce("p_unchanged", F.lit(0.0))
    has = F.col("p_up").isNotNull() | F.col("p_down").isNotNull() | F.col("p_unchanged").isNotNull()
    for c in ("p_up", "p_down", "p_unchanged"):
        x = x.withColumn(f"__{c}", F.when(has, normalised(F.coalesce(c, F.lit(0.0)), total)))
    x = x.select(*(F.col(f"__{c}").alias(c) if c in ("p_up", "p_down", "p_unchanged") else c for c in predictions.columns), "actual_direction", F.col("next_date").alias("d"), "base_close", "next_open", "next_close")
    scored = x.withColumn("intraday", F.try_divide(F.col("next_close") - F.col("next_open"), F.col("next_open")))
    scored = scored.withColumn("brier", brier(F.col("p_up"), F.col("p_down"), F.col("p_unchanged"), F.col("actual_direction")))
    scored = scored.withColumn("rps", ranked_probability(F.col("p_down"), F.col("p_unchanged"), F.col("actual_direction")))
    return scored.withColumn("ape", F.abs(F.try_divide(F.col("pred_price") - F.col("next_close"), F.col("next_close"))))


def _grouped(df: DataFrame, sets: list[list[str]], *aggs: Column) -> DataFrame:
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(*aggs)


def _set_id(members: list[str], keys: list[str]) -> int:
    """The number ``grouping_id`` gives a grouping set: a bit for each key it leaves out."""
    return sum(1 << i for i, k in enumerate(reversed(keys)) if k not in members)


def metric_suite(scored: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Probabilistic, classification and regression metrics of each grouping set, in one aggregation.

    Accuracy, weighted F1 and Matthews' coefficient are counted from the confusion table and only given
    where more than one class happened; a measure without rows is null.  A price of zero foretold as zero
    has no symmetric error: sMAPE of its groups is not a number."""
    labelled = F.col("pred_direction").isNotNull() & F.col("actual_direction").isNotNull()
    priced = F.col("pred_price").isNotNull() & F.col("next_close").isNotNull()
    gap = F.col("next_close") - F.col("pred_price")
    counts = [F.count_if(labelled).cast("double").alias("n"), F.count_if(labelled & (F.col("pred_direction") == F.col("actual_direction"))).cast("double").alias("right")]
    for i, c in enumerate(CLASSES):
        actual, pred = labelled & (F.col("actual_direction") == c), labelled & (F.col("pred_direction") == c)
        counts += [F.count_if(actual).cast("double").alias(f"a{i}"), F.count_if(pred).cast("double").alias(f"p{i}"), F.count_if(actual & pred).cast("double").alias(f"h{i}")]
    g = _grouped(
        scored,
        sets,
        F.count("*").alias("n_rows"),
        F.avg("rps").alias("rps"),
        F.avg("brier").alias("brier"),
        F.sqrt(F.avg(F.when(priced, gap * gap))).alias("rmse"),
        F.avg(F.when(priced, quotient(2 * F.abs(gap), F.abs("next_close") + F.abs("pred_price")))).alias("smape"),
        F.grouping_id().alias("__set"),
        *counts,
    )
    keys = list(dict.fromkeys(k for s in sets for k in s))
    # Medians by set and group, as one key; a model may hold any share of the rows.
    group = lambda s: F.to_json(F.struct(F.lit(_set_id(s, keys)).alias("set"), *(F.col(k) for k in s)))
    each = scored.where(priced).select("ape", F.explode(F.array(*(group(s) for s in sets))).alias("__group"))
    own = F.coalesce(*(F.when(F.col("__set") == _set_id(s, keys), group(s)) for s in sets))
    g = g.withColumn("__group", own).join(exact_median(each, "__group", "ape", "mdape"), "__group", "left")
    many = sum(((F.col(f"a{i}") > 0).cast("int") for i in range(3)), F.lit(0)) > 1
    f1 = sum((F.col(f"a{i}") / F.col("n") * F.coalesce(F.try_divide(2 * F.col(f"h{i}"), F.col(f"a{i}") + F.col(f"p{i}")), F.lit(0.0)) for i in range(3)), F.lit(0.0))
    pt = sum((F.col(f"a{i}") * F.col(f"p{i}") for i in range(3)), F.lit(0.0))
    pp = sum((F.col(f"p{i}") * F.col(f"p{i}") for i in range(3)), F.lit(0.0))
    tt = sum((F.col(f"a{i}") * F.col(f"a{i}") for i in range(3)), F.lit(0.0))
    root = F.sqrt((F.col("n") * F.col("n") - pp) * (F.col("n") * F.col("n") - tt))
    mcc = F.when(root == 0, 0.0).otherwise((F.col("right") * F.col("n") - pt) / root)
    g = g.withColumn("accuracy", F.when(many, F.col("right") / F.col("n"))).withColumn("f1_weighted", F.when(many, f1)).withColumn("mcc", F.when(many, mcc))
    return g.select(*keys, "n_rows", "rps", "brier", "accuracy", "f1_weighted", "mcc", "rmse", "smape", "mdape")


def movement_metrics(df: DataFrame, by: str = "symbol") -> DataFrame:
    """Accuracy and F1 of class 1 of each group from target and prediction."""
    hit = F.count_if((F.col("target") == 1) & (F.col("prediction") == 1)).cast("double")
    said, was = F.count_if(F.col("prediction") == 1).cast("double"), F.count_if(F.col("target") == 1).cast("double")
    both = F.col("target").isNotNull() & F.col("prediction").isNotNull()
    return df.where(both).groupBy(by).agg((F.count_if(F.col("target") == F.col("prediction")) / F.count("*")).alias("accuracy"), F.coalesce(F.try_divide(2 * hit, said + was), F.lit(0.0)).alias("f1"))


def long_report(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics in rows: (keys…, metric, value)."""
    return metrics.unpivot(keys, [c for c in metrics.columns if c not in keys and c != "n_rows"], "metric", "value")


def wide_report(metrics: DataFrame, key: str, values: list[str]) -> DataFrame:
    """The report of one key: a row for each metric, a column for each of ``values``, null where it has none."""
    return long_report(metrics.where(F.col(key).isin(values)), [key]).groupBy("metric").pivot(key, values).agg(F.first("value"))
