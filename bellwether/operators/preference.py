"""Preference pairs: candidate answers against a label, the better one chosen."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bellwether.functions.jsonx import candidates

CANDIDATE = "valid boolean, direction bigint, price double"


def _coerced(value, kind):
    """A number from a number or its text; booleans and anything else are none."""
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        return None
    try:
        return kind(value)
    except (ValueError, OverflowError):
        return None


def read_candidate(text: str | None) -> tuple[bool, int | None, float | None]:
    """(valid, direction, price) of an answer whose object has both in ``output``."""
    found = candidates(text, "outer")
    output = found[-1].get("output") if found and isinstance(found[-1], dict) else None
    if not isinstance(output, dict):
        return False, None, None
    price, direction = _coerced(output.get("next_day_closing_price"), float), _coerced(output.get("next_day_direction"), int)
    if price is None or direction is None or price != price:
        return False, None, None
    return True, direction, price


def _read_batch(answers: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_candidate(a) for a in answers], columns=["valid", "direction", "price"]).astype({"valid": bool, "direction": "Int64", "price": float})


def candidate(answer: Column) -> Column:
    return F.pandas_udf(_read_batch, CANDIDATE)(answer)


def winner(valid1: Column, right1: Column, error1: Column, valid2: Column, right2: Column, error2: Column) -> Column:
    """1 or 2, or 0 if both are invalid: validity before direction before the smaller error; ties go to 2."""
    return (
        F.when(~valid1 & ~valid2, 0)
        .when(valid1 & ~valid2, 1)
        .when(~valid1 & valid2, 2)
        .when(right1 & ~right2, 1)
        .when(~right1 & right2, 2)
        .when(error1 < error2, 1)
        .otherwise(2)
    )


def preference_pairs(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``pairs`` (pair_id, symbol, t, input, output1, output2, timeseries) with a label
    (symbol, t, next_close, direction): chosen and rejected answers, the winner and its error.

    Pairs with a missing input or answer, without a label or with two invalid answers drop out."""
    whole = pairs.where("input is not null and output1 is not null and output2 is not null")
    read = whole.select("*", candidate(F.col("output1")).alias("c1"), candidate(F.col("output2")).alias("c2"))
    x = read.join(labels.select("symbol", "t", F.col("next_close").alias("actual_close"), F.col("direction").alias("actual_direction")), ["symbol", "t"])
    for i in "12":
        x = x.withColumn(f"right{i}", F.coalesce(F.col(f"c{i}.direction") == F.col("actual_direction"), F.lit(False))).withColumn(f"error{i}", F.abs(F.try_divide(F.col(f"c{i}.price") - F.col("actual_close"), F.col("actual_close"))))
    x = x.withColumn("winner", winner(F.col("c1.valid"), F.col("right1"), F.col("error1"), F.col("c2.valid"), F.col("right2"), F.col("error2"))).where("winner > 0")
    first = F.col("winner") == 1

    def pick(a: str, b: str) -> Column:
        return F.when(first, F.col(a)).otherwise(F.col(b))

    return x.select("pair_id", "symbol", "t", "input", "timeseries", "winner", "actual_close", pick("error1", "error2").alias("winner_error"), pick("output1", "output2").alias("chosen"), pick("output2", "output1").alias("rejected"))
