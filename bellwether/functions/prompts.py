"""Prompts: templates filled from columns, series announced by their bounds, a place for each series.

A template is text with ``{name}`` for a column; the texts themselves are the caller's."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Fixed value: where a model finds a series.
PLACE = "<ts><ts/>"


def fill(template: str, **columns: Column) -> Column:
    """The template with its names replaced; nulls are left blank."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.lit(p) if i % 2 == 0 else F.coalesce(columns[p].cast("string"), F.lit("")) for i, p in enumerate(parts)))


def named_series(series: dict[str, Column]) -> Column:
    """(name, v) of the series that have values, in the order given."""
    all_ = F.array(*(F.struct(F.lit(n).alias("name"), F.coalesce(c, F.array().cast("array<double>")).alias("v")) for n, c in series.items()))
    return F.filter(all_, lambda x: F.size(x["v"]) > 0)


def series_notes(series: Column) -> Column:
    """A line for each series with its bounds to four places, and its place."""
    return F.array_join(F.transform(series, lambda x: F.format_string(f"%s: Min: %.4f, Max: %.4f {PLACE}", x["name"], F.array_min(x["v"]), F.array_max(x["v"]))), "\n")


def answer_text(reasoning: Column, prediction: Column) -> Column:
    """Reasoning and prediction as one answer; without reasoning the prediction as it is."""
    return F.when(reasoning.isNotNull(), F.concat(reasoning, F.lit("\n\nFinal Prediction: "), F.coalesce(prediction, F.lit("")))).otherwise(prediction)


def with_model(df: DataFrame, prompt: str, model: Callable[[list[str]], list[str]], name: str = "answer") -> DataFrame:
    """``df`` with the model's answers to its prompts, a batch at a time; prompts of like length lie together."""
    schema = StructType([*df.schema.fields, StructField(name, StringType())])

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in it:
            rows = rows.sort_values(prompt, key=lambda c: c.str.len())
            yield rows.assign(**{name: model(rows[prompt].tolist())})

    return df.mapInPandas(batches, schema)
