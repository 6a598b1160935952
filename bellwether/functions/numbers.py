"""Arithmetic of floating-point numbers as SQL's engines without ANSI checks do it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quotient(a: Column, b: Column) -> Column:
    """``a`` / ``b`` of doubles by IEEE 754: over zero it is infinite, zero over zero not a number, and no error."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)
