"""Dates: checked ranges and their bounds in seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def checked_range(start: Column, end: Column, now: Column | None = None) -> Column:
    """(start, end, start_s, end_s) of two YYYY-MM-DD strings, ``end`` no later than ``now``.

    Null where a date can't be read or the start lies after the end; seconds are UTC."""
    a, b = (F.try_to_timestamp(x, F.lit("yyyy-MM-dd")) for x in (start, end))
    last = F.least(b, F.current_timestamp() if now is None else now)
    out = F.struct(F.to_date(a).alias("start"), F.to_date(last).alias("end"), F.unix_timestamp(a).alias("start_s"), F.unix_timestamp(last).alias("end_s"))
    return F.when(a.isNotNull() & b.isNotNull() & (a <= b), out)


def story_day(created: Column) -> Column:
    """The day of an ISO-8601 time with any zone as YYYY-MM-DD; '' if it can't be read."""
    return F.coalesce(F.date_format(F.try_to_timestamp(created), "yyyy-MM-dd"), F.lit(""))
