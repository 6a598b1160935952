"""Queries that run a stream to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bellwether.session import shared_dir, table
from bellwether.streaming.incremental import run_bars


def q_stream_bars(spark, d):
    """Daily bars of event values by type, from a stream over the events file."""
    schema = table(spark, d, "events").schema
    out = run_bars(spark, f"{d}/events.parquet*", schema, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}")
    return out.select(F.col("start").cast("date").alias("d"), "event_type", "open", "high", "low", "close", "n")


QUERIES = {"q_stream_bars": q_stream_bars}
SQL = {
    "q_stream_bars": """SELECT CAST(ts AS DATE) AS d, event_type, min_by(value, (ts, value)) AS open, max(value) AS high, min(value) AS low, max_by(value, (ts, value)) AS close, count(*) AS n
FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2"""
}
