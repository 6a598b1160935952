"""Incremental processing: new files only, appends by key, bars from a stream of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bellwether.operators.asof import keep_last


def process_new(spark: SparkSession, path: str, schema, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, fmt: str = "json") -> None:
    """Read the files of ``path`` that earlier runs haven't, transform them and append the result to ``out``.

    What is done is kept in ``checkpoint``; a run that is cut off is taken up where it stopped."""
    stream = spark.readStream.format(fmt).schema(schema).load(path)
    query = transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def append_by_key(stream: DataFrame, key: str, path: str, checkpoint: str) -> None:
    """Append each batch of a stream to folders by batch and key; a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy(key).parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def tumbling_bars(events: DataFrame, symbol: str, ts: str, price: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Open, high, low, close and count of the events in each window; events later than ``late`` are
    dropped once the watermark has passed them.  Events at one time are ordered by price."""
    order = F.struct(F.col(ts), F.col(price))
    rows = events.where(F.col(ts).isNotNull() & F.col(price).isNotNull()).withWatermark(ts, late)
    g = rows.groupBy(F.window(ts, width).alias("w"), symbol).agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), symbol, "open", "high", "low", "close", "n")


def run_bars(spark: SparkSession, path: str, schema, folder: str, width: str = "1 day") -> DataFrame:
    """All bars of the files in ``path``, by one run of the stream; each bar's last state, read back from ``folder``."""
    stream = spark.readStream.format("parquet").schema(schema).load(path).withColumn("ts", F.col("ts").cast("timestamp"))
    bars = tumbling_bars(stream, "event_type", "ts", "value", width)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/bars/batch={number}")

    # Bars are updated until the watermark passes them, which also lets go of their state.
    query = bars.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return keep_last(spark.read.parquet(f"{folder}/bars"), ["start", "event_type"], ["batch"]).drop("batch")
