"""Sinks: documents, lines, tables by symbol, accepted and rejected answers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bellwether.functions.tickers import file_symbol
from bellwether.session import materialize

_COMPACT = {"ignoreNullFields": "false"}


def compact_json(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, json): each row as compact JSON, nulls kept."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*rest), _COMPACT).alias("json"))


def write_documents(df: DataFrame, path: str, ticker: str = "ticker", day: str = "as_of") -> None:
    """JSON documents in folders by day and file-safe ticker."""
    named = df.withColumn("symbol", file_symbol(F.col(ticker))).withColumn("day", F.date_format(day, "yyyyMMdd"))
    named.write.mode("overwrite").partitionBy("day", "symbol").option("ignoreNullFields", "false").json(path)


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_by_symbol(df: DataFrame, path: str, symbol: str = "symbol") -> None:
    """CSV with a header, in a folder for each symbol.  A hot symbol is written by many tasks."""
    df.write.mode("append").option("header", True).partitionBy(symbol).csv(path)


def write_texts(df: DataFrame, path: str, parts: str) -> None:
    """An array of paragraphs as one text a row, with blank lines between."""
    df.select(F.array_join(parts, "\n\n").alias("value")).write.mode("overwrite").option("lineSep", "\n\n\n").text(path)


def write_split(df: DataFrame, accepted: str, good: str, bad: str) -> None:
    """Rows for which ``accepted`` holds, and all others, to two places."""
    ok = F.coalesce(F.expr(accepted), F.lit(False))
    df = materialize(df)  # computed once for both
    df.where(ok).write.mode("overwrite").json(good)
    df.where(~ok).write.mode("overwrite").json(bad)


def unprocessed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key no finished output has."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def copy_by_symbol(symbols: DataFrame, source: str, target: str, overwrite: bool = False, ending: str = ".csv") -> DataFrame:
    """Copy the file of each symbol from folder to folder: (symbol, status).

    ``symbols`` has a column symbol.  The upper-case name is looked for first, then the lower-case one; the copy
    has the upper-case name.  The status is 'copied', 'copied_lower', 'skipped' where a copy is there and isn't to
    be overwritten, or 'missing'.  Every task copies its own symbols, between any folders that it can reach."""

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        (have, a), (to, b) = (fs.FileSystem.from_uri(x) for x in (source, target))
        there = lambda f, p: f.get_file_info(p).type == fs.FileType.File
        for batch in batches:
            done = []
            for s in batch["symbol"]:
                upper, lower, out = f"{a}/{s.upper()}{ending}", f"{a}/{s.lower()}{ending}", f"{b}/{s.upper()}{ending}"
                name = upper if there(have, upper) else lower if there(have, lower) else None
                if name is None:
                    done.append("missing")
                elif there(to, out) and not overwrite:
                    done.append("skipped")
                else:
                    to.create_dir(b, recursive=True)
                    fs.copy_files(name, out, source_filesystem=have, destination_filesystem=to)
                    done.append("copied" if name == upper else "copied_lower")
            yield pd.DataFrame({"symbol": batch["symbol"], "status": done})

    return materialize(symbols.select("symbol").where("symbol is not null").distinct().mapInPandas(copy, "symbol string, status string"))


def remembered(df: DataFrame, path: str, keys: list[str], compute) -> DataFrame:
    """What ``compute`` gives for the keys of ``df``, kept in the table at ``path``: keys that earlier runs have
    asked for are read from it, only new ones are computed, and then appended.

    ``compute`` takes the new keys and gives them with their values, a row each; keys it has no value for are
    asked again next time."""
    spark = df.sparkSession
    wanted = materialize(df.select(*keys).distinct())
    try:
        known = spark.read.parquet(path)
        known.columns
    except Exception:
        known = None
    fresh = materialize(compute(wanted if known is None else wanted.join(known.select(*keys), keys, "left_anti")))
    old = None if known is None else materialize(known.join(wanted, keys, "left_semi"))
    fresh.write.mode("append").parquet(path)
    return fresh if old is None else old.unionByName(fresh)
