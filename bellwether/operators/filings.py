"""Filings as they were known at a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bellwether.functions.tickers import registry_symbol
from bellwether.operators.asof import asof_backward, keep_last, rolling_last


def distinct_filings(raw: DataFrame) -> DataFrame:
    """One row per accession number, the latest loaded: (symbol, accession, cik, form, filed, url, document, paragraphs)."""
    named = raw.where("accession_number is not null").select(registry_symbol(F.col("ticker")).alias("symbol"), F.col("accession_number").alias("accession"), "cik", F.upper("form_type").alias("form"), F.col("filing_date").alias("filed"), F.col("filing_url").alias("url"), F.col("primary_document").alias("document"), "paragraphs", "ingested_at", "filing_id")
    return keep_last(named, ["accession"], ["ingested_at", "filing_id"]).drop("ingested_at", "filing_id")


def _latest(filings: DataFrame, form: str, prefix: str) -> DataFrame:
    of = filings.where((F.col("form") == form) & F.col("filed").isNotNull())
    return keep_last(of.select("symbol", F.col("filed").alias(f"{prefix}_date"), F.col("accession").alias(f"{prefix}_accession")), ["symbol", f"{prefix}_date"], [f"{prefix}_accession"])


def filing_sets(keys: DataFrame, filings: DataFrame, newest: int = 10) -> DataFrame:
    """Per key (symbol, t): the last 10-K before t, the last 10-Q before t if it is newer than the 10-K,
    and the newest 8-Ks between the 10-Q (else the 10-K) and t, newest first; none without a 10-K.

    Forms match exactly, so amendments are none.  Filings of one day are ordered by accession number.
    Without a 10-K, a 10-Q stands for itself."""
    met = asof_backward(keys, _latest(filings, "10-K", "k"), "symbol", "t", "k_date", strict=True)
    met = asof_backward(met, _latest(filings, "10-Q", "q"), "symbol", "t", "q_date", strict=True)
    newer = F.col("k_date").isNull() | (F.col("q_date") > F.col("k_date"))
    met = met.withColumn("q_accession", F.when(newer, F.col("q_accession"))).withColumn("q_date", F.when(newer, F.col("q_date")))
    of = filings.where("form = '8-K' and filed is not null")
    lists = rolling_last(of, "symbol", "filed", "accession", F.struct("filed", "accession"), newest, "recent").withColumnRenamed("filed", "e_date")
    met = asof_backward(met, lists, "symbol", "t", "e_date", strict=True)
    since = F.coalesce("q_date", "k_date")
    recent = F.filter(F.coalesce("recent", F.array().cast("array<struct<filed:date,accession:string>>")), lambda x: x["filed"] > since)
    eight = F.when(F.col("k_date").isNull(), F.array().cast("array<string>")).otherwise(F.reverse(F.transform(recent, lambda x: x["accession"])))
    return met.select("symbol", "t", "k_date", "k_accession", "q_date", "q_accession", eight.alias("eight_k"))


def zip_index(forms: Column, dates: Column, accessions: Column, documents: Column) -> Column:
    """A filing index of parallel arrays as an array of rows; short arrays are filled with nulls."""
    return F.arrays_zip(forms.alias("form"), dates.alias("filed"), accessions.alias("accession"), documents.alias("document"))


def modal_value(df: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """(``by``, ``value``): the most frequent non-null value of each group; of ties, the first seen by ``order``."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(by).agg(F.max_by(value, F.struct("n", (-F.col("first")).alias("f"))).alias(value))
