"""Scans of files: documents, answers, tables, registries, filing indexes, HTML tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bellwether import schemas
from bellwether.functions.html import _CELL, _ROW, _TABLE, _TAG
from bellwether.functions.tickers import pad_cik
from bellwether.session import replace_file


def json_documents(spark: SparkSession, path: str, schema: str = schemas.COMPANY_DOCUMENT) -> DataFrame:
    """One row per JSON file, with ``file_name`` and, where it can't be read, ``_corrupt_record``."""
    df = spark.read.schema(f"{schema}, _corrupt_record string").json(path, multiLine=True)
    return df.withColumn("file_name", F.element_at(F.split(F.input_file_name(), "/"), -1))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def text_files(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """One row per file: ``file_name`` and its whole ``text``."""
    df = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    return df.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"), F.col("value").alias("text"))


def csv_table(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """A CSV file of any size with a header, split over tasks.

    Where quoted fields may span lines, ``multi_line`` reads each file in one task instead."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=multi_line, escape='"')


def symbols_of(df: DataFrame, symbols: list[str], column: str = "Stock_symbol") -> DataFrame:
    """The rows of the given symbols; the filter reaches the scan."""
    return df.where(F.col(column).isin(symbols))


def registry(texts: DataFrame, column: str = "text") -> DataFrame:
    """(cik_str, ticker, title) from JSON text that maps keys to entries."""
    entries = F.map_values(F.from_json(column, schemas.REGISTRY))
    return texts.select(F.inline(entries))


def refresh_registry(spark: SparkSession, path: str, fetch) -> DataFrame | None:
    """Put the registry text that ``fetch()`` gives in the place of ``path``, what was there being kept as
    ``path``.backup; its entries, or None (and no change) if it has none or can't be fetched."""
    try:
        text = fetch()
    except Exception:
        return None
    fresh = registry(spark.createDataFrame([(text,)], "text string"))
    if not text or fresh.isEmpty():
        return None
    replace_file(spark, path, text.encode(), backup=f"{path}.backup")
    return fresh


def _listed(arrays, *keys: str) -> list:
    names = {"form": "form", "filed": "filingDate", "accession": "accessionNumber", "document": "primaryDocument"}
    return [*keys, F.explode(F.arrays_zip(*(arrays[v].alias(k) for k, v in names.items()))).alias("x")]


def _rows(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "x.form", F.col("x.filed").try_cast("date").alias("filed"), "x.accession", "x.document")


def filing_index(texts: DataFrame, column: str = "text", *keys: str) -> DataFrame:
    """Filings from the parallel arrays of a submissions index: (``keys``, form, filed, accession, document)."""
    recent = F.from_json(column, schemas.FILING_INDEX)["filings"]["recent"]
    return _rows(texts.select(*_listed(recent, *keys)), *keys)


def archives(texts: DataFrame, column: str = "text", *keys: str) -> DataFrame:
    """The older indexes a submissions index names: (``keys``, name, first, last)."""
    files = F.from_json(column, "filings struct<files: array<struct<name: string, filingFrom: string, filingTo: string>>>")["filings"]["files"]
    rows = texts.select(*keys, F.explode(files).alias("x"))
    return rows.select(*keys, "x.name", F.col("x.filingFrom").try_cast("date").alias("first"), F.col("x.filingTo").try_cast("date").alias("last"))


def archived_index(texts: DataFrame, column: str = "text", *keys: str) -> DataFrame:
    """Filings of an older index, whose arrays stand at the top: (``keys``, form, filed, accession, document)."""
    arrays = F.from_json(column, "form array<string>, filingDate array<string>, accessionNumber array<string>, primaryDocument array<string>")
    return _rows(texts.select(*_listed(arrays, *keys)), *keys)


def latest_filing(indexes: DataFrame, older: DataFrame, asked: DataFrame) -> DataFrame:
    """For each of ``asked`` (cik, form, before) the newest filing of that form filed before that date:
    (cik, form, before, filed, accession, document).

    ``indexes`` has (cik, text) of the submissions indexes, ``older`` (name, text) of archived ones.  An archive is
    only read where the index itself has no such filing and the archive ends before the date; a null date
    takes any filing.  Forms are compared without case; of filings on one date the greatest accession counts."""
    want = asked.select("cik", F.upper("form").alias("form"), "before").distinct()

    def newest(filed: DataFrame) -> DataFrame:
        x = want.join(filed.withColumn("form", F.upper("form")), ["cik", "form"]).where("filed is not null and (before is null or filed < before)")
        return x.groupBy("cik", "form", "before").agg(F.max(F.struct("filed", "accession", "document")).alias("x")).select("cik", "form", "before", "x.*")

    recent = newest(filing_index(indexes, "text", "cik"))
    missing = want.join(recent.select("cik", "form", F.struct("before").alias("b")), (want["cik"] == recent["cik"]) & (want["form"] == recent["form"]) & want["before"].eqNullSafe(F.col("b.before")), "left_anti")
    files = missing.join(archives(indexes, "text", "cik"), "cik").where("before is null or last < before").select("cik", "name", "form", "before")
    old = files.join(archived_index(older, "text", "name").withColumn("form", F.upper("form")), ["name", "form"]).where("filed is not null and (before is null or filed < before)")
    old = old.groupBy("cik", "form", "before").agg(F.max(F.struct("filed", "accession", "document")).alias("x")).select("cik", "form", "before", "x.*")
    return recent.unionByName(old)


def cik_candidates(texts: DataFrame, column: str = "text") -> DataFrame:
    """(cik, n) of the CIKs named in search feeds, padded to ten digits."""
    found = F.concat(F.regexp_extract_all(column, F.lit(r"CIK=(\d+)"), 1), F.regexp_extract_all(column, F.lit(r"(?i)<cik>\s*(\d+)"), 1))
    return texts.select(F.explode(found).alias("cik")).select(pad_cik(F.col("cik")).alias("cik")).groupBy("cik").agg(F.count("*").alias("n"))


def cik_before(texts: DataFrame, target: str, key: str, column: str = "text") -> DataFrame:
    """(``key``, cik) of search feeds: the CIK of the first entry filed before ``target``, else the one
    named most (of ties the first), padded to ten digits."""
    entries = F.regexp_extract_all(column, F.lit(r"(?s)<entry>(.*?)</entry>"), 1)
    dated = F.filter(entries, lambda e: (F.regexp_extract(e, r"CIK=(\d+)", 1) != "") & (F.regexp_extract(e, r"<filing-date>\s*([\d-]+)", 1).try_cast("date") < F.lit(target).cast("date")))
    named = F.regexp_extract_all(column, F.lit(r"CIK=(\d+)"), 1)
    plain = F.nullif(F.regexp_extract(column, r"(?i)<cik>\s*(\d+)", 1), F.lit(""))
    modal = F.reduce(F.array_distinct("named"), F.struct(F.lit(None).cast("string").alias("c"), F.lit(0).alias("n")), lambda s, c: F.when(F.size(F.filter("named", lambda x: x == c)) > s["n"], F.struct(c.alias("c"), F.size(F.filter("named", lambda x: x == c)).alias("n"))).otherwise(s), lambda s: s["c"])
    rows = texts.select(key, named.alias("named"), F.regexp_extract(F.get(dated, 0), r"CIK=(\d+)", 1).alias("first"), plain.alias("plain"))
    cik = F.coalesce(F.when(F.size(F.array_distinct("named")) > 1, F.col("first")), modal, F.col("plain"))
    return rows.select(key, pad_cik(cik).alias("cik"))


def html_tables(page: str) -> list[list[list[str]]]:
    """The tables of one page as rows of cell texts; for the few pages that hold reference tables."""
    strip = lambda x: " ".join(_TAG.sub(" ", x).split())
    return [[[strip(c) for c in _CELL.findall(row)] for row in _ROW.findall(t.group(1))] for t in _TABLE.finditer(page)]


def membership(spark: SparkSession, page: str) -> tuple[DataFrame, DataFrame]:
    """(current members; change log) of a page whose first two tables list them.

    A log row may name a ticker that came and one that left; dates that can't be read are dropped."""
    tables = html_tables(page)
    if len(tables) < 2:
        raise ValueError("the page needs two tables")
    symbols = [(row[0],) for row in tables[0][1:] if row]
    log = [(*(row + [""] * 6)[:6], i) for i, row in enumerate(tables[1]) if row and re.search(r"\d{4}", row[0])]
    current = spark.createDataFrame(symbols, "ticker string")
    raw = spark.createDataFrame(log, "date string, added string, added_name string, removed string, removed_name string, reason string, row int")
    day = F.coalesce(F.expr("try_to_date(date, 'MMMM d, yyyy')"), F.expr("try_to_date(date, 'yyyy-MM-dd')"))
    both = F.array(F.struct(F.lit("Removed").alias("kind"), F.col("removed").alias("ticker"), (F.col("row") * 2).alias("change_id")), F.struct(F.lit("Added").alias("kind"), F.col("added").alias("ticker"), (F.col("row") * 2 + 1).alias("change_id")))
    changes = raw.select(day.alias("d"), F.explode(both).alias("c")).select("d", "c.*").where("d is not null and ticker <> ''")
    return current, changes
