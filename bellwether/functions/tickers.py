"""Symbols and company names: normalisation, aliases, suffixes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Company suffixes, each removed once, in this order.
SIMPLIFY = (
    r"\s+Corporation$",
    r"\s+Inc\.?$",
    r"\s+Incorporated$",
    r"\s+Limited$",
    r"\s+Ltd\.?$",
    r"\s+L\.?L\.?C\.?$",
    r"\s+plc$",
    r"\s+Co\.?$",
    r"\s+Company$",
    r"\s+Group$",
    r",?\s+National Association$",
    r"\s+Technologies$",
    r"\s+Holdings?$",
    r"\s+Services?$",
    r"\s+Systems?$",
)
#: Literal endings, tried one after the other.
ENDINGS = (", Inc.", " Inc.", ", Corp.", " Corp.", ", Ltd.", " Ltd.", ", LLC", " LLC", ", LP", " LP", ", PLC", " PLC")
#: Company names and their symbols.
ALIASES = {
    "atlassian": "TEAM",
    "apple": "AAPL",
    "microsoft": "MSFT",
    "tesla": "TSLA",
    "google": "GOOGL",
    "alphabet": "GOOGL",
    "amazon": "AMZN",
    "meta": "META",
    "facebook": "META",
    "netflix": "NFLX",
    "nvidia": "NVDA",
}


def market_symbol(ticker: Column) -> Column:
    """The price source's spelling: upper case, underscore, blank and point as hyphens."""
    return F.translate(F.upper(ticker), "_ .", "---")


def registry_symbol(ticker: Column) -> Column:
    """The filing registry's spelling: upper case, point and slash as hyphens."""
    return F.translate(F.upper(ticker), "./", "--")


def file_symbol(ticker: Column) -> Column:
    """The spelling in file names: point and slash as underscores."""
    return F.translate(ticker, "./", "__")


def simplify_name(name: Column) -> Column:
    """A company name without its legal and generic suffixes."""
    for pattern in SIMPLIFY:
        name = F.regexp_replace(name, f"(?i){pattern}", "")
    return F.trim(name)


def strip_endings(name: Column) -> Column:
    """A company name without the literal endings; a name may lose several."""
    for ending in ENDINGS:
        name = F.regexp_replace(name, re.escape(ending) + "$", "")
    return F.trim(name)


def resolve_symbol(company: Column) -> Column:
    """A symbol of at most five capitals stays; a known name gives its symbol; other short names are
    taken for symbols, long ones stay as they are."""
    known = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    short = F.length(company) <= 5
    capital = (F.upper(company) == company) & (F.lower(company) != company)
    return F.when(capital & short, company).otherwise(F.coalesce(F.try_element_at(known, F.lower(company)), F.when(short, F.upper(company)).otherwise(company)))


def pad_cik(cik: Column) -> Column:
    """Ten digits, zeros in front; longer ones stay whole."""
    return F.when(F.length(cik) < 10, F.lpad(cik, 10, "0")).otherwise(cik)


def filing_url(cik: Column, accession: Column, document: Column, host: str = "https://filings.example/data") -> Column:
    """The document's address: unpadded CIK, accession number without hyphens."""
    return F.concat(F.lit(host), F.lit("/"), cik.try_cast("bigint").cast("string"), F.lit("/"), F.regexp_replace(accession, "-", ""), F.lit("/"), document)


def parse_file_name(name: Column) -> Column:
    """(ticker, date string) of names like AEP_20240828_data.json; nulls without eight digits."""
    date = F.regexp_extract(name, r"(\d{8})", 1)
    ticker = F.regexp_replace(F.regexp_extract(name, r"^(.*?)\d{8}", 1), "_+$", "")
    return F.when(date != "", F.struct(ticker.alias("ticker"), date.alias("date")))


def run_group(stem: Column) -> Column:
    """The group of a run: what comes before ``_data_run_``, or all of it."""
    return F.substring_index(stem, "_data_run_", 1)
