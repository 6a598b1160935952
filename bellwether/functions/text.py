"""Text functions: paragraphs, words, scores; built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it.
BLANK = r"(?U)\s+"


def words(text: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit(""))))


def first_words(text: Column, n: int = 4000) -> Column:
    """At most ``n`` words; white space is only reduced where something is cut off."""
    w = words(text)
    return F.when(F.size(w) > n, F.array_join(F.slice(w, 1, n), " ")).otherwise(text)


def paragraphs(text: Column, min_words: int = 20) -> Column:
    """Paragraphs between blank lines; short ones are joined to the next until they have ``min_words``
    words, and what is left at the end is a paragraph of its own.  Null gives null, a blank text none."""
    raw = F.filter(F.transform(F.split(text, r"\n\n+"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, p: Column) -> Column:
        grown = F.when(state["open"] == "", p).otherwise(F.concat(state["open"], F.lit("\n\n"), p))
        full = count_words(grown) >= min_words
        return F.struct(F.when(full, F.concat(state["done"], F.array(grown))).otherwise(state["done"]).alias("done"), F.when(full, F.lit("")).otherwise(grown).alias("open"))

    return F.aggregate(raw, zero, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def parse_score(answer: Column) -> Column:
    """The first digit 0 … 3 of an answer, −1 if it has none or is null."""
    return F.coalesce(F.regexp_extract(answer, "([0-3])", 1).try_cast("int"), F.lit(-1))


def parse_movement(answer: Column) -> Column:
    """1 if RISE is among the last six words, else 0 (FALL, or nothing known)."""
    last = F.slice(F.reverse(words(F.upper(answer))), 1, 6)
    return F.coalesce(F.array_contains(last, "RISE").cast("int"), F.lit(0))


def humanize_billions(x: Column) -> Column:
    """1234567890 as 1.23B; null as N/A."""
    return F.coalesce(F.concat(F.regexp_replace(F.format_number(x / 1e9, 2), ",", ""), F.lit("B")), F.lit("N/A"))


def host(url: Column) -> Column:
    """The host of an address; null if it has none."""
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1), F.lit(""))
