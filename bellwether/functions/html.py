"""Filing bodies from HTML: entities, tags, tables.

The steps run in an order that is part of the result: entities are resolved first, so an escaped tag is
a tag.  They need an entity decoder and a cell merger, which Spark has no functions for; so the chain is
one Arrow function, called once for a batch of documents."""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ANY = re.DOTALL | re.IGNORECASE
#: What is dropped or replaced before tables are read, in this order.
_REPLACED: tuple[tuple[str, str, int], ...] = (
    (r"<(script|style).*?</\1>", "", _ANY),
    (r"<\?xml.*?\?>", "", re.DOTALL),
    (r"<!DOCTYPE.*?>", "", _ANY),
    (r"<(ix:header|ix:hidden|ix:resources).*?</\1>", "", _ANY),
    (r"<xbrli:context.*?</xbrli:context>", "", _ANY),
    (r"</?h[1-6]\b[^>]*>", "\n\n", re.IGNORECASE),
    (r"</?(?:p|div|section|article)\b[^>]*>", "\n", re.IGNORECASE),
    (r"<li\b[^>]*>", "\n• ", re.IGNORECASE),
    (r"</li>", "", re.IGNORECASE),
    (r"<dt\b[^>]*>", "\n", re.IGNORECASE),
    (r"</dt>", ":", re.IGNORECASE),
    (r"<dd\b[^>]*>", " ", re.IGNORECASE),
    (r"</dd>", "\n", re.IGNORECASE),
)
_TIDY: tuple[tuple[str, str, int], ...] = (
    (r"(?:\s*\|\s*){3,}", " | ", 0),
    (r"\s*\|\s*\|\s*", " | ", 0),
    (r"^\s*\|\s*", "", re.MULTILINE),
    (r"\s*\|\s*$", "", re.MULTILINE),
    (r" +", " ", 0),
    (r"\n\s*\n\s*\n+", "\n\n", 0),
    (r" +\n", "\n", 0),
    (r"^\s*$", "", re.MULTILINE),
)
_TABLE = re.compile(r"<table\b[^>]*>(.*?)</table>", _ANY)
_ROW = re.compile(r"<tr\b[^>]*>(.*?)</tr>", _ANY)
_CELL = re.compile(r"<t[dh]\b[^>]*>(.*?)</t[dh]>", _ANY)
_BREAK = re.compile(r"<(?:br|hr)\b[^>]*>|</?(?:blockquote|pre|address)\b[^>]*>", re.IGNORECASE)
_TAG = re.compile(r"<[^>]+>")
_NUMBER = r"[\d,.-]+"

Rule = Callable[[str, str], str | None]


def _full(pattern: str, text: str) -> bool:
    return re.fullmatch(pattern, text) is not None


def _ends(pattern: str, text: str) -> bool:
    return re.search(pattern + r"$", text) is not None


#: Passes over neighbouring cells; a rule gives what the two become, or None.
_PASSES: tuple[tuple[Rule, ...], ...] = (
    (
        lambda a, b: f"$ {b}" if a == "$" and _full(r"[\d,().-]+", b) else None,
        lambda a, b: a + b if a.endswith("(") and _full(_NUMBER, b) else None,
        lambda a, b: a + b if b == ")" and _full(_NUMBER, a) else None,
    ),
    (lambda a, b: f"{a})" if b == ")" and _ends(_NUMBER, a) else None,),
    (
        lambda a, b: f"{a}%" if b == "%" and _ends(_NUMBER + r"\)?", a) else None,
        lambda a, b: ")%" if a == ")" and b == "%" else None,
    ),
    (lambda a, b: f"({a})%" if b == ")%" and _ends(_NUMBER, a) else None,),
)


def merge_cells(cells: list[str]) -> list[str]:
    """Signs, brackets and percent marks joined to the numbers of neighbouring cells."""
    for rules in _PASSES:
        i = 0
        while i + 1 < len(cells):
            joined = next((j for rule in rules if (j := rule(cells[i], cells[i + 1])) is not None), None)
            if joined is None:
                i += 1
            else:
                cells = [*cells[:i], joined, *cells[i + 2 :]]
    return [c.replace("((", "(") for c in cells]


def _text(inner: str) -> str:
    return _TAG.sub("", _BREAK.sub("\n", inner))


def _rows(table: re.Match) -> str:
    lines = []
    for row in _ROW.findall(table.group(1)):
        cells = merge_cells([" ".join(_text(c).split()) for c in _CELL.findall(row)])
        while cells and not cells[-1]:
            cells.pop()
        if cells:
            lines.append(" | ".join(cells))
    return "\n\n" + "\n".join(lines) + "\n\n"


def clean(source: str | None) -> str | None:
    """The text of an HTML or XBRL body; null stays null."""
    if source is None:
        return None
    text = html.unescape(source)
    for pattern, by, flags in _REPLACED:
        text = re.sub(pattern, by, text, flags=flags)
    text = _text(_TABLE.sub(_rows, text))
    for pattern, by, flags in _TIDY:
        text = re.sub(pattern, by, text, flags=flags)
    return text.strip()


def _clean_batch(bodies: pd.Series) -> pd.Series:
    return bodies.map(clean, na_action="ignore")


def clean_html(body: Column) -> Column:
    return F.pandas_udf(_clean_batch, "string")(body)
