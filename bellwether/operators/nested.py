"""Deeply nested JSON documents as flat child tables, by Arrow list offsets and parent indices.

Spark's own JSON reader decodes a payload into one canonical nested type, node by node: what may come in
several shapes is read as the node's text first and opened by what it is.  The canonical columns reach the
workers as Arrow buffers, where no row is touched: child arrays are emitted from the offsets of the lists.
The parent index of a child is ``list_parent_indices``, its place is its index less the offset its parent
starts at, and keys reach the children by a vectorised ``take``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAR_FIELDS = ("open", "high", "low", "close", "volume")
ARTICLE_FIELDS = ("title", "url", "publish_date", "text", "scoring_method")
KINDS = ("bar", "tenk_paragraph", "eight_k", "eight_k_paragraph", "article")
#: Every quoting at least doubles what it quotes, so no text under 2 GB is quoted deeper.
QUOTED = 32

#: Columns of the union of all child tables; those a kind doesn't have are null.
COLUMNS = [("raw_id", pa.int64()), ("child_kind", pa.string()), ("parent_pos", pa.int64()), ("child_pos", pa.int64())]
COLUMNS += [("text", pa.string()), ("score", pa.int64()), ("filing_date", pa.string()), ("accession_number", pa.string())]
COLUMNS += [(f, pa.float64()) for f in BAR_FIELDS] + [(f, pa.string()) for f in ("title", "url", "publish_date", "scoring_method")]
_SPARK = {pa.int64(): "bigint", pa.string(): "string", pa.float64(): "double"}
SCHEMA = ", ".join(f"`{n}` {_SPARK[t]}" for n, t in COLUMNS)
_TEXTS = "array<string>"


def _begins(x: Column, sign: str) -> Column:
    return F.coalesce(F.substring(F.ltrim(x), 1, 1) == sign, F.lit(False))


def _opened(x: Column) -> Column:
    """The text of a node, or what it holds if it is JSON text in a string, at any depth of quoting."""
    inner = lambda s: F.coalesce(F.get(F.from_json(F.concat(F.lit("["), s, F.lit("]")), _TEXTS), 0), s)
    deeper = F.aggregate(F.array_repeat(F.lit(0), QUOTED), x, lambda s, _: F.when(_begins(s, '"'), inner(s)).otherwise(s))
    return F.when(_begins(x, '"'), deeper).otherwise(x)


def _fields(x: Column, *names: str) -> Column:
    """The texts of an object's nodes; null if it is no object."""
    return F.when(_begins(x, "{"), F.from_json(x, ", ".join(f"`{n}` string" for n in names)))


def _items(x: Column) -> Column:
    """The elements of a list; a node outside a list is its only one, and no node is none."""
    alone = F.when(x.isNull(), F.array().cast(_TEXTS)).otherwise(F.array(x))
    return F.coalesce(F.when(_begins(x, "["), F.from_json(x, _TEXTS)), alone)


def _with(x: Column, of: Callable[[Column], Column]) -> Column:
    """``of(x)``, ``x`` being computed once."""
    return F.get(F.transform(F.array(x), of), 0)


def _whole(x: Column) -> Column:
    return F.when(x.rlike(r"^-?\d+$"), x.try_cast("bigint"))


def _paragraph(p: Column) -> Column:
    def of(q: Column) -> Column:
        plain = F.struct(p.alias("text"), F.lit(None).cast("bigint").alias("score"))
        made = _with(_fields(q, "text", "score"), lambda o: F.when(o.isNotNull(), F.struct(o["text"].alias("text"), _whole(o["score"]).alias("score"))))
        return F.when(p.isNotNull(), F.coalesce(made, plain))

    return _with(_opened(p), of)


def _paragraphs(o: Column) -> Column:
    """Of a report's fields: its paragraphs, or its one text."""
    listed = _with(_opened(o["paragraphs"]), lambda x: F.transform(_items(x), _paragraph))
    return F.when(o["paragraphs"].isNull() & o["report"].isNotNull(), F.array(_paragraph(o["report"]))).otherwise(listed)


def _reports(x: Column) -> Column:
    def of(r: Column) -> Column:
        meta = lambda o: _with(_fields(_opened(o["metadata"]), "filing_date", "accession_number"), lambda m: m)
        full = lambda o: F.struct(meta(o)["filing_date"].alias("filing_date"), meta(o)["accession_number"].alias("accession_number"), F.when(o.isNotNull(), _paragraphs(o)).alias("paragraphs"))
        return F.when(r.isNotNull(), _with(_fields(r, "metadata", "paragraphs", "report"), full))

    return _with(_opened(x), lambda y: F.transform(F.transform(_items(y), _opened), of))


def _articles(x: Column) -> Column:
    def of(a: Column) -> Column:
        texts = lambda o: [(F.when(o.isNull(), a).otherwise(o[f]) if f == "text" else o[f]).alias(f) for f in ARTICLE_FIELDS]
        return F.when(a.isNotNull(), _with(_fields(a, *ARTICLE_FIELDS, "score"), lambda o: F.struct(*texts(o), _whole(o["score"]).alias("score"))))

    return _with(_opened(x), lambda y: F.transform(F.transform(_items(y), _opened), of))


def _bars(x: Column) -> Column:
    def of(series: Column) -> Column:
        longest = F.coalesce(F.array_max(F.transform(F.map_values(series), F.size)), F.lit(0))
        value = lambda f, i: F.get(series[f], i).try_cast("double").alias(f)
        return F.transform(F.when(longest > 0, F.sequence(F.lit(0), longest - 1)), lambda i: F.struct(*(value(f, i) for f in BAR_FIELDS)))

    lists = lambda m: F.transform_values(m, lambda _, v: _with(_opened(v), _items))
    return _with(_with(F.when(_begins(x, "{"), F.from_json(x, "map<string,string>")), lists), of)


def canonical(raw: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(raw_id, the nested columns that ``kinds`` come from) of the readable payloads.

    A payload is readable if it is one JSON object, or JSON text of one in a string."""
    one = F.from_json(F.concat(F.lit("["), F.col("payload"), F.lit("]")), _TEXTS)
    text = _with(one, lambda x: F.when(F.size(x) == 1, _opened(F.get(x, 0))))
    nodes = ", ".join(f"`{n}` string" for n in ("stock_data", "past_stock_data", "latest_10k", "eight_k_reports", "hacker_news_articles"))
    parsed = lambda t: F.when(_begins(t, "{"), F.from_json(t, f"{nodes}, `__bad` string", {"columnNameOfCorruptRecord": "__bad"}))
    wanted = {_SOURCE[k] for k in kinds}

    def made(d: Column) -> Column:
        each = {"bars": lambda: _bars(_opened(F.coalesce(d["stock_data"], d["past_stock_data"]))), "tenk": lambda: _reports(d["latest_10k"]), "eight_k": lambda: _reports(d["eight_k_reports"]), "articles": lambda: _articles(d["hacker_news_articles"])}
        return F.when(d["__bad"].isNull(), F.struct(*(of().alias(c) for c, of in each.items() if c in wanted)))

    # One expression, so that no filter is pushed below it and decodes the payload again.
    return raw.select("raw_id", _with(_with(text, parsed), made).alias("c")).select("raw_id", "c.*")


_SOURCE = {"bar": "bars", "tenk_paragraph": "tenk", "eight_k": "eight_k", "eight_k_paragraph": "eight_k", "article": "articles"}


def children(lists: pa.ListArray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(index of the parent, place in it, value) of each non-null child, from the list's offsets."""
    parent = pc.list_parent_indices(lists)
    values = lists.flatten()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    place = pa.array(np.arange(len(values)) - starts[parent.to_numpy()], pa.int64())
    keep = values.is_valid()
    return parent.filter(keep), place.filter(keep), values.filter(keep)


def _emit(kind: str, ids: pa.Array, parent_pos: pa.Array | None, place: pa.Array, values: pa.StructArray) -> pa.RecordBatch:
    n = len(values)
    have = {f.name: values.field(f.name) for f in values.type if f.name != "paragraphs"}
    have |= {"raw_id": ids, "child_kind": pa.array([kind]).take(pa.array(np.zeros(n, int))), "child_pos": place, "parent_pos": pa.array(np.zeros(n, int)) if parent_pos is None else parent_pos}
    return pa.RecordBatch.from_arrays([have[c] if c in have else pa.nulls(n, t) for c, t in COLUMNS], names=[c for c, _ in COLUMNS])


def flatten_batch(batch: pa.RecordBatch, kinds: tuple[str, ...] = KINDS) -> Iterator[pa.RecordBatch]:
    """The child tables of one batch of canonical columns."""
    ids = batch.column("raw_id")
    for kind in ("bar", "article"):
        if kind in kinds:
            parent, place, values = children(batch.column(_SOURCE[kind]))
            yield _emit(kind, ids.take(parent), None, place, values)
    for own, below in ((None, "tenk_paragraph"), ("eight_k", "eight_k_paragraph")):
        if own in kinds or below in kinds:
            parent, place, reports = children(batch.column(_SOURCE[below]))
            if own in kinds:
                yield _emit(own, ids.take(parent), None, place, reports)
            if below in kinds:
                above, place2, paragraphs = children(reports.field("paragraphs"))
                yield _emit(below, ids.take(parent).take(above), place.take(above), place2, paragraphs)


def flatten_documents(raw: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The child rows of all payloads: raw_id, child_kind, parent_pos, child_pos and the child's fields.

    ``raw`` needs raw_id and payload; other columns are ignored, and only the nodes that ``kinds`` come
    from are decoded.  Unreadable, null and non-object payloads give no rows; null children give no row but
    keep their place; absent nodes give none; of several annual reports each has its place; a null
    ``stock_data`` gives way to ``past_stock_data``; what is no number is a null reading; repeated payloads
    are flattened each under its own id.  Narrow: no shuffle at any size."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield from flatten_batch(batch, kinds)

    return canonical(raw, kinds).mapInArrow(batches, SCHEMA)
