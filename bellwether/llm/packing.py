"""Filling containers of fixed capacity with texts: minimum bin slack over windows of items.

Items are spread over windows of about ``BINS`` containers' worth of tokens, and ``ROWS`` items at most, by a
hash of their id.
Within a window containers are filled one by one: the longest item left opens it, and a subset-sum
dynamic program over bitsets of the lengths left picks the multiset that comes closest to what is
left of the capacity; the counts are found by tracing the bitsets back.  Only lengths and ids are
shuffled, and a window's size doesn't grow with the table."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bellwether.llm.encode import VOCABULARY, encode
from bellwether.session import materialize

#: Containers' worth of tokens in a window, on average, and items in it.
BINS, ROWS = 4096, 1 << 17


def best_fill(room: int, left: dict[int, int]) -> dict[int, int]:
    """The multiset of lengths (length → count, within ``left``) whose sum is closest to ``room`` from below.

    Bit s of a bitset is set if some multiset of the lengths so far has the sum s.  Counts are split
    into powers of two, so a length costs log(count) shifts; it stops as soon as ``room`` is met."""
    mask, full = (1 << (room + 1)) - 1, 1 << room
    reach, steps = 1, []
    for length in sorted((x for x in left if x <= room), reverse=True):
        count, unit = min(left[length], room // length), 1
        while count > 0 and not reach & full:
            take = min(unit, count)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            count -= take
            unit *= 2
        if reach & full:
            break
    at, chosen = reach.bit_length() - 1, defaultdict(int)
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            chosen[length] += take
    return dict(chosen)


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Containers, as lists of indices into ``lengths`` (each 1 … capacity)."""
    stock = defaultdict(list)
    for i, n in enumerate(lengths):
        stock[n].append(i)
    left = {n: len(v) for n, v in stock.items()}
    order = sorted(left)
    bins = []
    while order:
        first = order[-1]
        chosen = defaultdict(int, {first: 1})
        left[first] -= 1
        for n, k in best_fill(capacity - first, {n: k for n, k in left.items() if k}).items():
            chosen[n] += k
            left[n] -= k
        bins.append([stock[n].pop() for n, k in chosen.items() for _ in range(k)])
        order = [n for n in order if left[n]]
        left = {n: left[n] for n in order}
    return bins


def _pack_window(rows: pd.DataFrame) -> pd.DataFrame:
    budget, capacity, window = (int(rows[c].iloc[0]) for c in ("budget_id", "capacity", "window"))
    rows = rows.sort_values(["n_tokens", "doc_id", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    bins = pack(rows["n_tokens"].tolist(), capacity)
    place = {i: b for b, items in enumerate(bins) for i in items}
    rows["container_id"] = [f"{budget}-{window}-{place[i]}" for i in range(len(rows))]
    return rows[["budget_id", "capacity", "container_id", "doc_id", "part", "start", "n_tokens"]]


PACKED = "budget_id bigint, capacity bigint, container_id string, doc_id bigint, part bigint, start bigint, n_tokens bigint"


def pack_items(sizes: DataFrame, capacities: list[tuple[int, int]]) -> DataFrame:
    """Contents of all containers of each (budget_id, capacity): one row per item or part of one.

    ``sizes`` has doc_id and n_tokens.  An item over the capacity alone is split: every full part is a
    container of its own, the rest is packed like any item; ``start`` is the part's first token.  Items
    without tokens (null n_tokens counts as none) take no room and go to the first container of their
    window without being grouped.  Repeated rows are packed each; an empty table or no capacity gives no
    rows.  Ids of containers follow from the items alone, not from how they are spread over tasks."""
    if not capacities:
        return sizes.sparkSession.createDataFrame([], PACKED)
    sizes = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("size"))
    # Repeated rows are told apart by a number of their own.
    sizes = materialize(sizes.groupBy("doc_id", "size").agg(F.count("*").alias("n")).select("doc_id", "size", F.explode(F.expr("sequence(1L, n)")).alias("copy")))
    total, filled = sizes.where("size > 0").agg(F.sum("size"), F.count("*")).first()
    windows = lambda c: max(1, -(-(total or 0) // (c * BINS)), -(-filled // ROWS))
    budgets = F.array(*(F.struct(F.lit(b).cast("bigint").alias("budget_id"), F.lit(c).cast("bigint").alias("capacity"), F.lit(windows(c)).cast("bigint").alias("windows")) for b, c in capacities))
    items = sizes.select("doc_id", "copy", "size", F.explode(budgets).alias("b")).select("doc_id", "copy", "size", "b.*")
    items = items.withColumn("window", F.expr("pmod(xxhash64(doc_id, size, copy), windows)"))
    none = items.where("size = 0").select("budget_id", "capacity", F.concat_ws("-", "budget_id", "window", F.lit(0)).alias("container_id"), "doc_id", F.lit(0).cast("bigint").alias("part"), F.lit(0).cast("bigint").alias("start"), F.col("size").alias("n_tokens"))
    parts = items.where("size > 0").withColumn("part", F.explode(F.expr("sequence(0L, (size - 1) div capacity)"))).withColumn("start", F.expr("part * capacity")).withColumn("n_tokens", F.expr("least(capacity, size - start)"))
    whole = parts.where("n_tokens = capacity").select("budget_id", "capacity", F.concat_ws("-", "budget_id", F.lit("full"), "doc_id", "size", "copy", "part").alias("container_id"), "doc_id", "part", "start", "n_tokens")
    packed = parts.where("n_tokens < capacity").groupBy("budget_id", "capacity", "window").applyInPandas(_pack_window, PACKED)
    return packed.unionByName(whole).unionByName(none)


def pack_documents(docs: DataFrame, budgets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``pack_items`` of documents (doc_id, text) sized in tokens, for each row of the budgets table.

    The budgets are a table of purposes, a few rows; more than a thousand are refused."""
    rows = budgets.where("capacity > 0").select("budget_id", "capacity").distinct().limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 capacities")
    sizes = encode(docs, "doc_id", "text", vocabulary, only_count=True)
    return pack_items(sizes, sorted((int(r.budget_id), int(r.capacity)) for r in rows))
