"""Near-duplicate records by an exact set-similarity join: universe partition with deletion neighbourhoods.

Every record is a set of elements.  For a threshold t, sets of sizes a and b can only be similar if
their symmetric difference is at most D = (1 - t) / (1 + t) * (a + b).  Per band of sizes the universe
of elements is cut into segments by a hash.  If to the segments i of a set a differences v_i of 0, 1
or 2 are allotted that sum to more than D, then every similar set differs from it by less than v_i in
some segment i: it has the same segment (v_i = 1), or one that differs by at most one element
(v_i = 2, found through the segments with one element deleted).  The allotment is the cheapest by the
elements' frequencies, so frequent segments are hardly ever looked up.  An element that no other set
has counts as a difference at once, at no cost.  Candidates pass a bit-parity bound on their symmetric
difference, and the rest is verified on the elements themselves."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bellwether.session import BROADCAST_ROWS, materialize

#: Records with a Jaccard similarity of at least THRESHOLD are near duplicates.
THRESHOLD = 0.6
#: Sizes of a band lie within this factor.
BAND = math.sqrt(0.6)
#: Differences allotted beyond those needed, where the segments allow.
EXTRA = 4
#: How far an element of a segment thins out the sets that share the rest of it: 1 if elements were
#: independent, 0 if each came with the others.
THINNING = 1.0
#: Words of the parity sketch, of 64 bits each.
SKETCH = 16
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _record(shingle: int, run: str, bar: str, kind: str) -> Column:
    paragraphs = "concat(coalesce(latest_10k.paragraphs, array()), coalesce(latest_10q.paragraphs, array()))"
    words = "array(regexp_extract_all(lower(p), '[a-z0-9]+', 0))"
    runs = f"transform({words}, w -> CASE WHEN size(w) < {shingle} THEN CAST(array() AS array<{kind}>) ELSE transform(sequence(0, size(w) - {shingle}), i -> {run}) END)[0]"
    bars = f"transform(filter(coalesce(arrays_zip(stock_data.close, stock_data.volume), array()), b -> b.volume IS NOT NULL), b -> {bar})"
    return F.expr(f"array_distinct(concat(flatten(transform(filter({paragraphs}, p -> p IS NOT NULL), p -> {runs})), {bars}))")


def _words(shingle: int) -> str:
    return ", ".join(f"w[i + {k}]" for k in range(shingle))


def record_elements(shingle: int = 3) -> Column:
    """The distinct elements of a company document: runs of ``shingle`` words within a paragraph of
    latest_10k or latest_10q, and pairs of close and volume at one position of stock_data."""
    return _record(shingle, f"concat_ws(' ', {_words(shingle)})", "concat('=', coalesce(string(b.close + 0.0D), ''), '|', string(b.volume + 0.0D))", "string")


def record_hashes(shingle: int = 3) -> Column:
    """Hashes of the elements of ``record_elements``, without building their texts."""
    return _record(shingle, f"xxhash64({_words(shingle)})", "xxhash64('=', b.close + 0.0D, b.volume + 0.0D)", "bigint")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True) + _MIX[0]
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def band_of(size: int) -> int:
    return int(math.floor(math.log(size) / -math.log(BAND) + 1e-9))


def band_sizes(band: int) -> tuple[int, int]:
    """The least and the greatest size of a band."""
    top = math.ceil(BAND ** -(band + 1)) + 1
    sizes = [s for s in range(max(1, math.floor(BAND**-band) - 1), top + 1) if band_of(s) == band]
    return (sizes[0], sizes[-1]) if sizes else (1, 0)


class Bands:
    """Segments and difference bounds of the bands, for one threshold."""

    def __init__(self, threshold: float):
        self.t, self._sizes = threshold, {}

    def sizes(self, band: int) -> tuple[int, int]:
        if band not in self._sizes:
            self._sizes[band] = band_sizes(band)
        return self._sizes[band]

    def difference(self, a: int, b: int) -> int:
        return math.floor((1 - self.t) / (1 + self.t) * (a + b) + 1e-9)

    def segments(self, band: int) -> int:
        """Enough that two differences for each can exceed the bound of the largest set that asks."""
        top = self.sizes(band)[1]
        return self.difference(math.floor(top / self.t + 1e-9), top) // 2 + 1

    def asked(self, size: int) -> Iterator[tuple[int, int]]:
        """(band, difference bound) of the bands with sets of at most ``size`` that may be similar."""
        least = math.ceil(self.t * size - 1e-9)
        for band in range(band_of(max(1, least)), band_of(size) + 1):
            low, top = self.sizes(band)
            if max(low, least) <= min(top, size):
                yield band, self.difference(size, min(top, size))


def _segments(h: np.ndarray, df: np.ndarray, m: int):
    """Elements in order of segment and frequency: (elements, segment of each, start of each segment that has any)."""
    seg = (h % np.uint64(m)).astype(np.int64)
    order = np.lexsort((df, seg))
    h, df, seg = h[order], df[order], seg[order]
    starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]]) if len(h) else np.zeros(0, np.int64)
    return h, df, seg, starts


def _signature(band: int, seg: np.ndarray, content: np.ndarray, deleted: bool) -> np.ndarray:
    with np.errstate(over="ignore"):
        salt = mix(np.uint64(band * 2 + deleted) * _MIX[0] + seg.astype(np.uint64))
        return mix(content ^ salt).view(np.int64)


def index_signatures(h: np.ndarray, df: np.ndarray, band: int, m: int) -> np.ndarray:
    """Of a set that is asked for: every segment, empty ones too, and every segment less one element."""
    h, df, seg, starts = _segments(h, df, m)
    x = mix(h)
    content = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        if len(h):
            content[seg[starts]] = np.add.reduceat(x, starts)
        less = content[seg] - x
    return np.concatenate([_signature(band, np.arange(m), content, False), _signature(band, seg, less, True)])


def probe_signatures(h: np.ndarray, df: np.ndarray, band: int, m: int, need: int, total: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of a set that asks: (signatures, weight of each, least weight that a similar set must meet).

    Differences are allotted to the cheapest segments: at least ``need``, and EXTRA more if the segments
    allow.  A similar set differs by less than ``need``, so the segments it is met in weigh at least as
    much as is allotted beyond that; a set met in one or two segments by chance is none.

    A segment costs the sets expected to have it: those with its rarest element, thinned out by every
    other element it holds; its second difference those with its second rarest, thinned out alike.  An
    empty segment costs all ``total`` sets."""
    h, df, seg, starts = _segments(h, df, m)
    x = mix(h)
    content = np.zeros(m, np.uint64)
    first = np.full(m, math.log(total + 1.0))
    second = np.full(m, math.log(2.0 * total + 2.0))
    with np.errstate(over="ignore"):
        if len(h):
            content[seg[starts]] = np.add.reduceat(x, starts)
            size = np.diff(np.r_[starts, len(h)])
            log = np.log(df)
            thin = THINNING * (log - math.log(total + 1.0))
            all_thin = np.add.reduceat(thin, starts)
            first[seg[starts]] = log[starts] + all_thin - thin[starts]
            two = size > 1
            at = starts[two]
            second[seg[at]] = np.maximum(log[at + 1] + all_thin[two] - thin[at] - thin[at + 1], first[seg[at]])
        less = content[seg] - x
    # The second of a segment never costs less than its first; the stable sort keeps the first before it.
    chosen = np.argsort(np.concatenate([first, second]), kind="stable")[: need + EXTRA]
    v = np.bincount(chosen % m, minlength=m)
    one, twice = np.flatnonzero(v >= 1), np.flatnonzero(v >= 2)
    inner = v[seg] >= 2
    sigs = np.concatenate([_signature(band, one, content[one], False), _signature(band, seg[inner], less[inner], False), _signature(band, twice, content[twice], True)])
    return sigs, np.concatenate([v[one], np.full(int(inner.sum()), 2), np.full(len(twice), 2)]).astype(np.int64), len(chosen) - need + 1


def sketch(h: np.ndarray) -> np.ndarray:
    """Parities of the elements by bit; two sketches differ in at most as many bits as the sets in elements."""
    bits = np.bincount((mix(h) % np.uint64(SKETCH * 64)).astype(np.int64), minlength=SKETCH * 64) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _index(sets: DataFrame, threshold: float) -> DataFrame:
    """(sig, rid, size) of all sets that some set may be similar to."""

    def of(bands: Bands, r: int, s: int, h: np.ndarray, df: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        if s - len(h) <= bands.difference(s, math.floor(s / threshold + 1e-9)):
            band = band_of(s)
            sig = index_signatures(h, df, band, bands.segments(band))
            yield sig, np.full(len(sig), r), np.full(len(sig), s, np.int32)

    return _each_set(sets, threshold, of, ("sig bigint", "rid bigint", "size int"))


def _probe(sets: DataFrame, threshold: float, total: int) -> DataFrame:
    """(sig, rid, note) of all sets that may be similar to one of at most their size; the note holds the
    size, the weight and the least weight in one number (from the right: 8 bits each, then the size)."""

    def of(bands: Bands, r: int, s: int, h: np.ndarray, df: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        for band, bound in bands.asked(s):
            need = bound - (s - len(h)) + 1
            if need >= 1:
                sig, weight, least = probe_signatures(h, df, band, bands.segments(band), need, total)
                yield sig, np.full(len(sig), r), (s << 16) + (weight << 8) + least

    return _each_set(sets, threshold, of, ("sig bigint", "rid bigint", "note bigint"))


def _each_set(sets: DataFrame, threshold: float, of, columns: tuple[str, ...]) -> DataFrame:
    """The rows ``of`` gives for every set, in batches of bounded size."""
    names = [c.split()[0] for c in columns]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(threshold)
        for batch in it:
            rid, size = batch.column("rid").to_pylist(), batch.column("size").to_pylist()
            h, often = batch.column("h"), batch.column("often")
            offsets = h.offsets.to_numpy() - h.offsets[0].as_py()
            h_all, df_all = h.flatten().to_numpy().view(np.uint64), often.flatten().to_numpy().astype(np.int64)
            made, rows = [], 0
            for i, (r, s) in enumerate(zip(rid, size, strict=True)):
                for part in of(bands, r, s, h_all[offsets[i] : offsets[i + 1]], df_all[offsets[i] : offsets[i + 1]]):
                    made.append(part)
                    rows += len(part[0])
                if made and (rows > 200_000 or i == len(rid) - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*made, strict=True)], names=names)
                    made, rows = [], 0

    return sets.select("rid", "size", "h", "often").mapInArrow(batches, ", ".join(columns))


def _sketches(sets: DataFrame) -> DataFrame:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = [sketch(np.asarray(h, np.int64).view(np.uint64)) for h in batch.column("hs").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("size"), pa.array(out, pa.list_(pa.int64()))], names=["rid", "size", "sketch"])

    return sets.select("rid", "size", "hs").mapInArrow(batches, "rid bigint, size int, sketch array<bigint>")


def similar_classes(docs: DataFrame, key: str, elements: Column, hashes: Column, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members as rid, key; pairs as rid_a, rid_b of different classes that are similar).

    Records with the same set of elements are one class, ``rid`` being the least of its keys.  Records
    without elements are in no class."""
    hashed = docs.select(F.col(key).cast("bigint").alias("id"), F.sort_array(F.array_distinct(hashes)).alias("hs")).where("size(hs) > 0")
    hashed = materialize(hashed.select("id", F.md5(F.array_join(F.col("hs").cast("array<string>"), ",")).alias("same"), "hs"))
    classes = hashed.groupBy("same").agg(F.min("id").alias("rid"))
    members = materialize(hashed.select("id", "same").join(classes, "same").select("rid", F.col("id").alias(key)))
    # Only copies are looked up to leave them out, so the sets themselves are not shuffled.
    copies = members.where(F.col("rid") != F.col(key)).select(F.col(key).alias("id"))
    reps = hashed.join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, "id", "left_anti").select(F.col("id").alias("rid"), F.size("hs").alias("size"), "hs")
    total = members.where(F.col("rid") == F.col(key)).select("rid").distinct().count()
    each = reps.select("rid", "size", F.explode("hs").alias("h"))
    often = each.groupBy("h").agg(F.count("*").cast("int").alias("n")).where("n > 1")
    shared = each.join(often, "h").groupBy("rid").agg(F.first("size").alias("size"), F.collect_set(F.struct("h", "n")).alias("s"))
    # A set that shares no element is similar to none.
    sets = materialize(shared.select("rid", "size", F.col("s.h").alias("h"), F.col("s.n").alias("often")))
    index, probe = _index(sets, threshold), _probe(sets, threshold, total)
    met = probe.alias("p").join(index.alias("i"), "sig").where(f"p.rid <> i.rid AND i.size <= (p.note >> 16) AND i.size >= {threshold} * (p.note >> 16) - 1e-9")
    # A pair is met once in a segment at most, so its weights add up to those of the segments it is met in.
    weighed = met.groupBy(F.col("p.rid").alias("p"), F.col("i.rid").alias("i")).agg(F.sum(F.expr("(note >> 8) & 255")).alias("weight"), F.max(F.expr("note & 255")).alias("least")).where("weight >= least")
    candidates = weighed.select(F.least("p", "i").alias("rid_a"), F.greatest("p", "i").alias("rid_b")).distinct()
    near = _sketches(reps)
    a = near.select(F.col("rid").alias("rid_a"), F.col("size").alias("size_a"), F.col("sketch").alias("sketch_a"))
    b = near.select(F.col("rid").alias("rid_b"), F.col("size").alias("size_b"), F.col("sketch").alias("sketch_b"))
    apart = "aggregate(zip_with(sketch_a, sketch_b, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)"
    bound = (1 - threshold) / (1 + threshold)
    likely = materialize(candidates.join(a, "rid_a").join(b, "rid_b").where(f"{apart} <= {bound} * (size_a + size_b) + 1e-9").select("rid_a", "rid_b").distinct())
    # Verified on the elements themselves, read again for the few records that are left.
    left = materialize(likely.select(F.col("rid_a").alias("rid")).union(likely.select("rid_b")).distinct())
    if left.count() <= BROADCAST_ROWS:
        left = F.broadcast(left)
    some = docs.withColumn("rid", F.col(key).cast("bigint")).join(left, "rid", "left_semi")
    text = materialize(some.select("rid", elements.alias("e")).dropDuplicates(["rid"]))
    both = likely.join(text.select(F.col("rid").alias("rid_a"), F.col("e").alias("ea")), "rid_a").join(text.select(F.col("rid").alias("rid_b"), F.col("e").alias("eb")), "rid_b")
    shared_n = both.select("rid_a", "rid_b", F.size(F.array_intersect("ea", "eb")).alias("n"), (F.size("ea") + F.size("eb")).alias("s"))
    return members, shared_n.where(f"n >= {threshold} * (s - n) - 1e-9").select("rid_a", "rid_b")


def near_duplicates(docs: DataFrame, key: str = "record_id", elements: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs (``key``_a, ``key``_b), smaller first, of records with a similarity of at least ``threshold``.

    ``key`` is taken to be unique.  Records without elements (null or empty fields) are near nothing;
    null paragraphs have no words, a null volume no pair; equal sets are similar.  Only direct pairs."""
    own = elements is not None
    hashes = F.transform(elements, lambda e: F.xxhash64(e)) if own else record_hashes()
    members, pairs = similar_classes(docs, key, elements if own else record_elements(), hashes, threshold)
    a = members.select(F.col("rid").alias("rid_a"), F.col(key).alias("a"))
    b = members.select(F.col("rid").alias("rid_b"), F.col(key).alias("b"))
    across = pairs.join(a, "rid_a").join(b, "rid_b").select("a", "b")
    many = members.groupBy("rid").count().where("count > 1").select("rid")
    copies = members.join(many, "rid", "left_semi")
    within = copies.select("rid", F.col(key).alias("a")).join(copies.select("rid", F.col(key).alias("b")), "rid").where("a < b").select("a", "b")
    return across.unionByName(within).select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b"))
