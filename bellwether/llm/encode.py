"""Encoding of a corpus with a byte-level BPE vocabulary, through a minimal acyclic transducer lexicon.

The words of all texts (pieces of the vocabulary's pattern) are counted; the frequent ones are merged
once on the driver and compiled into a minimal acyclic automaton whose transitions carry counts, so
that the path of a word adds up to its number and hence to its ids: shared prefixes and suffixes are
stored once.  The lexicon is a flat file that workers map into memory.  Words it doesn't hold are
merged exactly from the vocabulary's ranks, so the ids never depend on what the lexicon holds."""

from __future__ import annotations

import base64
import hashlib
import heapq
import mmap
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bellwether.session import put_shared

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern of the vocabulary's pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The lexicon holds at most so many words, each of at most so many bytes, seen at least so often.
LEXICON_WORDS, LEXICON_BYTES, LEXICON_SEEN = 1 << 16, 48, 2
#: A worker remembers at most so many words.
REMEMBERED = 1 << 18


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merges of one word: always the leftmost pair of least rank, in O(n log n)."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else n
        if j >= n or parts[i] + parts[j] != pair:
            continue
        parts[i], parts[j], after[i] = pair, None, after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, parts[a] + parts[b]))
    return [ranks[p] for p in parts if p is not None]


def compile_lexicon(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The minimal acyclic transducer of sorted distinct ``words``, as a flat file of five arrays.

    Built word by word in sorted order; a state is closed once no later word can reach it and replaced
    by an equal closed one.  Each transition has the number of words that come before its own among
    those of its state, so the sum along a path is the word's place in order."""
    registry: dict[tuple, int] = {}
    finals: list[bool] = []
    edges: list[tuple[tuple[int, int], ...]] = []
    path: list[list] = [[False, []]]  # open states: [final, [(byte, closed state)]]
    labels: list[int] = []

    def close(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if key not in registry:
            registry[key] = len(finals)
            finals.append(key[0])
            edges.append(key[1])
        return registry[key]

    def fold(depth: int) -> None:
        while len(path) - 1 > depth:
            path[-2][1].append((labels.pop(), close(path.pop())))

    last = b""
    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        fold(common)
        for byte in word[common:]:
            labels.append(byte)
            path.append([False, []])
        path[-1][0] = True
        last = word
    fold(0)
    root = close(path[0])
    count = [0] * len(finals)
    keys, targets, skips = [], [], []
    for s in range(len(finals)):  # targets are closed before their state
        seen = int(finals[s])
        for byte, t in edges[s]:
            keys.append(s * 256 + byte)
            targets.append(t)
            skips.append(seen)
            seen += count[t]
        count[s] = seen
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    arrays = [np.array(keys), np.array(targets), np.array(skips), np.array(finals), offsets, np.fromiter(chain.from_iterable(ids), np.int64)]
    head = np.array([root, *(len(a) for a in arrays)], np.int64)
    return b"".join([head.tobytes(), *(a.astype(np.int64).tobytes() for a in arrays)])


class Lexicon:
    """A compiled lexicon mapped into memory."""

    def __init__(self, data):
        a = np.frombuffer(data, np.int64)
        self.root, sizes, at = int(a[0]), a[1:7], 7
        parts = []
        for n in sizes:
            parts.append(a[at : at + n])
            at += n
        self.keys, self.targets, self.skips, self.finals, self.offsets, self.ids = parts

    @classmethod
    def open(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def lookup(self, words: list[bytes]) -> list[list[int] | None]:
        """The ids of each word, or None; all words walk the automaton in step."""
        out: list[list[int] | None] = [None] * len(words)
        if not words or not len(self.keys):
            return out
        size = np.array([len(w) for w in words])
        order = np.argsort(-size, kind="stable")
        size = size[order]
        text = np.zeros((len(words), LEXICON_BYTES + 1), np.uint8)
        fits = size <= LEXICON_BYTES
        for row, i in enumerate(order):
            if fits[row]:
                text[row, : size[row]] = np.frombuffer(words[i], np.uint8)
        live = np.flatnonzero(fits & (size > 0))
        state = np.full(len(words), self.root)
        number = np.zeros(len(words), np.int64)
        for j in range(LEXICON_BYTES):
            here = live[size[live] > j]
            if not len(here):
                break
            key = state[here] * 256 + text[here, j]
            e = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[e] == key
            state[here[ok]] = self.targets[e[ok]]
            number[here[ok]] += self.skips[e[ok]]
            state[here[~ok]] = -1
            live = live[state[live] >= 0]
        for row in live:
            if self.finals[state[row]]:
                k = number[row]
                out[order[row]] = self.ids[self.offsets[k] : self.offsets[k + 1]].tolist()
        return out


class Encoder:
    """Texts to ids in one worker: remembered words, then the lexicon, then exact merges."""

    _open: dict[tuple, Encoder] = {}

    def __init__(self, lexicon: Lexicon, ranks: dict[bytes, int]):
        self.lexicon, self.ranks, self.known = lexicon, ranks, {}
        self.pieces = regex.compile(PATTERN).findall

    @classmethod
    def of(cls, name: str, vocabulary: str) -> Encoder:
        if (name, vocabulary) not in cls._open:
            cls._open.clear()
            cls._open[name, vocabulary] = cls(Lexicon.open(SparkFiles.get(name)), load_ranks(SparkFiles.get(vocabulary)))
        return cls._open[name, vocabulary]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.pieces(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({w for words in split for w in words if w not in self.known})
        raw = [w.encode() for w in new]
        for word, b, ids in zip(new, raw, self.lexicon.lookup(raw), strict=True):
            self.known[word] = ids if ids is not None else merge(b, self.ranks)
        return [list(chain.from_iterable(map(self.known.__getitem__, words))) for words in split]


def frequent_words(docs: DataFrame, text: str) -> list[str]:
    """The most frequent pieces over all texts, within the lexicon's bounds; ties in order of the word."""
    # (?U): white space and letters as Unicode has them.  What is counted only decides which words are compiled.
    words = docs.where(F.col(text).isNotNull()).select(F.explode(F.regexp_extract_all(text, F.lit("(?U)" + PATTERN), F.lit(0))).alias("w"))
    counts = words.groupBy("w").count().where((F.col("count") >= LEXICON_SEEN) & (F.octet_length("w") <= LEXICON_BYTES))
    top = counts.orderBy(F.desc("count"), "w").limit(LEXICON_WORDS)
    return [r.w for r in top.select("w").collect()]  # bounded by LEXICON_WORDS


def share_lexicon(spark: SparkSession, words: list[str], vocabulary: str) -> str:
    """Compile a lexicon, put it in the shared folder and give it to all executors; its file name there."""
    ranks = load_ranks(vocabulary)
    raw = sorted({w.encode() for w in words if w})
    data = compile_lexicon(raw, [merge(w, ranks) for w in raw])
    uri = put_shared(spark, f"{hashlib.md5(data).hexdigest()}.lexicon", data)
    spark.sparkContext.addFile(uri)
    return uri.rsplit("/", 1)[-1]


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, only_count: bool = False) -> DataFrame:
    """(``key``, ids) of every row, without special tokens; with ``only_count`` (``key``, n_tokens).

    Null and empty texts have the empty list.  Any other text has the ids of the vocabulary's own
    encoder, special-token strings being ordinary text.  Repeated rows are encoded each; other columns
    are ignored; an empty table gives none.  Narrow but for the word counts, which are combined before
    their shuffle."""
    spark = docs.sparkSession
    name = share_lexicon(spark, frequent_words(docs, text), vocabulary)
    spark.sparkContext.addFile(vocabulary)  # only the driver needs to have it
    ranks = os.path.basename(vocabulary)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(name, ranks)
        for batch in it:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = encoder.encode(part.column(1).to_pylist())
                sizes = np.array([len(x) for x in ids], np.int32)
                if only_count:
                    out = pa.array(sizes, pa.int64())
                else:
                    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
                    out = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), out], names=[key, "n_tokens" if only_count else "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(batches, f"`{key}` {kind}, " + ("n_tokens bigint" if only_count else "ids array<int>"))
