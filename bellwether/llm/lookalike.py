"""One consistent form for texts that look the same though their characters differ.

A vocabulary of plainly written words is counted from the corpus and kept in a trie.  The words of a
text walk the trie with a weighted edit automaton in which look-alike letters, full-width and joined
forms, composed and combining accents and invisible characters cost nothing; any other edit costs one
and is out of reach of the budget of zero.  Among the words reached, the most frequent is the canonical
spelling; a word that reaches none is normalised by the character table.

The zero-cost relation is an equivalence (two words are related if the table gives both the same
form), so all words of a class reach the same spellings, and texts that look the same come out equal
whatever the vocabulary holds.  A word that the vocabulary doesn't know is written in one script: that of
its letters without look-alikes, else that of the text's, else Latin, so that no plain Cyrillic or Greek
word is mixed with Latin letters.  Both are read off the table's form, which look-alikes share."""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bellwether.session import materialize

#: Letters of other scripts with the shape of a Latin letter (after canonical decomposition).
SAME_SHAPE = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ԝ": "W", "Х": "X", "Ү": "Y",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "Ζ": "Z",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Տ": "S", "ւ": "L",
    "ѵ": "v", "ү": "y", "Ѵ": "V", "Ӏ": "I", "ɡ": "g", "ℓ": "l",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
}
#: Scripts with letters of a Latin shape.
SCRIPTS = ("CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "LISU")
#: The vocabulary holds at most so many words of at most so many letters, seen at least so often.
VOCABULARY_WORDS, VOCABULARY_LETTERS, VOCABULARY_SEEN = 1 << 16, 32, 3
REMEMBERED = 1 << 18
_COMPATIBLE = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>")


@lru_cache(maxsize=1 << 16)
def fold(char: str) -> str:
    """The table's form of one character: '' if it is invisible, a blank if it is a kind of blank."""
    code = ord(char)
    if code < 0x80:
        return " " if char == "\t" else char
    category = unicodedata.category(char)
    if category == "Cf" or 0xFE00 <= code <= 0xFE0F or code in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
        return ""
    if category == "Zs":
        return " "
    if category in ("Zl", "Zp") or code == 0x85:
        return "\n"
    tag, _, rest = unicodedata.decomposition(char).partition(" ")
    joined = tag == "<compat>" and (0xFB00 <= code <= 0xFB4F or "LIGATURE" in unicodedata.name(char, "") or "ROMAN NUMERAL" in unicodedata.name(char, ""))
    if tag in _COMPATIBLE or joined:
        return "".join(fold(chr(int(c, 16))) for c in rest.split())
    return SAME_SHAPE.get(char, char)


def table_form(text: str) -> str:
    """Every character folded by the table, accents composed."""
    if text.isascii():
        return text.replace("\t", " ") if "\t" in text else text
    return unicodedata.normalize("NFC", "".join(map(fold, unicodedata.normalize("NFD", text))))


def _script(char: str) -> str:
    return unicodedata.name(char, "").split(" ")[0]


#: Of each script the letters by the Latin one they look like, the first in the table's order.
INTO: dict[str, dict[str, str]] = {s: {} for s in SCRIPTS}
for _char, _latin in SAME_SHAPE.items():
    if _script(_char) in INTO:
        INTO[_script(_char)].setdefault(_latin, _char)
_SHARED = frozenset(SAME_SHAPE.values())


@lru_cache(maxsize=1 << 16)
def _certain(char: str) -> str | None:
    """The script of a letter of the table's form that no other script's letter looks like."""
    if char in _SHARED or not char.isalpha():
        return None
    script = _script(char)
    return script if script in INTO or script == "LATIN" else None


def script_of(form: str) -> str | None:
    """The script most letters without look-alikes are of, in the table's form of a word or text."""
    votes = Counter(filter(None, map(_certain, unicodedata.normalize("NFD", form))))
    return min(votes, key=lambda s: (-votes[s], s != "LATIN", s)) if votes else None


def in_script(form: str, script: str | None) -> str:
    """The table's form of a word, its shared letters written in ``script``."""
    into = INTO.get(script or "")
    if not into:
        return form
    return unicodedata.normalize("NFC", "".join(into.get(c, c) for c in unicodedata.normalize("NFD", form)))


class Trie:
    """Plain words with their counts; ``spellings`` walks it with the edit automaton."""

    def __init__(self, words: dict[str, int]):
        self.root: dict = {}
        self.counts = words
        for word in words:
            node = self.root
            for char in unicodedata.normalize("NFD", word):
                node = node.setdefault(char, {})
            node[""] = word

    def spellings(self, word: str, budget: int = 0) -> dict[str, int]:
        """Vocabulary words within ``budget`` edits of ``word`` → least cost.  Look-alikes and invisible
        characters cost nothing; a letter replaced, left out or put in costs one."""
        signs = "".join(map(fold, unicodedata.normalize("NFD", word)))
        states: list[tuple[dict, int]] = [(self.root, 0)]
        for sign in signs:
            best: dict[int, tuple[dict, int]] = {}
            work = [(node, cost) for node, cost in states]
            if budget:  # letters of the vocabulary word that the text leaves out
                for node, cost in work:
                    work.extend((child, cost + 1) for label, child in node.items() if label and cost < budget)
            for node, cost in work:
                steps = [(child, cost + (fold(label) != sign)) for label, child in node.items() if label]
                if budget:
                    steps.append((node, cost + 1))
                for child, c in steps:
                    if c <= budget and (id(child) not in best or c < best[id(child)][1]):
                        best[id(child)] = (child, c)
            states = list(best.values())
            if not states:
                return {}
        found: dict[str, int] = {}
        work = list(states)
        for node, cost in work:
            if "" in node:
                found[node[""]] = min(cost, found.get(node[""], cost))
            if budget:
                work.extend((child, cost + 1) for label, child in node.items() if label and cost < budget)
        return found

    def canonical(self, word: str) -> str | None:
        """The most frequent plain spelling of ``word``; ties go to the table's form, then in order."""
        found = self.spellings(word)
        form = table_form(word)
        return min(found, key=lambda w: (-self.counts[w], w != form, w)) if found else None


class Canonical:
    """Texts to their canonical form in one worker."""

    def __init__(self, words: dict[str, int]):
        self.trie, self.known = Trie(words), {}
        self.pieces = regex.compile(r"[\p{L}\p{M}\p{Cf}]+|[^\p{L}\p{M}\p{Cf}]+").findall
        self.word = regex.compile(r"[\p{L}\p{M}\p{Cf}]").match

    def piece(self, p: str) -> str | None:
        """The form of a piece, or None if it takes the text to tell its script."""
        form = table_form(p)
        if self.word(p):
            form = self.trie.canonical(p) or ((script := script_of(form)) and in_script(form, script))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.known[p] = form
        return form

    def text(self, t: str) -> str:
        pieces = self.pieces(t.replace("\r\n", "\n"))
        forms = [self.known[p] if p in self.known else self.piece(p) for p in pieces]
        if None in forms:
            script = None if t.isascii() else script_of(table_form(t))
            forms = [in_script(table_form(p), script) if f is None else f for p, f in zip(pieces, forms, strict=True)]
        # A full-width sign or a combining accent may join what the pieces part: compose once more.
        out = "".join(forms)
        return out if out.isascii() else unicodedata.normalize("NFC", out)


def plain_words(docs: DataFrame, text: str) -> dict[str, int]:
    """Words of one script without invisible, full-width or joined forms, with their counts over all
    texts: the most frequent within the vocabulary's bounds, ties in order of the word."""
    words = docs.where(F.col(text).isNotNull()).select(F.explode(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}]+"), F.lit(0))).alias("w"))
    counts = words.where(F.length("w") <= VOCABULARY_LETTERS).groupBy("w").count().where(F.col("count") >= VOCABULARY_SEEN)
    plain = F.col("w").rlike(r"^([\p{IsLatin}]+|[\p{IsCyrillic}]+|[\p{IsGreek}]+|[\p{IsArmenian}]+)$") & ~F.col("w").rlike(r"[ﬀ-ﭏ＀-￯]")
    top = counts.where(plain).orderBy(F.desc("count"), "w").limit(VOCABULARY_WORDS)
    return {r.w: r["count"] for r in top.collect()}  # bounded by VOCABULARY_WORDS


def _canonical(docs: DataFrame, key: str, text: str, columns) -> DataFrame:
    words = docs.sparkSession.sparkContext.broadcast(plain_words(docs, text))  # bounded by VOCABULARY_WORDS

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Canonical(words.value)
        for batch in it:
            texts = batch.column(1).to_pylist()
            forms = [None if t is None else worker.text(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns(texts, forms))], names=[key, *_names(columns)])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(batches, f"`{key}` {kind}, " + ", ".join(f"{n} string" for n in _names(columns)))


def _names(columns) -> tuple[str, ...]:
    return ("canonical",) if columns is _form else ("look", "spelled")


def _form(texts, forms):
    return (forms,)


def _digest(t: str | None) -> str | None:
    return None if t is None else hashlib.blake2b(t.encode(), digest_size=16).hexdigest()


def _digests(texts, forms):
    return list(map(_digest, forms)), list(map(_digest, texts))


def canonical_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, canonical) of every row.  Null stays null and empty empty; repeated rows come out each."""
    return _canonical(docs, key, text, _form)


def look_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, class_id, n_spellings) of every row with a text: the least key of those that look the same,
    and how many different texts they are.  Copies are counted before the shuffle, no pairs are made."""
    rows = materialize(_canonical(docs, key, text, _digests).where("look is not null"))
    spellings = rows.groupBy("look", "spelled").agg(F.min(key).alias("first"))
    classes = spellings.groupBy("look").agg(F.min("first").alias("class_id"), F.count("*").alias("n_spellings"))
    return rows.join(classes, "look").select(key, "class_id", "n_spellings")


def same_looks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs (``key``_a, ``key``_b), smaller first, of rows whose texts differ but look the same.

    Rows are reduced to digests of their canonical form and of their text.  Different texts of one look
    are paired as classes first, exact copies being one class, and only then joined with their members;
    a class of copies is never paired with itself.  Null texts look like nothing; an empty text and one
    of invisible characters only look the same."""
    rows = materialize(_canonical(docs, key, text, _digests).where("look is not null"))
    classes = rows.select("look", "spelled").distinct()
    many = classes.groupBy("look").count().where("count > 1").select("look")
    some = classes.join(many, "look", "left_semi")
    a = some.select("look", F.col("spelled").alias("spelled_a"))
    b = some.select("look", F.col("spelled").alias("spelled_b"))
    pairs = a.join(b, "look").where("spelled_a < spelled_b")
    of_a = rows.select("look", F.col("spelled").alias("spelled_a"), F.col(key).alias("a"))
    of_b = rows.select("look", F.col("spelled").alias("spelled_b"), F.col(key).alias("b"))
    out = pairs.join(of_a, ["look", "spelled_a"]).join(of_b, ["look", "spelled_b"])
    return out.select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b")).where(F.col(f"{key}_a") != F.col(f"{key}_b")).distinct()
