"""Texts cut off before their end, found from word trigrams inside texts and at their ends, in SQL.

A note or fragment that a cut leaves behind ("… [+120 chars]", half a tag, a broken character) is taken
off first.  The last three tokens are then looked up in the counts over all texts: how often texts end with
them, and how often a text goes on after them.  After a mark a text is cut if other texts hardly ever end with
that mark; what a finished end looks like is thus learned from the corpus.  After a word it is cut if texts go on
more often than they end there; a longer word begun by the last one counts as going on, and sign-offs, tags,
links and labels end texts as a rule.  Where the three tokens have been seen too seldom, the last two, what
follows the two before, and the last word decide, in this order; a last word that nothing is known about is cut
off.  The point of a number ends nothing that no other text has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bellwether.session import materialize

#: Notes and fragments that a cut leaves behind, at the end of a text.
REMAINS = r"(?:\s|\p{Z}|\p{Cf}|\x{FFFD}|…|\.{3,}|\[\s*(?:\+\s*\d+\s*\w*|…|\.{3})\s*\]|\((?:continued|truncated|cont\.?|more)\)|\[(?:continued|truncated|more|cut)\]|<[A-Za-z/!][^<>]*|&#?\w{0,8};?|\b(?:Continue reading|Read more|Read on|Show more|See more|Weiterlesen|Lire la suite|Leer más)\b[\s.…»>→]*)+$"
#: Half a character, half a tag or a count of missing signs: such an end is broken whatever comes before.
BROKEN = r"(\x{FFFD}|<[A-Za-z/!][^<>]*|\[\s*\+\s*\d+[^\]]*\])[\s\p{Z}\p{Cf}]*$"
#: So many sightings of the last tokens make their counts decide.
EVIDENCE = 3
#: A mark that fewer than this share of its sightings end a text with is no end.
MARK_ENDS = 0.01

#: Words, numbers (with their points) and dates, and every other sign, of a lower-case text.
TOKEN = r"\p{L}[\p{L}\p{M}]*|0(?:[.,\x{A0}\x{202F}]0)*|[^\s\p{Z}\p{L}0]"

#: Marks that end sentences, and what may close after them.  Before anything is counted, such an end
#: is taken to have been seen so many times, and at the end of a text in this share of them.
SENTENCE_ENDS, CLOSING, PRIOR, PRIOR_ENDS = ".!?。！？…", "\"'”’»)]*_`", 50, 0.1
#: Blanks and invisible characters that may follow a text.
BLANKS = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)))
#: A token that is a mark: no word, number or date.
MARK = r"^[^\p{L}0\x{1}]"
#: What a cut leaves behind lies within so many last signs, or after the last tag that isn't closed.
END = 400

_BODIES = """
SELECT id, text, size, concat(left(text, greatest(length(text) - size, 0)), regexp_replace(right(text, size), :remains, '')) AS body FROM (
  SELECT id, text, length(text) - length(rtrim(:blanks, text)) + greatest(:end, CASE WHEN instr(reverse(text), '<') < coalesce(nullif(instr(reverse(text), '>'), 0), length(text)) THEN instr(reverse(text), '<') ELSE 0 END) AS size
  FROM {texts} WHERE text RLIKE :content)
"""
_TOKENS = """
SELECT *, regexp_extract_all(regexp_replace(regexp_replace(lower(said), :date, '\\u0001'), '[0-9]+', '0'), :token, 0) AS t FROM {bodies}
"""
_ENDS = """
SELECT id, size(t) AS n, coalesce(try_element_at(t, -1), '') AS z, coalesce(try_element_at(t, -2), '') AS y, coalesce(try_element_at(t, -3), '') AS x, noted, broken, copy,
  said RLIKE '[0-9][.]$' AND coalesce(try_element_at(t, -2), '') = '0' AS pointed, coalesce(try_element_at(t, -1) RLIKE :mark, false) AS marked,
  CASE WHEN try_element_at(t, -2) RLIKE :mark THEN try_element_at(t, -2) ELSE '' END AS y_mark
FROM {tokens}
"""
_INSIDE = """
SELECT w.x, w.y, w.z, count(*) AS n FROM (
  SELECT explode(transform(sequence(1, size(t) - 1), i -> struct(p[i - 1] AS x, p[i] AS y, p[i + 1] AS z))) AS w
  FROM (SELECT t, concat(array('', ''), t) AS p FROM {tokens} WHERE size(t) > 1))
GROUP BY w.x, w.y, w.z
"""
#: The last tokens of texts that end with a word, or with the point of a number, with the number of different texts.
_LAST = "last AS (SELECT x, y, z, pointed, count(DISTINCT copy) AS ends FROM {ends} WHERE n > 0 AND (pointed OR NOT marked) GROUP BY x, y, z, pointed)"
#: By level the texts that end like this, and what goes on like this: all three tokens (3), the last two (2), any
#: third after the two before (3 with an empty third), the last alone (1).  What begins with the last token goes on
#: like it; it is only looked at after tokens that some text ends with.
_LEVELS = f"""
WITH {_LAST},
asked AS (
  SELECT l.*, sum(ends) AS ends FROM (
    SELECT explode(filter(array(named_struct('level', 3, 'a', x, 'b', y, 'c', z), named_struct('level', 2, 'a', '', 'b', y, 'c', z), named_struct('level', 3, 'a', x, 'b', y, 'c', ''), named_struct('level', 1, 'a', '', 'b', '', 'c', z)), s -> NOT pointed OR s.level = 3 AND s.c <> '')) AS l, ends FROM last)
  GROUP BY l.level, l.a, l.b, l.c),
after AS (SELECT DISTINCT level, a, b FROM asked),
found AS (
  SELECT i.level, i.a, i.b, i.z, i.n FROM (SELECT k.level, k.a, k.b, z, n FROM (SELECT z, n, explode(array(named_struct('level', 3, 'a', x, 'b', y), named_struct('level', 2, 'a', '', 'b', y), named_struct('level', 1, 'a', '', 'b', ''))) AS k FROM {{inside}})) i
  LEFT SEMI JOIN after f ON i.level = f.level AND i.a = f.a AND i.b = f.b),
seen AS (SELECT level, a, b, left(z, k) AS c, sum(n) AS n FROM (SELECT *, explode(sequence(CASE WHEN level = 3 THEN 0 ELSE 1 END, length(z))) AS k FROM found) GROUP BY level, a, b, left(z, k))
SELECT q.level, q.a, q.b, q.c, q.ends, coalesce(s.n, 0) AS goes_on FROM asked q LEFT JOIN seen s ON q.level = s.level AND q.a = s.a AND q.b = s.b AND q.c = s.c
"""
#: By last tokens: whether a text that ends with them is cut, by the first level that has evidence.
_WORDS = f"""
WITH {_LAST},
asks AS (SELECT x, y, z, pointed, q.* FROM (SELECT x, y, z, pointed, explode(filter(array(named_struct('turn', 1, 'level', 3, 'a', x, 'b', y, 'c', z), named_struct('turn', 2, 'level', 2, 'a', '', 'b', y, 'c', z), named_struct('turn', 3, 'level', 3, 'a', x, 'b', y, 'c', ''), named_struct('turn', 4, 'level', 1, 'a', '', 'b', '', 'c', z)), s -> NOT pointed OR s.turn = 1)) AS q FROM last))
SELECT x, y, z, pointed, CASE WHEN pointed THEN max(l.goes_on) = 0 ELSE coalesce(min_by(l.goes_on > l.ends, turn) FILTER (WHERE l.ends + l.goes_on >= :evidence), true) END AS cut
FROM asks JOIN {{levels}} l ON asks.level = l.level AND asks.a = l.a AND asks.b = l.b AND asks.c = l.c
GROUP BY x, y, z, pointed
"""
#: By last mark and the mark before it, if that is one: whether it is no end.  Too seldom a mark is judged
#: like the last of the two alone, or else like all marks.
_MARKS = """
WITH seen AS (
  SELECT y_mark, z, 0 AS n, count(DISTINCT copy) AS ends FROM {ends} WHERE marked GROUP BY y_mark, z
  UNION ALL SELECT CASE WHEN y RLIKE :mark THEN y ELSE '' END, z, sum(n), 0 FROM {inside} WHERE z RLIKE :mark GROUP BY 1, 2),
both AS (SELECT y_mark, z, sum(ends) AS ends, sum(n) AS n FROM seen GROUP BY y_mark, z)
SELECT y_mark, z,
  CASE WHEN ends + n + prior >= :evidence THEN ends - 1 + :prior_ends * prior < :share * (ends - 1 + n + prior)
       WHEN ends1 + n1 >= :evidence THEN ends1 - 1 < :share * (ends1 - 1 + n1)
       ELSE all_ends < :share * (all_ends + all_n) END AS cut
FROM (
  SELECT *, sum(ends) OVER (PARTITION BY z) AS ends1, sum(n) OVER (PARTITION BY z) AS n1, sum(ends) OVER () AS all_ends, sum(n) OVER () AS all_n,
    CASE WHEN contains(:sentence, z) OR y_mark <> '' AND contains(:sentence, y_mark) AND contains(:closing, z) THEN :prior ELSE 0 END AS prior
  FROM both) WHERE ends > 0
"""
_CUT = """
SELECT a.id.* FROM {ends} a
LEFT JOIN {words} w ON a.x = w.x AND a.y = w.y AND a.z = w.z AND a.pointed = w.pointed
LEFT JOIN {marks} m ON a.marked AND a.y_mark = m.y_mark AND a.z = m.z
WHERE a.broken OR a.n = 0 AND a.noted OR a.n > 0 AND CASE WHEN a.marked THEN m.cut OR a.pointed AND coalesce(w.cut, false) ELSE w.cut END
"""


def truncated(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The ``keys`` of the texts that are cut off.

    Null texts, and those of nothing but blanks and invisible characters, are not.  Keys may repeat;
    every row is judged by its own text.  Counts are over all given texts: how texts go on (``goes_on``)
    counts the words themselves and longer words that begin like the last one.  Copies of a text
    count once as an end.  Trigrams are combined before their shuffle, and shorter words' counts come from them.  An empty table gives none."""
    spark = texts.sparkSession
    rows = texts.select(F.struct(*keys).alias("id"), F.col(text).alias("text"))
    bodies = spark.sql(_BODIES, args={"end": END, "remains": REMAINS, "blanks": BLANKS, "content": r"[^\s\p{Cf}\p{Z}]"}, texts=rows)
    words = {"date": "[0-9]{4}-[0-9]{2}-[0-9]{2}", "token": TOKEN}
    # The end of a text is told by its last signs; how texts go on, by all they say.
    tails = bodies.select("id", F.right("body", F.lit(END)).alias("said"), F.expr("length(body) < length(rtrim(text))").alias("noted"), F.expr("right(text, size)").rlike(BROKEN).alias("broken"), F.xxhash64("text").alias("copy"))
    ends = materialize(spark.sql(_ENDS, args={"mark": MARK}, tokens=spark.sql(_TOKENS, args=words, bodies=tails)))
    inside = materialize(spark.sql(_INSIDE, tokens=spark.sql(_TOKENS, args=words, bodies=bodies.select(F.col("body").alias("said")))))
    levels = materialize(spark.sql(_LEVELS, ends=ends, inside=inside))
    by_words = spark.sql(_WORDS, args={"evidence": EVIDENCE}, ends=ends, levels=levels)
    by_marks = spark.sql(_MARKS, args={"evidence": EVIDENCE, "share": MARK_ENDS, "mark": MARK, "sentence": SENTENCE_ENDS, "closing": CLOSING, "prior": PRIOR, "prior_ends": PRIOR_ENDS}, ends=ends, inside=inside)
    return spark.sql(_CUT, ends=ends, words=by_words, marks=by_marks)


def truncation_rates(texts: DataFrame, cut: DataFrame, keys: list[str], source: list[str]) -> DataFrame:
    """(``source``, n_texts, n_truncated, share) of each source; null is a source of its own."""
    marked = texts.join(cut.select(*keys).distinct().withColumn("__cut", F.lit(1)), keys, "left")
    counts = marked.groupBy(*source).agg(F.count("*").alias("n_texts"), F.count("__cut").alias("n_truncated"))
    return counts.withColumn("share", F.col("n_truncated") / F.col("n_texts"))
