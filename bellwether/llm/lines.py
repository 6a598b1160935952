"""Lines repeated across the documents of one source, and the documents without them.

Duplicate documents are collapsed first: documents of one source with the same sequence of normalised
lines form a cluster, which is read once whatever its number of copies.  Lines are then counted over
clusters, with the cluster's documents and publication dates as weights, so a republished article can
be told from boilerplate.  The contract of this project's data counts documents (filing ids); the
number of clusters and dates is given beside it and may be asked for as a condition of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bellwether.session import materialize

#: A line is repeated if it is found in at least this many documents of its source.
MIN_DOCUMENTS = 5


#: Fixed value: the MD5 of nothing.
_BLANK = "d41d8cd98f00b204e9800998ecf8427e"


def line_key(line: Column) -> Column:
    """Lower case, trimmed, blanks reduced to one, every run of digits the same."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), r"(?U)\s+", " ")), "[0-9]+", "0")


def _keys(lines: Column) -> Column:
    """128-bit keys of all lines by position; null for null and blank ones."""
    return F.transform(F.transform(lines, lambda p: F.md5(line_key(p))), lambda k: F.when(k != _BLANK, k))


def line_counts(docs: DataFrame, doc: str, source: str, lines: str, date: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents as doc, source, keys; counts as source, key, n_documents, n_clusters, n_dates).

    Documents of a null source have none to recur within and are left out, as are null and blank lines.
    Only line keys are shuffled, never texts; counts are combined before the shuffle, so a source that
    holds a third of all rows is no group of one task."""
    when = F.col(date).cast("string") if date else F.lit(None).cast("string")
    keyed = docs.select(F.col(doc).alias("doc"), F.col(source).alias("source"), when.alias("date"), _keys(F.col(lines)).alias("keys")).where("source is not null and size(keys) > 0")
    keyed = keyed.withColumn("cluster", F.md5(F.array_join("keys", ",", "-")))
    # One row per cluster and date; the keys are those of any member, as all have the same.
    clusters = keyed.groupBy("source", "cluster", "date").agg(F.count("*").alias("n"), F.first("keys").alias("keys"))
    lines_of = clusters.select("source", "cluster", "date", "n", F.explode(F.array_distinct("keys")).alias("key")).where("key is not null")
    counts = lines_of.groupBy("source", "key").agg(F.sum("n").alias("n_documents"), F.countDistinct("cluster").alias("n_clusters"), F.countDistinct("date").alias("n_dates"))
    return keyed, counts


def repeated_keys(docs: DataFrame, doc: str = "filing_id", source: str = "ticker", lines: str = "paragraphs", date: str | None = "filing_date", min_documents: int = MIN_DOCUMENTS, min_clusters: int = 1, min_dates: int = 0) -> DataFrame:
    """(source, key, n_documents, n_clusters, n_dates) of the lines repeated within a source."""
    _, counts = line_counts(docs, doc, source, lines, date)
    return counts.where((F.col("n_documents") >= min_documents) & (F.col("n_clusters") >= min_clusters) & (F.col("n_dates") >= min_dates))


def repeated_lines(docs: DataFrame, doc: str = "filing_id", source: str = "ticker", lines: str = "paragraphs", min_documents: int = MIN_DOCUMENTS, min_clusters: int = 1, min_dates: int = 0, date: str = "filing_date") -> DataFrame:
    """(doc, pos) of every occurrence of a line found in at least ``min_documents`` documents of its source,
    ``min_clusters`` clusters of equal documents and on ``min_dates`` dates.

    Each document id counts once however often it holds a line; ids are taken to be unique.  Null and
    blank lines, null arrays and null sources give no rows; an empty table gives none.  The counts are
    found over clusters and joined back to whole clusters, so copies of a document cost one row."""
    keyed = docs.select(F.col(doc).alias("doc"), F.col(source).alias("source"), _keys(F.col(lines)).alias("keys")).where("source is not null and size(keys) > 0")
    keyed = materialize(keyed.withColumn("cluster", F.md5(F.array_join("keys", ",", "-"))))
    clusters = keyed.groupBy("source", "cluster").agg(F.count("*").alias("n"), F.first("keys").alias("keys"))
    of = clusters.select("source", "cluster", "n", F.explode(F.array_distinct("keys")).alias("key")).where("key is not null")
    if min_clusters > 1 or min_dates > 0:
        often = repeated_keys(docs, doc, source, lines, date, min_documents, min_clusters, min_dates).select("source", "key")
    else:
        often = of.groupBy("source", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= min_documents).select("source", "key")
    # Which keys of which cluster are repeated: one row per cluster.
    hit = of.join(often, ["source", "key"], "left_semi").groupBy("source", "cluster").agg(F.collect_set("key").alias("hits"))
    found = keyed.join(hit, ["source", "cluster"])
    return found.select("doc", F.posexplode("keys").alias("p", "key"), "hits").where("key is not null and array_contains(hits, key)").select(F.col("doc").alias(doc), F.col("p").cast("bigint").alias("pos"))


def without_repeated(docs: DataFrame, doc: str = "filing_id", source: str = "ticker", lines: str = "paragraphs", min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Every document with its lines less the repeated ones, in order: all rows and columns of ``docs``.

    Null lines and arrays stay as they are."""
    found = repeated_lines(docs, doc, source, lines, min_documents)
    drop = found.groupBy(F.col(doc).alias("__doc")).agg(F.collect_set("pos").alias("__drop"))
    joined = docs.join(drop, docs[doc] == F.col("__doc"), "left")
    kept = F.filter(lines, lambda p, i: ~F.coalesce(F.array_contains("__drop", i.cast("bigint")), F.lit(False)))
    return joined.withColumn(lines, kept).drop("__doc", "__drop")
