"""Company documents: scored paragraphs, the token budget, the final form.

A document is one row and bounded, so its parts are worked on as arrays inside the row: no operator
here shuffles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bellwether.functions.text import first_words

Count = Callable[[Column], Column]
SECTIONS = ("latest_10k", "latest_10q")
#: White space that stays white space in compact JSON; line breaks and tabs are escaped there.
JSON_BLANKS = r"[ \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: The order of removals: (what, scores).  News without relevance goes first, the best paragraphs last.
LEVELS = (("news", (0,)), ("body", (1,)), ("paragraph", (0,)), ("body", (2, 3)), *(("paragraph", (s,)) for s in range(1, 10)))


def blanks(text: Column) -> Column:
    """What a string adds to the white-space tokens of the JSON that holds it."""
    return F.coalesce(F.regexp_count(text, F.lit(JSON_BLANKS)), F.lit(0))


def scored(docs: DataFrame, score) -> DataFrame:
    """Documents with their paragraphs as (text, score), null ones left out; ``score`` gives the score from
    the record id, the section's number and the paragraph's place."""

    def of(paragraphs: Column, section: int) -> Column:
        numbered = F.transform(paragraphs, lambda p, i: F.struct(p.alias("text"), score(F.col("record_id"), section, i).cast("int").alias("score")))
        return F.filter(numbered, lambda p: p["text"].isNotNull())

    def report(node: Column, section: int) -> Column:
        return F.struct(of(node["paragraphs"], section).alias("paragraphs"), node["metadata"].alias("metadata"))

    for k, s in enumerate(SECTIONS):
        docs = docs.withColumn(s, F.when(F.col(s).isNotNull(), report(F.col(s), k)))
    return docs.withColumn("eight_k_reports", F.transform("eight_k_reports", lambda r: F.when(r.isNotNull(), report(r, 2))))


def hash_score(record: Column, section: int, place: Column) -> Column:
    """A deterministic stand-in for a relevance model: −1 … 3."""
    return F.pmod(record * 31 + F.lit(section * 7) + place, F.lit(5)) - 1


def explode_tasks(docs: DataFrame) -> DataFrame:
    """One row per paragraph or article body to be scored: (record_id, section, report, place, text).

    Blank texts are no tasks.  Articles are asked by their first 4 000 words."""
    empty = F.array().cast("array<struct<section:string,report:int,place:int,text:string>>")

    def tasks(section: str, report, paragraphs: Column) -> Column:
        return F.coalesce(F.transform(paragraphs, lambda p, i: F.struct(F.lit(section).alias("section"), report.alias("report"), i.cast("int").alias("place"), p.alias("text"))), empty)

    parts = [tasks(s, F.lit(0), F.col(f"{s}.paragraphs")) for s in SECTIONS]
    parts.append(F.coalesce(F.flatten(F.transform("eight_k_reports", lambda r, i: tasks("eight_k_reports", i.cast("int"), r["paragraphs"]))), empty))
    parts.append(F.coalesce(F.transform("hacker_news_articles", lambda a, i: F.struct(F.lit("hacker_news_articles").alias("section"), F.lit(0).alias("report"), i.cast("int").alias("place"), first_words(a["text"]).alias("text"))), empty))
    rows = docs.select("record_id", F.inline(F.concat(*parts)))
    return rows.where(F.coalesce(F.regexp_replace("text", r"(?U)\s+", ""), F.lit("")) != "")


def regroup_scores(tasks: DataFrame) -> DataFrame:
    """(record_id, section, report, paragraphs): scored rows nested again, in their order; a missing score is −1."""
    rows = tasks.groupBy("record_id", "section", "report").agg(F.array_sort(F.collect_list(F.struct("place", "text", F.coalesce("score", F.lit(-1)).alias("score")))).alias("p"))
    return rows.select("record_id", "section", "report", F.transform("p", lambda x: F.struct(x["text"], x["score"])).alias("paragraphs"))


_ACTION = "array<struct<level:int,section:int,report:int,back:int,place:int,cost:int>>"


def _actions(count: Count) -> Column:
    """All removals a document allows, in their order, with the tokens each saves."""
    none = F.array().cast(_ACTION)

    def action(level: int, section: int, report: Column, place: Column, back: Column, cost: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), F.lit(section).alias("section"), report.cast("int").alias("report"), back.cast("int").alias("back"), place.cast("int").alias("place"), cost.cast("int").alias("cost"))

    def paragraphs(level: int, section: int, report: Column, array: Column, scores: tuple) -> Column:
        each = F.transform(array, lambda p, i: F.when(p["score"].isin(*scores), action(level, section, report, i, -i, count(p["text"]))))
        return F.coalesce(F.filter(each, lambda a: a.isNotNull()), none)

    def articles(level: int, whole: bool, scores: tuple) -> Column:
        def one(a: Column, i: Column) -> Column:
            cost = count(a["text"]) if not whole else sum((count(a[f]) for f in ("title", "url", "publish_date", "text", "scoring_method")), F.lit(0))
            return F.when(a["score"].isin(*scores), action(level, 0, F.lit(0), i, -i if whole else i, cost))

        return F.coalesce(F.filter(F.transform("hacker_news_articles", one), lambda a: a.isNotNull()), none)

    def reports(level: int, scores: tuple) -> Column:
        return F.transform("eight_k_reports", lambda r, i: paragraphs(level, 2, i, r["paragraphs"], scores))

    parts = []
    for level, (what, scores) in enumerate(LEVELS):
        if what == "paragraph":
            parts += [paragraphs(level, k, F.lit(0), F.col(f"{s}.paragraphs"), scores) for k, s in enumerate(SECTIONS)]
            parts.append(F.coalesce(F.flatten(reports(level, scores)), none))
        else:
            parts.append(articles(level, what == "news", scores))
    return F.array_sort(F.concat(*parts))


def _total(count: Count = blanks) -> Column:
    """White-space tokens of the final document as compact JSON."""

    def strings(node: Column, names: tuple[str, ...]) -> Column:
        return sum((count(node[n]) for n in names), F.lit(0))

    meta = ("filing_date", "filing_url", "accession_number", "form_type", "company_ticker", "cik", "primary_document")

    def report(r: Column) -> Column:
        return strings(r["metadata"], meta) + F.aggregate(F.coalesce(r["paragraphs"], F.array().cast("array<struct<text:string,score:int>>")), F.lit(0), lambda s, p: s + count(p["text"]))

    total = F.lit(1) + count(F.col("company_name")) + count(F.col("ticker")) + strings(F.col("date_range"), ("start", "end"))
    for s in SECTIONS:
        total = total + report(F.col(s))
    total = total + F.coalesce(F.aggregate("eight_k_reports", F.lit(0), lambda s, r: s + report(r)), F.lit(0))
    return total + F.coalesce(F.aggregate("hacker_news_articles", F.lit(0), lambda s, a: s + strings(a, ("title", "url", "publish_date", "text", "scoring_method"))), F.lit(0))


def budget(docs: DataFrame, limit: int, count: Count = blanks) -> DataFrame:
    """Scored documents with ``total`` (tokens), ``applied`` (the removals it takes to come down to
    ``limit``), ``final`` (tokens then) and ``minimal`` (whether not even all removals suffice).

    The removals are applied in order until the rest fits, in one fold.  A document within the limit
    loses nothing; scores outside 0 … 9 are never removed.  ``count`` gives the tokens a string adds (a column of
    integers for a column of texts, 0 for null): white space by default, or any tokenizer's count."""
    x = docs.withColumn("total", _total(count)).withColumn("actions", _actions(count))
    fold = F.aggregate("actions", F.struct(F.col("total").alias("left"), F.lit(0).alias("n")), lambda s, a: F.when(s["left"] > limit, F.struct((s["left"] - a["cost"]).alias("left"), (s["n"] + 1).alias("n"))).otherwise(s))
    x = x.withColumn("fold", fold)
    return x.withColumn("applied", F.slice("actions", F.lit(1), F.col("fold.n"))).withColumn("final", F.col("fold.left")).withColumn("minimal", F.col("final") > limit).drop("actions", "fold")


def apply_budget(x: DataFrame) -> DataFrame:
    """The documents of ``budget`` with the removals carried out; a minimal one keeps name, ticker, dates
    and stock data only."""

    def gone(what: str, section: int, report: Column, place: Column) -> Column:
        levels = [i for i, (w, _) in enumerate(LEVELS) if w == what]
        return F.exists("applied", lambda a: a["level"].isin(*levels) & (a["section"] == section) & (a["report"] == report) & (a["place"] == place))

    def keep(paragraphs: Column, section: int, report: Column) -> Column:
        return F.filter(paragraphs, lambda p, i: ~gone("paragraph", section, report, i))

    def rebuilt(r: Column, section: int, report: Column) -> Column:
        return F.struct(keep(r["paragraphs"], section, report).alias("paragraphs"), r["metadata"].alias("metadata"))

    full = ~F.col("minimal")
    for k, s in enumerate(SECTIONS):
        x = x.withColumn(s, F.when(full & F.col(s).isNotNull(), rebuilt(F.col(s), k, F.lit(0))))
    x = x.withColumn("eight_k_reports", F.when(full, F.transform("eight_k_reports", lambda r, i: F.when(r.isNotNull(), rebuilt(r, 2, i)))))

    def article(a: Column, i: Column) -> Column:
        return F.when(~gone("news", 0, F.lit(0), i), a.withField("text", F.when(~gone("body", 0, F.lit(0), i), a["text"])))

    return x.withColumn("hacker_news_articles", F.when(full, F.filter(F.transform("hacker_news_articles", article), lambda a: a.isNotNull())))


def finalize(docs: DataFrame) -> DataFrame:
    """The final form: stock data to two places, paragraphs joined to a ``report``, scores dropped."""

    def report(r: Column) -> Column:
        return F.when(r.isNotNull(), F.struct(F.array_join(F.transform(r["paragraphs"], lambda p: p["text"]), "\n\n").alias("report"), r["metadata"].alias("metadata")))

    two = {f: F.transform(F.col(f"stock_data.{f}"), lambda v: F.round(v, 2)) for f in ("open", "high", "low", "close", "volume")}
    docs = docs.withColumn("stock_data", F.when(F.col("stock_data").isNotNull(), F.struct(*(c.alias(f) for f, c in two.items()))))
    for s in SECTIONS:
        docs = docs.withColumn(s, report(F.col(s)))
    docs = docs.withColumn("eight_k_reports", F.transform("eight_k_reports", report))
    return docs.withColumn("hacker_news_articles", F.transform("hacker_news_articles", lambda a: a.dropFields("score")))
