"""News: engagement, first sightings, newest per symbol, searches that widen by tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bellwether.session import join_counted, materialize


def engaged(points: Column, comments: Column, url: Column, title: Column) -> Column:
    """Some points or comments, an address and a title; null points count as none."""
    return ((F.coalesce(points, F.lit(0)) > 0) | (F.coalesce(comments, F.lit(0)) > 0)) & (F.coalesce(url, F.lit("")) != "") & (F.coalesce(title, F.lit("")) != "")


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each group of ``keys`` by ``order`` (unique), combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*").select(*df.columns)


def newest(df: DataFrame, by: str, date: str, tie: str, n: int) -> DataFrame:
    """The ``n`` rows of each group with the latest ``date`` (a string; blank or null ones come last), ties
    by ``tie`` descending.  Groups are cut per task first, so a hot group is no single sort."""
    rank = [F.coalesce(F.col(date), F.lit("")).desc(), F.col(tie).desc()]
    salted = Window.partitionBy(by, F.pmod(F.xxhash64(tie), F.lit(32))).orderBy(*rank)
    some = df.withColumn("__rn", F.row_number().over(salted)).where(F.col("__rn") <= n)
    w = Window.partitionBy(by).orderBy(*rank)
    return some.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def title_words(text: Column) -> Column:
    """The distinct words of a title or a query, lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def search(articles: DataFrame, queries: DataFrame, page: int = 50, start: str | None = None, end: str | None = None) -> DataFrame:
    """Articles for each query: ``queries`` (query_id, query), ``articles`` (article_id, title, publish_date, …).

    An article is found if its title has all words of the query, in any order, and its date lies within
    [``start``, ``end``] (dates as strings).  A page has the newest min(``page``, PAGE) of them, ties by article_id
    descending: the articles' columns, query_id and rank from 1.  Queries without words find nothing, repeated
    ones are one; null titles have no words.

    A query is looked up by its rarest word alone, so titles are exploded once and met in an equi-join, however
    many words a query has; pages are cut per salt before they are cut as a whole."""
    page = min(page, PAGE)
    if start is not None:
        articles = articles.where(F.col("publish_date") >= start)
    if end is not None:
        articles = articles.where(F.col("publish_date") <= end)
    asked = queries.select("query_id", title_words(F.col("query")).alias("asked")).where(F.size("asked") > 0).dropDuplicates(["query_id"])
    asked = materialize(asked)
    titled = articles.withColumn("__words", title_words(F.col("title")))
    words = materialize(join_counted(titled.select("article_id", F.explode("__words").alias("word")), asked.select(F.explode("asked").alias("word")).distinct(), "word", "left_semi"))
    often = words.groupBy("word").agg(F.count("*").alias("n"))
    # A word that no title has is the rarest: its query finds nothing.
    rarest = asked.select("query_id", "asked", F.explode("asked").alias("word")).join(often, "word", "left").groupBy("query_id").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"), F.first("asked").alias("asked"))
    found = join_counted(words, rarest, "word").select("query_id", "article_id", "asked").join(titled, "article_id").where(F.size(F.array_except("asked", "__words")) == 0).drop("asked", "__words")
    ranked = newest(found, "query_id", "publish_date", "article_id", page)
    w = Window.partitionBy("query_id").orderBy(F.coalesce(F.col("publish_date"), F.lit("")).desc(), F.col("article_id").desc())
    return ranked.withColumn("rank", F.row_number().over(w))


#: Words of an industry's name that are not its category.
MODIFIERS = ("specialty", "integrated", "diversified", "advanced", "general", "industrial", "commercial", "consumer")
#: At most so many results a page, so many competitors asked for, and the shares of the results wanted below
#: which a search widens to the ticker, to the industry and to competitors.
PAGE, COMPETITORS, WIDEN = 1000, 3, (0.5, 0.3, 0.5)


def main_keyword(industry: Column) -> Column:
    """The last word of an industry's name that is no modifier, if the name has several words."""
    words = F.filter(F.split(industry, r"\s+"), lambda w: (w != "") & ~F.lower(w).isin(*MODIFIERS))
    return F.when(industry.contains(" ") & (F.size(words) > 0), F.nullif(F.element_at(words, -1), industry))


def cascade(articles: DataFrame, companies: DataFrame, wanted: int = 50, start: str | None = None, end: str | None = None) -> DataFrame:
    """News of companies by searches that widen: (key, rank, tier, article_id, url).

    ``companies`` has key (unique), name, ticker, industry and competitors (an array); any but the key may be
    null.  Tiers: 1 the name; 2 ticker and name, below half of ``wanted`` and for tickers of three signs or more;
    3 the industry and 4 its main keyword, below 30 % and for half of what is left; 5 to 7 competitors, below
    half, an equal part of what was left each.  A page of results is what its search may return; of these only
    engaged articles with a new address count, in the search's order.

    All tiers are searched at once, a page each.  What a tier may add depends on those before, so each company's
    pages (at most 7 × ``wanted`` articles) are folded in order."""
    c = companies.select("key", "name", "ticker", "industry", F.coalesce(F.slice("competitors", 1, COMPETITORS), F.array().cast("array<string>")).alias("rivals"))
    c = materialize(c.withColumn("keyword", main_keyword(F.col("industry"))))
    asked = [(1, F.col("name")), (2, F.when(F.length("ticker") >= 3, F.concat_ws(" ", "ticker", "name"))), (3, F.col("industry")), (4, F.col("keyword"))]
    asked += [(5 + k, F.get("rivals", k)) for k in range(COMPETITORS)]
    each = c.select("key", F.explode(F.array(*(F.struct(F.lit(t).alias("tier"), q.alias("query")) for t, q in asked))).alias("q")).select("key", "q.*").where("query is not null")
    # Companies that ask the same are one query.
    pages = search(articles, each.select(F.col("query").alias("query_id"), "query").distinct(), wanted, start, end)
    hit = F.struct("rank", "article_id", "url", engaged(F.col("points"), F.col("num_comments"), F.col("url"), F.col("title")).alias("good"))
    listed = pages.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))  # at most a page
    tiers = each.join(listed, each["query"] == listed["query_id"]).groupBy("key").agg(F.collect_list(F.struct("tier", "hits")).alias("tiers"))
    picked = "array<struct<tier:int,article_id:bigint,url:string>>"
    x = c.join(tiers, "key")
    state = F.array().cast(picked)
    n_rivals = F.greatest(F.size("rivals"), F.lit(1))

    def add(s: Column, tier: int, allowed: Column, room: Column) -> Column:
        hits = F.slice(F.coalesce(F.get(F.filter("tiers", lambda t: t["tier"] == tier), 0)["hits"], F.array().cast("array<struct<rank:int,article_id:bigint,url:string,good:boolean>>")), F.lit(1), F.greatest(room, F.lit(0)).cast("int"))
        seen = F.transform(s, lambda p: p["url"])
        new = F.filter(hits, lambda h, i: h["good"] & ~F.array_contains(seen, h["url"]) & ~F.exists(F.slice(hits, F.lit(1), i), lambda g: g["good"] & (g["url"] == h["url"])))
        return F.when(allowed, F.concat(s, F.transform(new, lambda h: F.struct(F.lit(tier).alias("tier"), h["article_id"].alias("article_id"), h["url"].alias("url"))))).otherwise(s)

    def then(x: DataFrame, tier: int, allowed: Column, room: Column) -> DataFrame:
        return x.withColumn("s", add(F.col("s"), tier, allowed, room))

    some, few, half = (share * wanted for share in WIDEN)
    x = then(x.withColumn("s", state), 1, F.lit(True), F.lit(wanted))
    x = then(x, 2, F.size("s") < some, F.lit(wanted) - F.size("s"))
    x = x.withColumn("left", F.lit(wanted) - F.size("s")).withColumn("broad", F.size("s") < few)
    x = then(x, 3, F.col("broad"), F.expr("left div 2"))
    x = then(x, 4, F.col("broad") & (F.size("s") < few), F.expr("left div 2"))
    x = x.withColumn("part", ((F.lit(wanted) - F.size("s")) / n_rivals).cast("int")).withColumn("rival", F.col("broad") & (F.size("s") < half))
    for k in range(COMPETITORS):
        x = then(x, 5 + k, F.col("rival") & (F.size("s") < wanted), F.col("part"))
    out = x.select("key", F.posexplode(F.slice("s", 1, wanted)).alias("p", "r"))
    return out.select("key", (F.col("p") + 1).alias("rank"), "r.tier", "r.article_id", "r.url")
