"""Queries over texts, names, documents and news, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bellwether.functions import html, text, tickers
from bellwether.operators import bars, documents, filings, news, ranking
from bellwether.operators.asof import keep_last
from bellwether.plans.market import _STATEMENTS, BARS, KEYS, _keys
from bellwether.session import table

#: The token limit of the budget queries.
LIMIT = 300


def q_paragraphs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.paragraphs(F.col("text"))).alias("pos", "paragraph"))


def q_truncate_words(spark, d):
    return table(spark, d, "documents").select("doc_id", text.first_words(F.col("text"), 50).alias("head"))


def q_word_count(spark, d):
    return table(spark, d, "documents").groupBy("doc_kind").agg(F.sum(text.count_words(F.col("text"))).cast("bigint").alias("n_words"))


def q_names(spark, d):
    r = table(spark, d, "company_registry")
    return r.select("cik_str", tickers.simplify_name(F.col("title")).alias("simple"), tickers.strip_endings(F.col("title")).alias("stripped"), tickers.resolve_symbol(F.col("title")).alias("resolved"))


def q_ticker_norm(spark, d):
    t = F.col("ticker")
    return table(spark, d, "price_bars").select("ticker").distinct().select("ticker", tickers.market_symbol(t).alias("market"), tickers.registry_symbol(t).alias("registry"), tickers.file_symbol(t).alias("file"))


def q_filename_parse(spark, d):
    f = tickers.parse_file_name(F.col("file_name"))
    return table(spark, d, "company_docs").select("record_id", f["ticker"].alias("symbol"), f["date"].alias("day"), tickers.run_group(F.regexp_replace("file_name", r"\.json$", "")).alias("run_group"))


def q_volume_humanized(spark, d):
    b = bars.daily_bars(table(spark, d, "price_bars")).groupBy("symbol").agg(F.sum("volume").alias("v"))
    return b.select("symbol", text.humanize_billions(F.col("v")).alias("volume"))


#: What bodies come with: a prologue, hidden parts, a heading, lists, breaks, nested tags, a table of several rows
#: whose signs stand in cells of their own; and what is left of it.
SHAPES = (
    '<!DOCTYPE html><?xml version="1.0"?><ix:header><b>hidden</b></ix:header><xbrli:context id="c">ctx</xbrli:context><div><h2>Item 1A. Risk</h2><ul><li>First <b>point</b></li><li>Second &amp;amp; last</li></ul>'
    "<dl><dt>Term</dt><dd>Its sense</dd></dl>one<br/>two<blockquote>three</blockquote></div><table><tr><th>Year</th><th>2023</th><th>2022</th></tr><tr><td>Loss</td><td>(</td><td>12.5</td><td>)</td><td>%</td><td></td></tr>"
    "<tr><td>Sales</td><td>$</td><td>1,200</td><td>&lt;i&gt;x&lt;/i&gt;</td></tr><tr><td></td></tr></table>"
)
SHAPES_READ = ("Item 1A. Risk", "", "• First point", "• Second &amp; last", "Term: Its sense", "one", "two", "three", "", "Year | 2023 | 2022", "Loss | (12.5)%", "Sales | $ 1,200 | x")


def q_html_clean(spark, d):
    """Filings set as HTML and read back: the usual shapes, a table of the filing's identity, the paragraphs."""
    f = table(spark, d, "filings")
    escaped = F.transform(F.filter("paragraphs", lambda p: p.isNotNull()), lambda p: F.concat(F.lit("<p>"), F.regexp_replace(F.regexp_replace(p, "&", "&amp;"), "<", "&lt;"), F.lit("</p>")))
    row = F.concat(F.lit("<table><tr><td>CIK</td><td>$</td><td>"), F.coalesce("cik", F.lit("")), F.lit("</td><td>%</td></tr></table>"))
    return f.select("filing_id", html.clean_html(F.concat(F.lit("<html><script>x()</script>"), F.lit(SHAPES), row, F.array_join(escaped, "\n"), F.lit("</html>"))).alias("body"))


def q_task_explode(spark, d):
    return documents.explode_tasks(table(spark, d, "company_docs"))


def q_regroup(spark, d):
    tasks = documents.explode_tasks(table(spark, d, "company_docs")).withColumn("score", F.when(F.col("place") % 4 != 3, text.parse_score(F.col("text"))))
    return documents.regroup_scores(tasks).select("record_id", "section", "report", F.size("paragraphs").alias("n"), F.array_join(F.transform("paragraphs", lambda p: p["score"].cast("string")), ",").alias("scores"), F.md5(F.array_join(F.transform("paragraphs", lambda p: p["text"]), "|")).alias("texts"))


def _budget(spark, d):
    return documents.budget(documents.scored(table(spark, d, "company_docs"), documents.hash_score), LIMIT)


def q_budget_filter(spark, d):
    return _budget(spark, d).select("record_id", "total", "final", F.size("applied").alias("n_applied"), "minimal")


def q_budget_documents(spark, d):
    """What is left of each section, and the tokens of the final document counted anew."""
    x = documents.apply_budget(_budget(spark, d)).drop("total")
    anew = x.withColumn("total", documents._total())
    left = [F.size(F.coalesce(F.col(f"{s}.paragraphs"), F.array().cast("array<struct<text:string,score:int>>"))).alias(f"n_{s}") for s in documents.SECTIONS]
    return anew.where("not minimal").select("record_id", "total", *left, F.coalesce(F.size("hacker_news_articles"), F.lit(0)).alias("n_articles"))


def q_finalize(spark, d):
    x = documents.finalize(documents.scored(table(spark, d, "company_docs"), documents.hash_score))
    return x.select("record_id", F.md5("latest_10k.report").alias("r10k"), F.md5("latest_10q.report").alias("r10q"), F.array_join(F.transform("eight_k_reports", lambda r: F.md5(r["report"])), ",").alias("r8k"), F.array_join(F.transform(F.col("stock_data.close"), lambda v: v.cast("decimal(18,2)").cast("string")), ",").alias("closes"))


def _articles(spark, d):
    a = table(spark, d, "hacker_news_articles")
    return a.select("article_id", tickers.market_symbol(F.col("ticker")).alias("symbol"), "title", "url", "publish_date", "points", "num_comments").where(news.engaged(F.col("points"), F.col("num_comments"), F.col("url"), F.col("title")))


def q_engaged_news(spark, d):
    return _articles(spark, d).select("article_id", "symbol", "points", "num_comments")


def q_dedup_keep_first(spark, d):
    return news.first_by(_articles(spark, d).select("article_id", "url", "title"), ["url"], "article_id")


def q_dedup_keep_last(spark, d):
    a = table(spark, d, "hacker_news_articles").where("url is not null").select("url", "ingested_at", "article_id", "score")
    return keep_last(a, ["url"], ["ingested_at", "article_id"]).drop("ingested_at")


def q_topk_news(spark, d):
    once = news.first_by(_articles(spark, d).where("symbol is not null"), ["symbol", "url"], "article_id")
    return news.newest(once, "symbol", "publish_date", "article_id", 20).select("symbol", "article_id", "publish_date")


def _titled(spark, d):
    return table(spark, d, "hacker_news_articles").select("article_id", "title", "url", "publish_date", "points", "num_comments")


#: Queries of the search, by id.
SEARCHES = {1: "Covenant package", 2: "energy costs", 3: "package the board", 4: "no such words anywhere", 5: "pricing"}


def q_news_search(spark, d):
    """The newest articles of a time range whose titles have all words of a query: a page for each query."""
    asked = spark.createDataFrame(list(SEARCHES.items()), "query_id int, query string")
    found = news.search(_titled(spark, d), asked, 50, "2021-01-01", "2023-12-31")
    return found.select("query_id", "rank", "article_id", "publish_date", "title")


#: Industries that stand in for a registry's, which has none.
INDUSTRIES = ("specialty pricing", "energy costs", "general industrial", "commercial leasing portfolio", "consumer", "advanced export permits")


def q_news_cascade(spark, d):
    """Each company's articles, by searches that widen from its name to its competitors'."""
    reg = table(spark, d, "company_registry").where("ticker is not null and title is not null")
    named = reg.select("cik_str", tickers.market_symbol(F.col("ticker")).alias("key"), tickers.simplify_name(F.col("title")).alias("name"))
    one = keep_last(named.withColumn("o", -F.col("cik_str")), ["key"], ["o"]).drop("o").withColumn("g", F.col("cik_str") % 40)
    rivals = one.groupBy("g").agg(F.slice(F.array_sort(F.collect_list(F.struct("cik_str", "name"))), 1, 4).alias("r"))
    industry = F.element_at(F.array(*map(F.lit, INDUSTRIES)), (F.col("cik_str") % len(INDUSTRIES) + 1).cast("int"))
    companies = one.join(rivals, "g").select("key", "name", F.col("key").alias("ticker"), industry.alias("industry"), F.transform(F.filter("r", lambda x: x["cik_str"] != F.col("cik_str")), lambda x: x["name"]).alias("competitors"))
    return news.cascade(_titled(spark, d), companies, 10).withColumnRenamed("key", "symbol")


def q_group_mode(spark, d):
    return filings.modal_value(table(spark, d, "hacker_news_articles"), "site", "ticker", "article_id")


def q_anti_resume(spark, d):
    done = table(spark, d, "raw_company_docs").select("file_name")
    return table(spark, d, "company_docs").join(done, "file_name", "left_anti").select("record_id", "file_name")


def q_symbol_counts(spark, d):
    return table(spark, d, "price_bars").rollup("ticker").agg(F.count("*").alias("n"), F.grouping("ticker").cast("int").alias("is_total"))


def q_copy_report(spark, d):
    """Whether bars are there for each registered ticker: as written, only in lower case, or missing."""
    have = table(spark, d, "price_bars").select("ticker").distinct()
    reg = table(spark, d, "company_registry").where("ticker is not null").select(F.upper("ticker").alias("symbol")).distinct()
    upper = have.where("ticker = upper(ticker)").select(F.upper("ticker").alias("symbol")).withColumn("up", F.lit(True))
    lower = have.where("ticker = lower(ticker)").select(F.upper("ticker").alias("symbol")).withColumn("low", F.lit(True))
    x = reg.join(upper, "symbol", "left").join(lower, "symbol", "left")
    return x.select("symbol", F.when(F.col("up"), "copied").when(F.col("low"), "copied_lower").otherwise("missing").alias("status"))


def q_shards(spark, d):
    return ranking.shards(table(spark, d, "company_docs").select("file_name", "record_id"), ["file_name", "record_id"], 4)


def q_chunks(spark, d):
    return ranking.chunks(table(spark, d, "company_docs").select("file_name", "record_id"), ["file_name", "record_id"], 400)


def q_length_batches(spark, d):
    r = table(spark, d, "reasoning_responses").select("response_id", F.coalesce(F.length("prompt"), F.lit(0)).alias("n"))
    return ranking.chunks(r, ["n", "response_id"], 32)


def q_scan_status(spark, d):
    """Documents that have prices or an annual report, and those that have neither."""
    some = F.exists(F.array(*(F.coalesce(F.size(f"stock_data.{c}"), F.lit(0)) > 0 for c in bars.SERIES)), lambda x: x) | F.col("latest_10k").isNotNull()
    return table(spark, d, "company_docs").groupBy(F.when(some, "successful").otherwise("failed").alias("status")).count()


def q_checkpoint_grid(spark, d):
    """Symbols by checkpoint, every 90 days, for which there are bars in the year before."""
    b = bars.daily_bars(table(spark, d, "price_bars")).select("symbol", "d")
    # A day lies in the year before at most five checkpoints: they are counted, not joined.
    first = F.lit("2020-01-01").cast("date")
    near = F.filter(F.transform(F.sequence(F.lit(0), F.lit(24)), lambda k: F.date_add(first, k * 90)), lambda t: (t > F.col("d")) & (t <= F.date_add(F.col("d"), 365)))
    return b.select("symbol", F.explode(near).alias("t")).groupBy("t", "symbol").agg(F.count("*").alias("n_bars"))


def q_company_document(spark, d):
    """Documents put together from bars, filings and news; a missing part is empty and drops nothing."""
    keys = _keys(spark, d)
    series = bars.last_values(bars.daily_bars(table(spark, d, "price_bars")), keys)
    sets = filings.filing_sets(keys, filings.distinct_filings(table(spark, d, "filings")).where("symbol is not null"))
    a = _articles(spark, d).where("symbol is not null").withColumn("day", F.col("publish_date").try_cast("date")).where("day is not null")
    near = keys.join(a, "symbol").where("day >= date_sub(t, 365) and day <= t")
    recent = news.newest(near.withColumn("k", F.concat_ws("|", "symbol", "t")), "k", "publish_date", "article_id", 20).groupBy("symbol", "t").agg(F.count("*").alias("n_news"))
    names = keep_last(table(spark, d, "company_registry").where("ticker is not null").select(tickers.market_symbol(F.col("ticker")).alias("symbol"), "title", (-F.col("cik_str")).alias("o")), ["symbol"], ["o"])
    x = keys.join(series, ["symbol", "t"], "left").join(sets, ["symbol", "t"], "left").join(recent, ["symbol", "t"], "left").join(names, "symbol", "left")
    return x.select("symbol", "t", F.col("title").alias("company_name"), F.size("close").alias("n_close"), F.size("volume").alias("n_volume"), "k_accession", "q_accession", F.size("eight_k").alias("n_eight_k"), F.coalesce("n_news", F.lit(0)).alias("n_news"))


def _words_of(c: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+'))"


_TITLED = f"titled AS (SELECT article_id, title, url, publish_date, points, num_comments, {_words_of('title')} AS words FROM hacker_news_articles WHERE title IS NOT NULL)"


def _cascade_sql(wanted: int) -> str:
    """The widening searches tier by tier: ``u`` holds what is picked so far."""
    named = ", ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(INDUSTRIES)).replace(", WHEN", " WHEN")
    modifiers = ", ".join(f"'{m}'" for m in news.MODIFIERS)
    ctes = [
        _TITLED,
        f"named AS (SELECT cik_str, {_SYM} AS key, {_simplified('title')} AS name FROM company_registry WHERE ticker IS NOT NULL AND title IS NOT NULL)",
        "one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY cik_str) AS rn FROM named) WHERE rn = 1)",
        "four AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik_str % 40 ORDER BY cik_str, name) AS k FROM one) WHERE k <= 4)",
        "rivals AS (SELECT o.key, f.name, row_number() OVER (PARTITION BY o.key ORDER BY f.k) AS k FROM one o JOIN four f ON o.cik_str % 40 = f.cik_str % 40 AND o.cik_str <> f.cik_str)",
        f"ind AS (SELECT key, name, CASE cik_str % {len(INDUSTRIES)} {named} END AS industry FROM one)",
        f"kw AS (SELECT *, list_filter(string_split(industry, ' '), lambda w: lower(w) NOT IN ({modifiers})) AS ws, least((SELECT count(*) FROM rivals r WHERE r.key = ind.key), {news.COMPETITORS}) AS n_rivals FROM ind)",
        f"""asked AS (SELECT key, 1 AS tier, name AS query FROM kw UNION ALL SELECT key, 2, key || ' ' || name FROM kw WHERE length(key) >= 3 UNION ALL SELECT key, 3, industry FROM kw
  UNION ALL SELECT key, 4, ws[len(ws)] FROM kw WHERE contains(industry, ' ') AND len(ws) > 0 AND ws[len(ws)] <> industry UNION ALL SELECT key, 4 + k, name FROM rivals WHERE k <= {news.COMPETITORS})""",
        f"qs AS (SELECT query, {_words_of('query')} AS ws FROM (SELECT DISTINCT query FROM asked))",
        f"""hits AS (SELECT query, article_id, url, {_ENGAGED} AS good, row_number() OVER (PARTITION BY query ORDER BY coalesce(publish_date, '') DESC, article_id DESC) AS rank FROM qs JOIN titled ON len(ws) > 0 AND list_has_all(words, ws) QUALIFY rank <= {wanted})""",
        "th AS (SELECT a.key, a.tier, h.* FROM asked a JOIN hits h ON a.query = h.query)",
        "u0 AS (SELECT key, 0 AS tier, CAST(0 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS article_id, '' AS url FROM kw WHERE false)",
    ]

    def step(k: int, tier: int, room: str, allowed: str) -> None:
        ctes.append(f"n{k} AS (SELECT kw.key, kw.n_rivals, (SELECT count(*) FROM u{k} WHERE u{k}.key = kw.key) AS n FROM kw)")
        ctes.append(f"v{k} AS (SELECT n{k}.key, {room} AS room FROM n{k} {allowed})")
        ctes.append(f"""u{k + 1} AS (SELECT * FROM u{k} UNION ALL SELECT key, tier, rank, article_id, url FROM (
  SELECT th.*, row_number() OVER (PARTITION BY th.key, th.url ORDER BY th.rank) AS first FROM th JOIN v{k} ON th.key = v{k}.key WHERE th.tier = {tier} AND th.rank <= v{k}.room AND good) x
  WHERE first = 1 AND NOT EXISTS (SELECT 1 FROM u{k} o WHERE o.key = x.key AND o.url = x.url))""")

    some, few, half = (share * wanted for share in news.WIDEN)
    step(0, 1, str(wanted), "")
    step(1, 2, f"{wanted} - n", f"WHERE n < {some}")
    step(2, 3, f"({wanted} - n) // 2", f"WHERE n < {few}")
    step(3, 4, f"({wanted} - m.n) // 2", f"JOIN n2 m ON n3.key = m.key WHERE m.n < {few} AND n3.n < {few}")
    for k in range(news.COMPETITORS):
        at = "n4" if k == 0 else "r"
        step(4 + k, 5 + k, f"({wanted} - {at}.n) // greatest({at}.n_rivals, 1)", f"JOIN n2 m ON n{4 + k}.key = m.key" + ("" if k == 0 else f" JOIN n4 r ON n{4 + k}.key = r.key") + f" WHERE m.n < {few} AND {at}.n < {half} AND n{4 + k}.n < {wanted}")
    last = 4 + news.COMPETITORS
    return f"WITH {', '.join(ctes)} SELECT key AS symbol, CAST(r AS INT) AS rank, tier, article_id, url FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tier, rank) AS r FROM u{last}) WHERE r <= {wanted}"


_BL = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_JB = r"[ \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_WORDS = rf"list_filter(regexp_split_to_array(text, '{_BL}+'), lambda w: w <> '')"


def _runs(c: str) -> str:
    return f"coalesce(len(regexp_extract_all({c}, '{_JB}')), 0)"


def _simplified(c: str) -> str:
    for p in tickers.SIMPLIFY:
        c = f"regexp_replace({c}, '{p}', '', 'i')"
    return f"trim({c})"


def _stripped(c: str) -> str:
    x = c
    for e in tickers.ENDINGS:
        x = f"regexp_replace({x}, '{e.replace('.', chr(92) + '.')}$', '')"
    return f"trim({x})"


_RESOLVED = "CASE WHEN upper(title) = title AND lower(title) <> title AND length(title) <= 5 THEN title " + " ".join(f"WHEN lower(title) = '{k}' THEN '{v}'" for k, v in tickers.ALIASES.items()) + " WHEN length(title) <= 5 THEN upper(title) ELSE title END"
_ENGAGED = "(coalesce(points, 0) > 0 OR coalesce(num_comments, 0) > 0) AND coalesce(url, '') <> '' AND coalesce(title, '') <> ''"
_SYM = "translate(upper(ticker), '_ .', '---')"
_ART = f"arts AS (SELECT article_id, {_SYM} AS symbol, title, url, publish_date, points, num_comments FROM hacker_news_articles WHERE {_ENGAGED})"
_TASKS = rf"""t0 AS (
  SELECT record_id, 'latest_10k' AS section, 0 AS report, i - 1 AS place, latest_10k.paragraphs[i] AS text FROM (SELECT *, unnest(generate_series(1, len(latest_10k.paragraphs))) AS i FROM company_docs)
  UNION ALL SELECT record_id, 'latest_10q', 0, i - 1, latest_10q.paragraphs[i] FROM (SELECT *, unnest(generate_series(1, len(latest_10q.paragraphs))) AS i FROM company_docs)
  UNION ALL SELECT record_id, 'eight_k_reports', r - 1, i - 1, x.paragraphs[i] FROM (SELECT record_id, r, x, unnest(generate_series(1, len(x.paragraphs))) AS i FROM (SELECT record_id, r, eight_k_reports[r] AS x FROM (SELECT record_id, eight_k_reports, unnest(generate_series(1, len(eight_k_reports))) AS r FROM company_docs)))
  UNION ALL SELECT record_id, 'hacker_news_articles', 0, i - 1, CASE WHEN len(w) > 4000 THEN array_to_string(w[1:4000], ' ') ELSE text END FROM (SELECT *, list_filter(regexp_split_to_array(text, '{_BL}+'), lambda q: q <> '') AS w FROM (SELECT record_id, i, hacker_news_articles[i].text AS text FROM (SELECT *, unnest(generate_series(1, len(hacker_news_articles))) AS i FROM company_docs)))),
tasks AS (SELECT record_id, section, CAST(report AS INT) AS report, CAST(place AS INT) AS place, text FROM t0 WHERE regexp_replace(text, '{_BL}+', '', 'g') <> '')"""
_META = ("filing_date", "filing_url", "accession_number", "form_type", "company_ticker", "cik", "primary_document")
_BUDGET = rf"""WITH para AS (
  SELECT record_id, 0 AS sec, 0 AS rep, i - 1 AS place, latest_10k.paragraphs[i] AS text FROM (SELECT *, unnest(generate_series(1, len(latest_10k.paragraphs))) AS i FROM company_docs)
  UNION ALL SELECT record_id, 1, 0, i - 1, latest_10q.paragraphs[i] FROM (SELECT *, unnest(generate_series(1, len(latest_10q.paragraphs))) AS i FROM company_docs)
  UNION ALL SELECT record_id, 2, r - 1, i - 1, x.paragraphs[i] FROM (SELECT record_id, r, x, unnest(generate_series(1, len(x.paragraphs))) AS i FROM (SELECT record_id, r, eight_k_reports[r] AS x FROM (SELECT record_id, eight_k_reports, unnest(generate_series(1, len(eight_k_reports))) AS r FROM company_docs)))),
sc AS (SELECT record_id, sec, rep, place, ((record_id * 31 + sec * 7 + place) % 5) - 1 AS score, {_runs('text')} AS cost FROM para WHERE text IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY record_id, sec, rep ORDER BY place) - 1 AS k FROM sc),
art AS (SELECT record_id, i - 1 AS place, a.score AS score, {_runs('a.text')} AS body, {' + '.join(_runs('a.' + c) for c in ('title', 'url', 'publish_date', 'text', 'scoring_method'))} AS whole FROM (SELECT record_id, i, hacker_news_articles[i] AS a FROM (SELECT *, unnest(generate_series(1, len(hacker_news_articles))) AS i FROM company_docs))),
meta AS (
  SELECT record_id, latest_10k.metadata AS m FROM company_docs UNION ALL SELECT record_id, latest_10q.metadata FROM company_docs
  UNION ALL SELECT record_id, x.metadata FROM (SELECT record_id, unnest(eight_k_reports) AS x FROM company_docs)),
total AS (
  SELECT c.record_id, 1 + {_runs('c.company_name')} + {_runs('c.ticker')} + {_runs('c.date_range.start')} + {_runs('c.date_range."end"')}
    + coalesce((SELECT sum(cost) FROM sc WHERE sc.record_id = c.record_id), 0) + coalesce((SELECT sum(whole) FROM art WHERE art.record_id = c.record_id), 0)
    + coalesce((SELECT sum({' + '.join(_runs('m.' + c) for c in _META)}) FROM meta WHERE meta.record_id = c.record_id), 0) AS total
  FROM company_docs c),
act AS (
  SELECT record_id, 0 AS lv, 0 AS sec, 0 AS rep, -place AS back, whole AS cost FROM art WHERE score = 0
  UNION ALL SELECT record_id, CASE WHEN score = 1 THEN 1 ELSE 3 END, 0, 0, place, body FROM art WHERE score IN (1, 2, 3)
  UNION ALL SELECT record_id, CASE WHEN score = 0 THEN 2 ELSE 3 + score END, sec, rep, -k, cost FROM ranked WHERE score BETWEEN 0 AND 9),
run AS (SELECT a.record_id, a.lv, a.sec, t.total, a.cost, t.total - coalesce(sum(a.cost) OVER (PARTITION BY a.record_id ORDER BY lv, sec, rep, back ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM act a JOIN total t ON a.record_id = t.record_id),
done AS (SELECT t.record_id, t.total, t.total - coalesce(sum(r.cost) FILTER (r.before > {LIMIT}), 0) AS final, count(*) FILTER (r.before > {LIMIT}) AS n_applied,
  count(*) FILTER (r.before > {LIMIT} AND lv = 0) AS news, count(*) FILTER (r.before > {LIMIT} AND (lv = 2 OR lv > 3) AND sec = 0) AS s0, count(*) FILTER (r.before > {LIMIT} AND (lv = 2 OR lv > 3) AND sec = 1) AS s1
  FROM total t LEFT JOIN run r ON t.record_id = r.record_id GROUP BY t.record_id, t.total)"""

SQL = {
    "q_paragraphs": rf"""WITH RECURSIVE raw AS (SELECT doc_id, list_filter([regexp_replace(p, '^{_BL}+|{_BL}+$', '', 'g') FOR p IN regexp_split_to_array(text, '\n\n+')], lambda x: x <> '') AS ps FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, ps, 0 AS i, CAST([] AS VARCHAR[]) AS done, '' AS open FROM raw
  UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN n >= 20 THEN list_append(done, g) ELSE done END, CASE WHEN n >= 20 THEN '' ELSE g END
  FROM (SELECT *, len(list_filter(regexp_split_to_array(g, '{_BL}+'), lambda w: w <> '')) AS n FROM (SELECT *, CASE WHEN open = '' THEN ps[i + 1] ELSE open || chr(10) || chr(10) || ps[i + 1] END AS g FROM f WHERE i < len(ps)))),
o AS (SELECT doc_id, CASE WHEN open = '' THEN done ELSE list_append(done, open) END AS out FROM f WHERE i = len(ps))
SELECT doc_id, CAST(k - 1 AS INT) AS pos, out[k] AS paragraph FROM (SELECT doc_id, out, unnest(generate_series(1, len(out))) AS k FROM o)""",
    "q_truncate_words": f"SELECT doc_id, CASE WHEN len({_WORDS}) > 50 THEN array_to_string({_WORDS}[1:50], ' ') ELSE text END AS head FROM documents",
    "q_word_count": f"SELECT doc_kind, CAST(sum(coalesce(len({_WORDS}), 0)) AS BIGINT) AS n_words FROM documents GROUP BY doc_kind",
    "q_names": f"SELECT cik_str, {_simplified('title')} AS simple, {_stripped('title')} AS stripped, {_RESOLVED} AS resolved FROM company_registry",
    "q_ticker_norm": f"SELECT DISTINCT ticker, {_SYM} AS market, translate(upper(ticker), './', '--') AS registry, translate(ticker, './', '__') AS file FROM price_bars",
    "q_filename_parse": r"SELECT record_id, CASE WHEN regexp_matches(file_name, '\d{8}') THEN regexp_replace(regexp_extract(file_name, '^(.*?)\d{8}', 1), '_+$', '') END AS symbol, nullif(regexp_extract(file_name, '(\d{8})', 1), '') AS day, split_part(regexp_replace(file_name, '\.json$', ''), '_data_run_', 1) AS run_group FROM company_docs",
    "q_volume_humanized": f"WITH {BARS} SELECT symbol, CASE WHEN sum(volume) IS NULL THEN 'N/A' ELSE CAST(CAST(sum(volume) / 1e9 AS DECIMAL(18,2)) AS VARCHAR) || 'B' END AS volume FROM bars GROUP BY symbol",
    "q_task_explode": f"WITH {_TASKS} SELECT * FROM tasks",
    "q_regroup": f"WITH {_TASKS} SELECT record_id, section, report, CAST(count(*) AS INT) AS n, string_agg(CASE WHEN place % 4 = 3 THEN '-1' ELSE coalesce(nullif(regexp_extract(text, '([0-3])', 1), ''), '-1') END, ',' ORDER BY place) AS scores, md5(string_agg(text, '|' ORDER BY place)) AS texts FROM tasks GROUP BY record_id, section, report",
    "q_budget_filter": f"{_BUDGET} SELECT record_id, CAST(total AS INT) AS total, CAST(final AS INT) AS final, CAST(n_applied AS INT) AS n_applied, final > {LIMIT} AS minimal FROM done",
    "q_budget_documents": f"""{_BUDGET} SELECT d.record_id, CAST(final AS INT) AS total, CAST((SELECT count(*) FROM sc WHERE sc.record_id = d.record_id AND sec = 0) - s0 AS INT) AS n_latest_10k,
  CAST((SELECT count(*) FROM sc WHERE sc.record_id = d.record_id AND sec = 1) - s1 AS INT) AS n_latest_10q, CAST(len(list_filter(coalesce(c.hacker_news_articles, []), lambda a: a IS NOT NULL)) - news AS INT) AS n_articles
FROM done d JOIN company_docs c ON d.record_id = c.record_id WHERE final <= {LIMIT}""",
    "q_html_clean": "SELECT filing_id, '" + "\n".join(SHAPES_READ) + "' || chr(10) || chr(10) || body AS body FROM (" + r"""SELECT filing_id, trim('CIK | $' || CASE WHEN coalesce(cik, '') = '' THEN ' | %' ELSE ' ' || cik || '%' END || chr(10) || chr(10) ||
  coalesce(array_to_string(list_filter([regexp_replace(regexp_replace(p, ' +', ' ', 'g'), ' +$', '') FOR p IN paragraphs], lambda x: regexp_replace(x, '\s+', '', 'g') <> ''), chr(10) || chr(10)), ''), ' ' || chr(10) || chr(9)) AS body FROM filings""" + ")",
    "q_finalize": r"""SELECT record_id, md5(CASE WHEN latest_10k IS NOT NULL AND latest_10k.paragraphs IS NOT NULL THEN coalesce(array_to_string(list_filter(latest_10k.paragraphs, lambda p: p IS NOT NULL), chr(10) || chr(10)), '') END) AS r10k,
  md5(CASE WHEN latest_10q IS NOT NULL AND latest_10q.paragraphs IS NOT NULL THEN coalesce(array_to_string(list_filter(latest_10q.paragraphs, lambda p: p IS NOT NULL), chr(10) || chr(10)), '') END) AS r10q,
  CASE WHEN eight_k_reports IS NOT NULL THEN coalesce(array_to_string([md5(CASE WHEN r.paragraphs IS NOT NULL THEN coalesce(array_to_string(list_filter(r.paragraphs, lambda p: p IS NOT NULL), chr(10) || chr(10)), '') END) FOR r IN eight_k_reports], ','), '') END AS r8k,
  CASE WHEN stock_data.close IS NOT NULL THEN coalesce(array_to_string([CAST(CAST(round(v, 2) AS DECIMAL(18,2)) AS VARCHAR) FOR v IN stock_data.close], ','), '') END AS closes FROM company_docs""",
    "q_engaged_news": f"WITH {_ART} SELECT article_id, symbol, points, num_comments FROM arts",
    "q_dedup_keep_first": f"WITH {_ART} SELECT min(article_id) AS article_id, url, min_by(title, article_id) AS title FROM arts GROUP BY url",
    "q_dedup_keep_last": "SELECT url, article_id, score FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ingested_at DESC NULLS LAST, article_id DESC) AS rn FROM hacker_news_articles WHERE url IS NOT NULL) WHERE rn = 1",
    "q_topk_news": f"WITH {_ART}, f AS (SELECT symbol, url, min(article_id) AS article_id, min_by(publish_date, article_id) AS publish_date FROM arts WHERE symbol IS NOT NULL GROUP BY symbol, url) SELECT symbol, article_id, publish_date FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY coalesce(publish_date, '') DESC, article_id DESC) AS rn FROM f) WHERE rn <= 20",
    "q_news_search": f"""WITH {_TITLED}, q AS (SELECT query_id, {_words_of('query')} AS asked FROM (VALUES {', '.join(f"({k}, '{v}')" for k, v in SEARCHES.items())}) v(query_id, query)),
f AS (SELECT query_id, article_id, publish_date, title, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(publish_date, '') DESC, article_id DESC) AS rank FROM q JOIN titled ON list_has_all(words, asked) WHERE publish_date >= '2021-01-01' AND publish_date <= '2023-12-31')
SELECT query_id, CAST(rank AS INT) AS rank, article_id, publish_date, title FROM f WHERE rank <= 50""",
    "q_news_cascade": _cascade_sql(10),
    "q_group_mode": "SELECT site, ticker FROM (SELECT site, ticker, row_number() OVER (PARTITION BY site ORDER BY n DESC, f) AS rn FROM (SELECT site, ticker, count(*) AS n, min(article_id) AS f FROM hacker_news_articles WHERE ticker IS NOT NULL GROUP BY site, ticker)) WHERE rn = 1",
    "q_anti_resume": "SELECT record_id, file_name FROM company_docs c WHERE NOT EXISTS (SELECT 1 FROM raw_company_docs r WHERE r.file_name = c.file_name)",
    "q_symbol_counts": "SELECT ticker, count(*) AS n, CAST(grouping(ticker) AS INT) AS is_total FROM price_bars GROUP BY ROLLUP (ticker)",
    "q_copy_report": "SELECT DISTINCT upper(ticker) AS symbol, CASE WHEN EXISTS (SELECT 1 FROM price_bars b WHERE b.ticker = upper(r.ticker)) THEN 'copied' WHEN EXISTS (SELECT 1 FROM price_bars b WHERE b.ticker = lower(r.ticker)) THEN 'copied_lower' ELSE 'missing' END AS status FROM company_registry r WHERE ticker IS NOT NULL",
    "q_shards": "SELECT file_name, record_id, CAST((row_number() OVER (ORDER BY file_name NULLS FIRST, record_id) - 1) % 4 AS INT) AS shard FROM company_docs",
    "q_chunks": "SELECT file_name, record_id, (row_number() OVER (ORDER BY file_name NULLS FIRST, record_id) - 1) // 400 AS chunk FROM company_docs",
    "q_length_batches": "SELECT response_id, CAST(coalesce(length(prompt), 0) AS INT) AS n, (row_number() OVER (ORDER BY coalesce(length(prompt), 0), response_id) - 1) // 32 AS chunk FROM reasoning_responses",
    "q_scan_status": "SELECT CASE WHEN greatest(" + ", ".join(f"coalesce(len(stock_data.{c}), 0)" for c in bars.SERIES) + ") > 0 OR latest_10k IS NOT NULL THEN 'successful' ELSE 'failed' END AS status, count(*) AS count FROM company_docs GROUP BY 1",
    "q_checkpoint_grid": f"WITH {BARS}, g AS (SELECT CAST(t AS DATE) AS t FROM (SELECT unnest(generate_series(DATE '2020-01-01', DATE '2025-12-31', INTERVAL 90 DAY)) AS t)) SELECT g.t, symbol, count(*) AS n_bars FROM g JOIN bars ON d < g.t AND d >= g.t - 365 GROUP BY g.t, symbol",
    "q_company_document": f"""WITH {_STATEMENTS}, {KEYS}, {BARS}, {_ART},
a AS (SELECT keys.symbol, keys.t, k.k_date, k.k_accession FROM keys ASOF LEFT JOIN k ON keys.symbol = k.symbol AND keys.t > k.k_date),
b AS (SELECT a.*, CASE WHEN k_date IS NULL OR q.q_date > k_date THEN q.q_date END AS q_date, CASE WHEN k_date IS NULL OR q.q_date > k_date THEN q.q_accession END AS q_accession FROM a ASOF LEFT JOIN q ON a.symbol = q.symbol AND a.t > q.q_date),
c AS (SELECT keys.symbol, keys.t, least(count(x.close), 256) AS n_close, least(count(x.volume), 256) AS n_volume FROM keys LEFT JOIN bars x ON keys.symbol = x.symbol AND x.d >= keys.t - 365 AND x.d < keys.t GROUP BY keys.symbol, keys.t),
eights AS (SELECT b.symbol, b.t, count(*) AS n FROM b JOIN filed f ON b.symbol = f.symbol AND f.form = '8-K' AND f.filed < b.t AND f.filed > coalesce(b.q_date, b.k_date) WHERE b.k_date IS NOT NULL GROUP BY b.symbol, b.t),
w AS (SELECT keys.symbol, keys.t, count(*) AS n FROM keys JOIN arts n ON keys.symbol = n.symbol AND TRY_CAST(n.publish_date AS DATE) BETWEEN keys.t - 365 AND keys.t GROUP BY keys.symbol, keys.t),
r AS (SELECT {_SYM} AS symbol, min_by(title, cik_str) AS title FROM company_registry WHERE ticker IS NOT NULL GROUP BY 1)
SELECT b.symbol, b.t, r.title AS company_name, CAST(n_close AS INT) AS n_close, CAST(n_volume AS INT) AS n_volume, k_accession, q_accession, CAST(least(coalesce(e.n, 0), 10) AS INT) AS n_eight_k, least(coalesce(w.n, 0), 20) AS n_news
FROM b JOIN c ON b.symbol = c.symbol AND b.t = c.t LEFT JOIN eights e ON b.symbol = e.symbol AND b.t = e.t LEFT JOIN w ON b.symbol = w.symbol AND b.t = w.t LEFT JOIN r ON b.symbol = r.symbol""",
}
QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}
