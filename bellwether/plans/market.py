"""Queries over price bars, filings, news and membership, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bellwether.functions import tickers, text
from bellwether.operators import asof, bars, filings, universe
from bellwether.session import table


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return bars.daily_bars(table(spark, d, "price_bars"))


def _keys(spark: SparkSession, d: str) -> DataFrame:
    """The distinct (symbol, t) of the company documents."""
    docs = table(spark, d, "company_docs")
    return docs.select(tickers.market_symbol(F.col("ticker")).alias("symbol"), F.col("date_range.end").try_cast("date").alias("t")).where("symbol is not null and t is not null").distinct()


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """The distinct (symbol, t) that models were asked about."""
    asked = table(spark, d, "reasoning_responses")
    return asked.select(tickers.market_symbol(F.col("ticker")).alias("symbol"), F.col("as_of").alias("t")).where("symbol is not null and t is not null").distinct()


def _news(spark: SparkSession, d: str) -> DataFrame:
    """The last article of each symbol and day."""
    a = table(spark, d, "hacker_news_articles").select(tickers.market_symbol(F.col("ticker")).alias("symbol"), F.col("publish_date").try_cast("date").alias("news_date"), F.col("article_id").alias("news_id"), F.col("title").alias("news_title"), F.col("points").alias("news_points"))
    return asof.keep_last(a.where("symbol is not null and news_date is not null"), ["symbol", "news_date"], ["news_id"])


def q_bars(spark, d):
    return _bars(spark, d)


def q_date_spine(spark, d):
    return bars.date_spine(spark, "2020-01-01", "2025-12-31", 90)


def q_bday_spine(spark, d):
    range_ = table(spark, d, "price_bars").agg(F.min("bar_date").alias("a"), F.max("bar_date").alias("b"))
    return range_.select(F.explode(bars.business_days(F.col("a"), F.col("b"))).alias("d"))


def q_delisted(spark, d):
    """Registered tickers without any bar."""
    seen = _bars(spark, d).select("symbol").distinct()
    return table(spark, d, "company_registry").select(tickers.market_symbol(F.col("ticker")).alias("symbol")).distinct().join(seen, "symbol", "left_anti")


def q_returns(spark, d):
    w = bars.by_symbol()
    b = _bars(spark, d).where("close is not null")
    return b.select("symbol", "d", (F.try_divide(F.col("close"), F.lag("close").over(w)) - 1).alias("ret"))


def q_last256(spark, d):
    out = bars.last_values(_bars(spark, d), _keys(spark, d))
    return out.select("symbol", "t", *(F.array_join(F.col(c).cast("array<decimal(18,4)>").cast("array<string>"), ",").alias(c) for c in ("open", "close", "volume")))


def q_future_window(spark, d):
    out = bars.following_values(_bars(spark, d), _keys(spark, d))
    return out.select("symbol", "t", *(F.array_join(F.col(c).cast("array<decimal(18,4)>").cast("array<string>"), ",").alias(c) for c in ("high", "low", "close")))


def q_minmax_series(spark, d):
    docs = table(spark, d, "company_docs").select("record_id", *(F.expr(f"coalesce(stock_data.{c}, array())").alias(c) for c in bars.SERIES))
    return bars.series_bounds(docs).select("record_id", *(f"{c}_{e}" for c in bars.SERIES for e in ("min", "max")))


def q_trailing31(spark, d):
    out = bars.trailing_closes(_bars(spark, d))
    return out.where("size(history) > 0").select("symbol", "d", F.size("history").alias("n"), F.element_at("history", 1).alias("oldest"), F.element_at("history", -1).alias("newest"))


def q_label_forward(spark, d):
    return bars.label_forward(_questions(spark, d), _bars(spark, d))


def q_label_backward(spark, d):
    return bars.label_backward(_questions(spark, d), _bars(spark, d))


def q_movement_target(spark, d):
    return bars.movement_targets(_bars(spark, d)).select("symbol", "d", "close", "target")


def q_asof_price_news(spark, d):
    return asof.asof_backward(_bars(spark, d).select("symbol", "d", "close"), _news(spark, d), "symbol", "d", "news_date")


def _statements(spark, d, form, prefix):
    f = filings.distinct_filings(table(spark, d, "filings")).where((F.col("form") == form) & F.col("filed").isNotNull() & F.col("symbol").isNotNull())
    return asof.keep_last(f.select("symbol", F.col("filed").alias(f"{prefix}_date"), F.col("accession").alias(f"{prefix}_accession")), ["symbol", f"{prefix}_date"], [f"{prefix}_accession"])


def _chain(spark, d):
    base = _statements(spark, d, "10-K", "k")
    met = asof.asof_backward(base, _statements(spark, d, "10-Q", "q"), "symbol", "k_date", "q_date")
    return asof.asof_backward(met, _statements(spark, d, "8-K", "e"), "symbol", "k_date", "e_date")


def q_asof_chain(spark, d):
    return _chain(spark, d)


def q_feature_table(spark, d):
    """Bars with the news and the chain of statements known by then, and the movement target, within dates."""
    b = bars.movement_targets(_bars(spark, d)).select("symbol", "d", "close", "target")
    met = asof.asof_backward(b, _news(spark, d), "symbol", "d", "news_date")
    met = asof.asof_backward(met, _chain(spark, d), "symbol", "d", "k_date")
    return met.where("d between DATE '2021-01-01' and DATE '2023-12-31'").drop("news_title", "news_points")


def q_universe_asof(spark, d):
    ev = table(spark, d, "events")
    who = F.col("user_id").cast("string")
    changes = ev.where("event_type in ('signup', 'error')").select(who.alias("ticker"), F.when(F.col("event_type") == "signup", "Added").otherwise("Removed").alias("kind"), F.col("ts").cast("date").alias("d"), F.col("event_id").alias("change_id"))
    current = ev.where("user_id % 3 <> 0").select(who.alias("ticker")).distinct()
    gone = ev.where("user_id % 17 = 0").select(who.alias("ticker")).distinct()
    dates = bars.date_spine(spark, "2023-12-31", "2024-01-30", 10)
    return universe.universe_asof(current, changes, dates, gone)


def q_filing_set(spark, d):
    f = filings.distinct_filings(table(spark, d, "filings")).where("symbol is not null")
    out = filings.filing_sets(_keys(spark, d), f)
    return out.withColumn("eight_k", F.array_join("eight_k", ","))


def q_filing_index(spark, d):
    """Each ticker's filings as an index of parallel arrays, and that index as rows again."""
    f = filings.distinct_filings(table(spark, d, "filings")).where("symbol is not null")
    rows = F.array_sort(F.collect_list(F.struct("accession", "form", "filed", "document")))
    index = f.groupBy("symbol").agg(rows.alias("r")).select("symbol", *(F.expr(f"transform(r, x -> x.{c})").alias(c) for c in ("form", "filed", "accession", "document")))
    zipped = index.select("symbol", F.explode(F.arrays_zip("form", "filed", "accession", "document")).alias("x"))
    return zipped.select("symbol", "x.*")


def q_cik_mode(spark, d):
    f = table(spark, d, "filings").select(tickers.registry_symbol(F.col("ticker")).alias("symbol"), tickers.pad_cik(F.col("cik")).alias("cik"), "filing_id")
    return filings.modal_value(f.where("symbol is not null"), "symbol", "cik", "filing_id")


def q_registry_lookup(spark, d):
    """Filings with the registered name of their ticker, raw or normalised; the least CIK wins."""
    reg = table(spark, d, "company_registry").where("ticker is not null").select(tickers.registry_symbol(F.col("ticker")).alias("symbol"), "cik_str", "title")
    one = asof.keep_last(reg.withColumn("o", -F.col("cik_str")), ["symbol"], ["o"]).drop("o")
    f = table(spark, d, "filings").select("filing_id", tickers.registry_symbol(F.col("ticker")).alias("symbol"))
    return f.join(one, "symbol", "left").select("filing_id", "symbol", tickers.pad_cik(F.col("cik_str").cast("string")).alias("cik"), "title")


def q_filing_urls(spark, d):
    f = table(spark, d, "filings").where("cik is not null and accession_number is not null and primary_document is not null")
    return f.select("filing_id", tickers.filing_url(F.col("cik"), F.col("accession_number"), F.col("primary_document")).alias("url"), text.host(F.col("filing_url")).alias("host"))


_SYM = "translate(upper(ticker), '_ .', '---')"
_REG = "translate(upper(ticker), './', '--')"
BARS = f"""bars AS (
  SELECT symbol, d, open, high, low, close, volume, split FROM (
    SELECT {_SYM} AS symbol, bar_date AS d, open_price AS open, high_price AS high, low_price AS low, close_price AS close, volume, coalesce(stock_splits, 0.0) AS split,
      row_number() OVER (PARTITION BY {_SYM}, bar_date ORDER BY fetched_at DESC NULLS LAST, bar_id DESC) AS rn
    FROM price_bars WHERE ticker IS NOT NULL AND bar_date IS NOT NULL) WHERE rn = 1)"""
KEYS = f"keys AS (SELECT DISTINCT {_SYM} AS symbol, TRY_CAST(date_range.\"end\" AS DATE) AS t FROM company_docs WHERE ticker IS NOT NULL AND TRY_CAST(date_range.\"end\" AS DATE) IS NOT NULL)"
ASKED = f"asked AS (SELECT DISTINCT {_SYM} AS symbol, as_of AS t FROM reasoning_responses WHERE ticker IS NOT NULL AND as_of IS NOT NULL)"
NEWS = f"""news AS (
  SELECT symbol, news_date, news_id, news_title, news_points FROM (
    SELECT {_SYM} AS symbol, TRY_CAST(publish_date AS DATE) AS news_date, article_id AS news_id, title AS news_title, points AS news_points,
      row_number() OVER (PARTITION BY {_SYM}, TRY_CAST(publish_date AS DATE) ORDER BY article_id DESC) AS rn
    FROM hacker_news_articles WHERE ticker IS NOT NULL AND TRY_CAST(publish_date AS DATE) IS NOT NULL) WHERE rn = 1)"""
FILED = f"""filed AS (
  SELECT symbol, accession, form, filed, document FROM (
    SELECT {_REG} AS symbol, accession_number AS accession, upper(form_type) AS form, filing_date AS filed, primary_document AS document,
      row_number() OVER (PARTITION BY accession_number ORDER BY ingested_at DESC NULLS LAST, filing_id DESC) AS rn
    FROM filings WHERE accession_number IS NOT NULL) WHERE rn = 1 AND symbol IS NOT NULL)"""


def _of(form: str, p: str) -> str:
    return f"{p} AS (SELECT symbol, filed AS {p}_date, max(accession) AS {p}_accession FROM filed WHERE form = '{form}' AND filed IS NOT NULL GROUP BY symbol, filed)"


_STATEMENTS = f"{FILED}, {_of('10-K', 'k')}, {_of('10-Q', 'q')}, {_of('8-K', 'e')}"
_CHAIN = """chain AS (
  SELECT k.symbol, k.k_date, k.k_accession, q.q_date, q.q_accession, e.e_date, e.e_accession
  FROM k ASOF LEFT JOIN q ON k.symbol = q.symbol AND k.k_date >= q.q_date ASOF LEFT JOIN e ON k.symbol = e.symbol AND k.k_date >= e.e_date)"""


def _joined(c: str, alias: str = "b") -> str:
    return f"coalesce(string_agg(CAST(CAST({alias}.{c} AS DECIMAL(18,4)) AS VARCHAR), ',' ORDER BY {alias}.d), '') AS {c}"


def _window(lo: str, hi: str, points: int, names: tuple[str, ...]) -> str:
    ranked = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN row_number() OVER (PARTITION BY symbol, t, {c} IS NULL ORDER BY d DESC) END AS r_{c}" for c in names)
    cols = ", ".join(f"coalesce(string_agg(CASE WHEN r_{c} <= {points} THEN CAST(CAST({c} AS DECIMAL(18,4)) AS VARCHAR) END, ',' ORDER BY d), '') AS {c}" for c in names)
    return f"WITH {BARS}, {KEYS}, j AS (SELECT keys.symbol, keys.t, b.d, {', '.join('b.' + c for c in names)} FROM keys LEFT JOIN bars b ON keys.symbol = b.symbol AND b.d >= {lo} AND b.d < {hi}), r AS (SELECT *, {ranked} FROM j) SELECT symbol, t, {cols} FROM r GROUP BY symbol, t"


SQL = {
    "q_bars": f"WITH {BARS} SELECT * FROM bars",
    "q_date_spine": "SELECT CAST(t AS DATE) AS t FROM (SELECT unnest(generate_series(DATE '2020-01-01', DATE '2025-12-31', INTERVAL 90 DAY)) AS t)",
    "q_bday_spine": "SELECT CAST(d AS DATE) AS d FROM (SELECT unnest(generate_series(min(bar_date), max(bar_date), INTERVAL 1 DAY)) AS d FROM price_bars) WHERE isodow(d) < 6",
    "q_delisted": f"WITH {BARS} SELECT DISTINCT {_SYM} AS symbol FROM company_registry WHERE {_SYM} IS NOT NULL EXCEPT SELECT symbol FROM bars",
    "q_returns": f"WITH {BARS} SELECT symbol, d, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY d), 0) - 1 AS ret FROM bars WHERE close IS NOT NULL",
    "q_last256": _window("t - 365", "t", 256, ("open", "close", "volume")),
    "q_future_window": _window("t + 1", "t + 90", 90, ("high", "low", "close")),
    "q_minmax_series": "SELECT record_id, " + ", ".join(f"CAST(coalesce(list_min(stock_data.{c}), 0) AS DOUBLE) AS {c}_min, CAST(coalesce(list_max(stock_data.{c}), 1) AS DOUBLE) AS {c}_max" for c in bars.SERIES) + " FROM company_docs",
    "q_trailing31": f"WITH {BARS}, h AS (SELECT symbol, d, list(close) FILTER (close IS NOT NULL) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 30 PRECEDING AND CURRENT ROW) AS h FROM bars) SELECT symbol, d, CAST(len(h) AS INT) AS n, h[1] AS oldest, h[-1] AS newest FROM h WHERE len(h) > 0",
    "q_label_forward": f"""WITH {BARS}, {ASKED}, r AS (
  SELECT a.symbol, a.t, b.d, b.close, row_number() OVER (PARTITION BY a.symbol, a.t ORDER BY b.d) AS rn FROM asked a JOIN bars b ON a.symbol = b.symbol AND b.d >= a.t AND b.d < a.t + 10)
SELECT x.symbol, x.t, x.d AS base_date, x.close AS base_close, y.d AS next_date, y.close AS next_close,
  CASE WHEN y.close = x.close THEN 0 WHEN y.close > x.close THEN 1 WHEN y.close < x.close THEN -1 END AS direction
FROM r x JOIN r y ON x.symbol = y.symbol AND x.t = y.t AND x.rn = 1 AND y.rn = 2""",
    "q_label_backward": f"""WITH {BARS}, {ASKED}, n AS (
  SELECT symbol, d AS base_date, close AS base_close, lead(d) OVER w AS next_date, lead(open) OVER w AS next_open, lead(close) OVER w AS next_close, lead(split) OVER w AS next_split
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d))
SELECT a.symbol, a.t, n.base_date, n.base_close, n.next_date, n.next_open, n.next_close,
  CASE WHEN abs((next_close - base_close) / base_close) <= 0.005 THEN 0 WHEN (next_close - base_close) / base_close > 0 THEN 1 WHEN (next_close - base_close) / base_close < 0 THEN -1 END AS direction
FROM asked a ASOF JOIN n ON a.symbol = n.symbol AND a.t >= n.base_date
WHERE n.base_date >= a.t - 40 AND n.next_date < a.t + 10 AND n.next_split = 0""",
    "q_movement_target": f"WITH {BARS} SELECT symbol, d, close, coalesce(CAST(lead(close) OVER (PARTITION BY symbol ORDER BY d) > close AS INT), 0) AS target FROM bars",
    "q_asof_price_news": f"WITH {BARS}, {NEWS} SELECT b.symbol, b.d, b.close, n.news_date, n.news_id, n.news_title, n.news_points FROM bars b ASOF LEFT JOIN news n ON b.symbol = n.symbol AND b.d >= n.news_date",
    "q_asof_chain": f"WITH {_STATEMENTS}, {_CHAIN} SELECT * FROM chain",
    "q_feature_table": f"""WITH {BARS}, {NEWS}, {_STATEMENTS}, {_CHAIN},
t AS (SELECT symbol, d, close, coalesce(CAST(lead(close) OVER (PARTITION BY symbol ORDER BY d) > close AS INT), 0) AS target FROM bars)
SELECT t.symbol, t.d, t.close, t.target, n.news_date, n.news_id, c.k_date, c.k_accession, c.q_date, c.q_accession, c.e_date, c.e_accession
FROM t ASOF LEFT JOIN news n ON t.symbol = n.symbol AND t.d >= n.news_date ASOF LEFT JOIN chain c ON t.symbol = c.symbol AND t.d >= c.k_date
WHERE t.d BETWEEN DATE '2021-01-01' AND DATE '2023-12-31'""",
    "q_universe_asof": """WITH changes AS (SELECT CAST(user_id AS VARCHAR) AS ticker, event_type AS kind, CAST(ts AS DATE) AS d, event_id FROM events WHERE event_type IN ('signup', 'error')),
dates AS (SELECT CAST(t AS DATE) AS t FROM (SELECT unnest(generate_series(DATE '2023-12-31', DATE '2024-01-30', INTERVAL 10 DAY)) AS t)),
f AS (SELECT t, ticker, kind FROM (SELECT dates.t, c.ticker, c.kind, row_number() OVER (PARTITION BY dates.t, c.ticker ORDER BY c.d, CASE WHEN c.kind = 'error' THEN 0 ELSE 1 END, c.event_id) AS rn FROM changes c JOIN dates ON c.d > dates.t) WHERE rn = 1),
cur AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS ticker FROM events WHERE user_id % 3 <> 0)
SELECT coalesce(m.t, f.t) AS t, coalesce(m.ticker, f.ticker) AS ticker FROM (SELECT dates.t, cur.ticker FROM cur, dates) m FULL JOIN f ON m.t = f.t AND m.ticker = f.ticker
WHERE (f.kind = 'error' OR f.kind IS NULL) AND CAST(coalesce(m.ticker, f.ticker) AS BIGINT) % 17 <> 0""",
    "q_filing_set": f"""WITH {_STATEMENTS}, {KEYS},
a AS (SELECT keys.symbol, keys.t, k.k_date, k.k_accession FROM keys ASOF LEFT JOIN k ON keys.symbol = k.symbol AND keys.t > k.k_date),
b AS (SELECT a.*, CASE WHEN k_date IS NULL OR q.q_date > k_date THEN q.q_date END AS q_date, CASE WHEN k_date IS NULL OR q.q_date > k_date THEN q.q_accession END AS q_accession FROM a ASOF LEFT JOIN q ON a.symbol = q.symbol AND a.t > q.q_date),
x AS (SELECT b.symbol, b.t, f.filed, f.accession, row_number() OVER (PARTITION BY b.symbol, b.t ORDER BY f.filed DESC, f.accession DESC) AS rn
  FROM b JOIN filed f ON b.symbol = f.symbol AND f.form = '8-K' AND f.filed < b.t AND f.filed > coalesce(b.q_date, b.k_date) WHERE b.k_date IS NOT NULL)
SELECT b.*, coalesce(e.eight_k, '') AS eight_k FROM b LEFT JOIN (SELECT symbol, t, string_agg(accession, ',' ORDER BY rn) AS eight_k FROM x WHERE rn <= 10 GROUP BY symbol, t) e ON b.symbol = e.symbol AND b.t = e.t""",
    "q_filing_index": f"WITH {FILED} SELECT symbol, form, filed, accession, document FROM filed",
    "q_cik_mode": f"""SELECT symbol, cik FROM (SELECT symbol, cik, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, first) AS rn FROM (
  SELECT {_REG} AS symbol, CASE WHEN length(cik) < 10 THEN lpad(cik, 10, '0') ELSE cik END AS cik, count(*) AS n, min(filing_id) AS first FROM filings WHERE cik IS NOT NULL AND ticker IS NOT NULL GROUP BY 1, 2)) WHERE rn = 1""",
    "q_registry_lookup": f"""SELECT f.filing_id, {_REG.replace('ticker', 'f.ticker')} AS symbol, CASE WHEN length(CAST(r.cik_str AS VARCHAR)) < 10 THEN lpad(CAST(r.cik_str AS VARCHAR), 10, '0') ELSE CAST(r.cik_str AS VARCHAR) END AS cik, r.title
FROM filings f LEFT JOIN (SELECT s, min(cik_str) AS cik_str, min_by(title, cik_str) AS title FROM (SELECT {_REG} AS s, * FROM company_registry WHERE ticker IS NOT NULL) GROUP BY s) r ON {_REG.replace('ticker', 'f.ticker')} = r.s""",
    "q_filing_urls": r"SELECT filing_id, 'https://filings.example/data/' || CAST(CAST(cik AS BIGINT) AS VARCHAR) || '/' || replace(accession_number, '-', '') || '/' || primary_document AS url, nullif(regexp_extract(filing_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1), '') AS host FROM filings WHERE cik IS NOT NULL AND accession_number IS NOT NULL AND primary_document IS NOT NULL",
}
QUERIES = {name: globals()[name] for name in SQL}
