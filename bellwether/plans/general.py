"""Queries of the general data-preparation operators: implausible readings (p6), nested records (p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bellwether.operators.nested import ARTICLE_FIELDS, BAR_FIELDS, flatten_documents
from bellwether.operators.spikes import flag_readings, long_series, normal_moves
from bellwether.session import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return flag_readings(table(spark, d, "company_docs")).where("kind is not null").select("record_id", "series", "pos", "kind")


def p6_states(spark: SparkSession, d: str) -> DataFrame:
    """Readings that the model flags, with its state and probability, whether a rule names them or not."""
    return flag_readings(table(spark, d, "company_docs")).select("record_id", "series", "pos", "state", F.round("p_abnormal", 3).alias("p_abnormal"), F.col("kind").isNotNull().alias("ruled"))


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    """Flagged readings of each source, by kind."""
    docs = table(spark, d, "company_docs")
    flags = flag_readings(docs).where("kind is not null").join(docs.select("record_id", "ticker"), "record_id")
    return flags.groupBy("ticker", "kind").agg(F.count("*").alias("n_readings"))


def p6_normal_moves(spark: SparkSession, d: str) -> DataFrame:
    return normal_moves(long_series(table(spark, d, "company_docs"))).select("ticker", F.round("scale", 9).alias("scale"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return flatten_documents(table(spark, d, "raw_company_docs")).select("raw_id", "child_kind", "parent_pos", "child_pos")


def p7_bars(spark: SparkSession, d: str) -> DataFrame:
    return flatten_documents(table(spark, d, "raw_company_docs"), ("bar",)).select("raw_id", F.col("child_pos").alias("pos"), "open", "high", "low", "close", "volume")


def p7_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    rows = flatten_documents(table(spark, d, "raw_company_docs"), ("tenk_paragraph", "eight_k_paragraph"))
    return rows.select("raw_id", "child_kind", "parent_pos", "child_pos", "text", "score")


def p7_articles(spark: SparkSession, d: str) -> DataFrame:
    rows = flatten_documents(table(spark, d, "raw_company_docs"), ("article",))
    return rows.select("raw_id", F.col("child_pos").alias("pos"), "title", "url", "publish_date", "text", "score", "scoring_method")


#: The readings of all series in rows, with the normal move of each ticker.
_P6 = """
WITH long AS (
  SELECT record_id, ticker, 'stock_data' AS series, stock_data AS s FROM company_docs WHERE stock_data IS NOT NULL
  UNION ALL SELECT record_id, ticker, 'future_stock_data', future_stock_data FROM company_docs WHERE future_stock_data IS NOT NULL),
p AS (
  SELECT record_id, ticker, series, i - 1 AS pos, s.open[i] AS o, s.high[i] AS h, s.low[i] AS l, s.close[i] AS c, s.volume[i] AS v
  FROM (SELECT *, unnest(generate_series(1, greatest(coalesce(len(s.open), 0), coalesce(len(s.high), 0), coalesce(len(s.low), 0), coalesce(len(s.close), 0), coalesce(len(s.volume), 0)))) AS i FROM long)),
m AS (
  SELECT ticker, median(abs(c / pc - 1)) AS scale
  FROM (SELECT ticker, c, lag(c) OVER (PARTITION BY record_id, series ORDER BY pos) AS pc FROM p)
  WHERE pc <> 0 AND c IS NOT NULL AND ticker IS NOT NULL GROUP BY ticker)
"""
_P6_FOUND = (
    _P6
    + """, g AS (
  SELECT *, CASE WHEN c = lag(c) OVER w THEN 0 ELSE 1 END AS nc, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS nv,
    lag(o) OVER w AS o0, lead(o) OVER w AS o2, lag(h) OVER w AS h0, lead(h) OVER w AS h2,
    lag(l) OVER w AS l0, lead(l) OVER w AS l2, lag(c) OVER w AS c0, lead(c) OVER w AS c2
  FROM p LEFT JOIN m USING (ticker) WINDOW w AS (PARTITION BY record_id, series ORDER BY pos)),
r AS (SELECT *, sum(nc) OVER w AS gc, sum(nv) OVER w AS gv FROM g WINDOW w AS (PARTITION BY record_id, series ORDER BY pos)),
q AS (
  SELECT *, CASE WHEN c IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY record_id, series, gc) END AS rc,
    CASE WHEN v IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY record_id, series, gv) END AS rv FROM r),
found AS (
  SELECT record_id, ticker, series, CAST(pos AS BIGINT) AS pos, CASE
    WHEN o <= 0 OR h <= 0 OR l <= 0 OR c <= 0 OR v < 0 OR h < l OR o > h OR o < l OR c > h OR c < l THEN 'impossible'
    WHEN rc >= 6 OR rv >= 6 THEN 'stuck'
"""
    + "    WHEN "
    + " OR ".join(f"({x}0 > 0 AND {x}2 > 0 AND (({x} > {x}0 AND {x} > {x}2) OR ({x} < {x}0 AND {x} < {x}2)) AND abs({x} / {x}0 - 1) > 8 * scale AND abs({x} / {x}2 - 1) > 8 * scale)" for x in "ohlc")
    + " THEN 'spike' END AS kind FROM q)\n"
)



def _opened(x: str) -> str:
    """JSON, or what it holds if it is JSON text in a string."""
    inner = f"json_extract_string({x}, '$')"
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid({inner}) AND json_type({inner}) IN ('OBJECT', 'ARRAY') THEN CAST({inner} AS JSON) ELSE {x} END"


def _elements(x: str) -> str:
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN json_extract({x}, '$[*]') WHEN 'OBJECT' THEN [{x}] ELSE [] END"


_LENGTHS = ", ".join(f"coalesce(json_array_length(json_extract(sd, '$.{c}')), 0)" for c in ("open", "high", "low", "close", "volume"))
_REPORTED = "(json_extract(r, '$.paragraphs') IS NULL OR json_type(json_extract(r, '$.paragraphs')) = 'NULL') AND json_extract(r, '$.report') IS NOT NULL AND json_type(json_extract(r, '$.report')) <> 'NULL'"
_P7 = f"""
WITH d0 AS (SELECT raw_id, CAST(payload AS JSON) AS j FROM raw_company_docs WHERE json_valid(payload)),
d AS (SELECT raw_id, j FROM (SELECT raw_id, {_opened('j')} AS j FROM d0) WHERE json_type(j) = 'OBJECT'),
n AS (SELECT raw_id, {_opened('s')} AS sd, {_opened('k')} AS tenk, {_opened('e')} AS eight, {_opened('a')} AS arts FROM (
  SELECT raw_id, coalesce(json_extract(j, '$.stock_data'), json_extract(j, '$.past_stock_data')) AS s, json_extract(j, '$.latest_10k') AS k, json_extract(j, '$.eight_k_reports') AS e, json_extract(j, '$.hacker_news_articles') AS a FROM d)),
bars AS (SELECT raw_id, 'bar' AS child_kind, 0 AS parent_pos, unnest(generate_series(1, CAST(greatest({_LENGTHS}) AS BIGINT))) - 1 AS child_pos FROM n WHERE json_type(sd) = 'OBJECT'),
reports AS (
  SELECT raw_id, 'tenk_paragraph' AS kind, 0 AS pos, tenk AS r FROM n WHERE json_type(tenk) = 'OBJECT'
  UNION ALL SELECT raw_id, 'eight_k_paragraph', i - 1, {_opened('l[i]')} FROM (SELECT raw_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT raw_id, {_elements('eight')} AS l FROM n))),
lists AS (SELECT raw_id, kind, pos, {_REPORTED} AS whole, {_opened("json_extract(r, '$.paragraphs')")} AS ps FROM reports WHERE json_type(r) = 'OBJECT'),
paras AS (
  SELECT raw_id, kind, pos, 0 AS place FROM lists WHERE whole
  UNION ALL SELECT raw_id, kind, pos, i - 1 FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM (SELECT *, {_elements('ps')} AS l FROM lists WHERE NOT whole)) WHERE json_type(l[i]) <> 'NULL'),
arts AS (SELECT raw_id, i - 1 AS pos FROM (SELECT raw_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT raw_id, {_elements('arts')} AS l FROM n)) WHERE json_type(l[i]) <> 'NULL')
SELECT raw_id, child_kind, CAST(parent_pos AS BIGINT) AS parent_pos, CAST(child_pos AS BIGINT) AS child_pos FROM (
  SELECT * FROM bars UNION ALL SELECT raw_id, kind, pos, place FROM paras UNION ALL SELECT raw_id, 'article', 0, pos FROM arts
  UNION ALL SELECT raw_id, 'eight_k', 0, pos FROM reports WHERE kind = 'eight_k_paragraph' AND json_type(r) <> 'NULL')"""

def _text_of(x: str) -> str:
    return f"CASE json_type({x}) WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN json_extract_string({x}, '$') ELSE CAST({x} AS VARCHAR) END"


def _whole_of(x: str) -> str:
    return f"CASE WHEN regexp_full_match({_text_of(x)}, '-?[0-9]+') THEN TRY_CAST({_text_of(x)} AS BIGINT) END"


def _reading(c: str) -> str:
    series = _opened(f"json_extract(sd, '$.{c}')")
    return f"TRY_CAST(json_extract_string({series}, '$[' || pos || ']') AS DOUBLE) AS {c}"


#: The nodes of ``_P7`` up to the lists of reports.
_P7_NODES = _P7[: _P7.index("lists AS (")].rstrip()
_P7_BARS = f"{_P7_NODES} u AS (SELECT n.raw_id, sd, CAST(b.child_pos AS BIGINT) AS pos FROM bars b JOIN n ON b.raw_id = n.raw_id) SELECT raw_id, pos, {', '.join(map(_reading, BAR_FIELDS))} FROM u"
_P7_PARAGRAPHS = f"""{_P7_NODES}
lists AS (SELECT raw_id, kind, pos, {_REPORTED} AS whole, json_extract(r, '$.report') AS rep, {_opened("json_extract(r, '$.paragraphs')")} AS ps FROM reports WHERE json_type(r) = 'OBJECT'),
each AS (
  SELECT raw_id, kind, pos, 0 AS place, rep AS p FROM lists WHERE whole
  UNION ALL SELECT raw_id, kind, pos, i - 1, l[i] FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM (SELECT *, {_elements('ps')} AS l FROM lists WHERE NOT whole)) WHERE json_type(l[i]) <> 'NULL'),
opened AS (SELECT *, {_opened('p')} AS q FROM each)
SELECT raw_id, kind AS child_kind, CAST(pos AS BIGINT) AS parent_pos, CAST(place AS BIGINT) AS child_pos,
  CASE WHEN json_type(q) = 'OBJECT' THEN {_text_of("json_extract(q, '$.text')")} ELSE {_text_of('p')} END AS text, CASE WHEN json_type(q) = 'OBJECT' THEN {_whole_of("json_extract(q, '$.score')")} END AS score
FROM opened"""
_ARTICLE_TEXTS = ", ".join(_text_of(f"json_extract(q, '$.{c}')") + f" AS {c}" for c in ARTICLE_FIELDS)
_P7_ARTICLES = f"""{_P7_NODES}
a AS (SELECT raw_id, i - 1 AS pos, {_opened('l[i]')} AS q FROM (SELECT raw_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT raw_id, {_elements('arts')} AS l FROM n)) WHERE json_type(l[i]) <> 'NULL')
SELECT raw_id, CAST(pos AS BIGINT) AS pos, {_ARTICLE_TEXTS}, {_whole_of("json_extract(q, '$.score')")} AS score FROM a WHERE json_type(q) = 'OBJECT'"""

QUERIES = {f.__name__: f for f in (p6_found, p6_states, p6_rates, p6_normal_moves, p7_found, p7_bars, p7_paragraphs, p7_articles)}
SQL = {
    "p7_found": _P7,
    "p7_bars": _P7_BARS,
    "p7_paragraphs": _P7_PARAGRAPHS,
    "p7_articles": _P7_ARTICLES,
    "p6_found": _P6_FOUND + "SELECT record_id, series, pos, kind FROM found WHERE kind IS NOT NULL",
    "p6_rates": _P6_FOUND + "SELECT ticker, kind, count(*) AS n_readings FROM found WHERE kind IS NOT NULL GROUP BY ticker, kind",
    "p6_normal_moves": _P6 + "SELECT ticker, round(scale, 9) AS scale FROM m",
}
