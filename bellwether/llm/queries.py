"""Queries of the training-text operators.  Every query reads its whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bellwether.llm import encode, lines, lookalike, neardup, packing, pairs, residue, truncation
from bellwether.session import materialize, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, d, "company_docs"))


def _cut_texts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(all texts as source_table, row_id, source, text; those that are cut)."""
    articles = table(spark, d, "hacker_news_articles")
    news = articles.select(F.lit("hacker_news_articles").alias("source_table"), F.col("article_id").alias("row_id"), F.col("site").alias("source"), "text")
    no_article = residue.residue(articles).select(F.col("article_id").alias("row_id"))
    responses = table(spark, d, "reasoning_responses")
    answers = materialize(pairs.first_stage(responses, "reasoning_responses", "response_id", "prompt", "prompt_lang", ["chain_of_thought"]))
    prose = answers.where("prose is not null").join(responses.select(F.col("response_id").alias("row_id"), F.col("model").alias("source")), "row_id")
    texts = news.join(no_article, "row_id", "left_anti").unionByName(prose.select("source_table", "row_id", "source", F.col("prose").alias("text")))
    cut = truncation.truncated(texts, ["source_table", "row_id"], "text")
    broken = answers.where("defect = 'truncated'").select("source_table", "row_id")
    every = news.unionByName(responses.select(F.lit("reasoning_responses").alias("source_table"), F.col("response_id").alias("row_id"), F.col("model").alias("source"), F.col("chain_of_thought").alias("text")))
    return every, cut.unionByName(broken)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _cut_texts(spark, d)[1].select("source_table", "row_id")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    """The share of texts that are cut, by site and by model, of all texts that aren't blank."""
    texts, cut = _cut_texts(spark, d)
    return truncation.truncation_rates(texts.where("text is not null and trim(text) <> ''"), cut, ["source_table", "row_id"], ["source_table", "source"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defective_answers(table(spark, d, "reasoning_responses"), table(spark, d, "rl_pairs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "hacker_news_articles")).select("article_id")


def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "hacker_news_articles")).groupBy("reason").agg(F.count("*").alias("n_articles"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_lines(table(spark, d, "filings"))


def p5_lines(spark: SparkSession, d: str) -> DataFrame:
    """Repeated lines by ticker, with the clusters of filings and the dates they are found in."""
    found = lines.repeated_keys(table(spark, d, "filings"))
    return found.select(F.col("source").alias("ticker"), "key", F.col("n_documents").cast("bigint").alias("n_filings"), "n_clusters", "n_dates")


def p5_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of the lines that are boilerplate whatever is republished: found in at least five clusters
    of different filings, on at least three dates."""
    return lines.repeated_lines(table(spark, d, "filings"), min_clusters=5, min_dates=3)


def p5_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Each filing's paragraphs without the repeated ones."""
    cleaned = lines.without_repeated(table(spark, d, "filings"))
    return cleaned.select("filing_id", F.size("paragraphs").alias("n_paragraphs"), F.array_join("paragraphs", "\n\n").alias("text"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"))


def p9_contents(spark: SparkSession, d: str) -> DataFrame:
    """The contents of all containers of each budget."""
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "token_budgets"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full each container is."""
    return p9_contents(spark, d).groupBy("budget_id", "capacity", "container_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_parts"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_looks(table(spark, d, "documents"))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_classes(table(spark, d, "documents"))


def p10_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_texts(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_rates, p3_found, p4_found, p4_reasons, p5_found, p5_lines, p5_boilerplate, p5_cleaned, p8_ids, p9_contents, p9_fill, p10_found, p10_classes, p10_canonical)}

_LINES = r"""
WITH l AS (SELECT filing_id, ticker, filing_date, paragraphs, unnest(generate_series(1, len(paragraphs))) AS i FROM filings),
k AS (SELECT filing_id, ticker, filing_date, i, paragraphs[i] AS p, regexp_replace(trim(regexp_replace(lower(paragraphs[i]), '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')), '[0-9]+', '0', 'g') AS line FROM l),
often AS (SELECT ticker, line FROM k WHERE line <> '' AND ticker IS NOT NULL GROUP BY ticker, line HAVING count(DISTINCT filing_id) >= 5)
"""
_ELEMENTS = """
WITH paras AS (SELECT record_id, unnest(list_concat(coalesce(latest_10k.paragraphs, []), coalesce(latest_10q.paragraphs, []))) AS p FROM company_docs),
w AS (SELECT record_id, regexp_extract_all(lower(p), '[a-z0-9]+') AS w FROM paras WHERE p IS NOT NULL),
g AS (SELECT record_id, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN generate_series(1, len(w) - 2)]) AS e FROM w WHERE len(w) >= 3),
b AS (SELECT record_id, stock_data.close[i] AS c, stock_data.volume[i] AS v FROM (SELECT record_id, stock_data, unnest(generate_series(1, len(stock_data.volume))) AS i FROM company_docs)),
e AS (SELECT DISTINCT record_id, e FROM (SELECT * FROM g UNION ALL SELECT record_id, '=' || coalesce(CAST(c AS VARCHAR), '') || '|' || CAST(v AS VARCHAR) FROM b WHERE v IS NOT NULL)),
n AS (SELECT record_id, count(*) AS n FROM e GROUP BY record_id),
s AS (SELECT a.record_id AS a, b.record_id AS b, count(*) AS k FROM e a JOIN e b ON a.e = b.e AND a.record_id < b.record_id GROUP BY 1, 2)
SELECT a AS record_id_a, b AS record_id_b FROM s JOIN n x ON s.a = x.record_id JOIN n y ON s.b = y.record_id WHERE k >= 0.6 * (x.n + y.n - k) - 1e-9"""


def _same_form_sql(c: str) -> str:
    """The character table as SQL: ignorables, blanks, joined forms, then one character for another."""
    one, many = {}, {}
    for code in (*range(0x80, 0x530), *range(0x531, 0x58A), *range(0x13A0, 0x1400), *range(0x1E00, 0x2000), 0x2113, *range(0x2160, 0x2180), *range(0xA4D0, 0xA500), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFFEF)):
        form = lookalike.table_form(chr(code))
        if form != chr(code) and form:
            (one if len(form) == 1 else many)[chr(code)] = form
    c = rf"regexp_replace(regexp_replace({c}, '[\p{{Cf}}\x{{FE00}}-\x{{FE0F}}]', '', 'g'), '[\p{{Zs}}\t]', ' ', 'g')"
    for x, y in many.items():
        c = f"replace({c}, '{x}', '{y}')"
    quoted = lambda cs: "".join(cs).replace("'", "''")
    return f"nfc_normalize(translate(nfc_normalize({c}), '{quoted(one)}', '{quoted(one.values())}'))"


SQL = {
    "p1_found": _ELEMENTS,
    "p5_lines": _LINES
    + """, seq AS (SELECT filing_id, string_agg(CASE WHEN line <> '' THEN md5(line) ELSE '-' END, ',' ORDER BY i) AS seq FROM k GROUP BY filing_id)
SELECT k.ticker, md5(k.line) AS key, count(DISTINCT k.filing_id) AS n_filings, count(DISTINCT seq.seq) AS n_clusters, count(DISTINCT k.filing_date) AS n_dates
FROM k JOIN often USING (ticker, line) JOIN seq USING (filing_id) GROUP BY k.ticker, md5(k.line)""",
    "p5_boilerplate": _LINES
    + """, seq AS (SELECT filing_id, string_agg(CASE WHEN line <> '' THEN md5(line) ELSE '-' END, ',' ORDER BY i) AS seq FROM k GROUP BY filing_id),
plate AS (SELECT k.ticker, k.line FROM k JOIN often USING (ticker, line) JOIN seq USING (filing_id) GROUP BY k.ticker, k.line HAVING count(DISTINCT seq.seq) >= 5 AND count(DISTINCT k.filing_date) >= 3)
SELECT filing_id, CAST(i - 1 AS BIGINT) AS pos FROM k JOIN plate USING (ticker, line)""",
    "p10_found": f"WITH t AS (SELECT doc_id, text, {_same_form_sql('text')} AS k FROM documents WHERE text IS NOT NULL) SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM t a JOIN t b ON a.k = b.k AND a.text <> b.text AND a.doc_id < b.doc_id",
    "p10_classes": f"WITH t AS (SELECT doc_id, text, {_same_form_sql('text')} AS k FROM documents WHERE text IS NOT NULL), c AS (SELECT k, min(doc_id) AS class_id, count(DISTINCT text) AS n_spellings FROM t GROUP BY k) SELECT doc_id, class_id, n_spellings FROM t JOIN c ON t.k = c.k",
    "p5_found": _LINES + "SELECT filing_id, CAST(i - 1 AS BIGINT) AS pos FROM k JOIN often USING (ticker, line)",
    "p5_cleaned": _LINES
    + """SELECT f.filing_id, CASE WHEN f.paragraphs IS NOT NULL THEN CAST(coalesce(n, 0) AS INT) END AS n_paragraphs, CASE WHEN f.paragraphs IS NOT NULL THEN coalesce(c.text, '') END AS text FROM filings f LEFT JOIN (
  SELECT k.filing_id, count(*) AS n, string_agg(k.p, chr(10) || chr(10) ORDER BY k.i) AS text FROM k LEFT JOIN often o ON k.ticker = o.ticker AND k.line = o.line WHERE o.line IS NULL GROUP BY k.filing_id) c ON f.filing_id = c.filing_id""",
}
