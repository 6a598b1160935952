"""Queries over model answers: salvage, validation, labels, metrics, simulations, preference pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bellwether.functions import dates, jsonx, prompts, text
from bellwether.functions.tickers import market_symbol
from bellwether.operators import asof, backtest, bars, preference, scoring
from bellwether.plans import market
from bellwether.plans.market import ASKED, BARS, NEWS
from bellwether.session import materialize, table


def _bars(spark, d):
    return bars.daily_bars(table(spark, d, "price_bars"))


#: The spaces that SQL's trim removes: all of Unicode's space separators.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def _valid(j: Column) -> Column:
    """``j`` where it is JSON as a whole, else null: Spark's own reader stops after the first value, and lets pass
    single quotes and line breaks in strings.  As in SQL a comma may trail, and numbers may be infinite or none."""

    def strict(j: Column) -> Column:
        outside = F.regexp_replace(F.regexp_replace(j, r"(?s)\\.", ""), r'"[^"\x00-\x1f]*+"', "")
        one = F.json_array_length(F.concat(F.lit("["), j, F.lit("]"))) == 1
        return F.when(one & ~outside.rlike("['\"]"), j)

    words = r"(?i)([:\[,]\s*)(-?(?:nan|inf|infinity))(?=\s*[,}\]])"
    return F.coalesce(strict(j), strict(F.regexp_replace(F.regexp_replace(j, r",(\s*[}\]])", "$1"), words, '$1"$2"')))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    """The predictions in the responses' output, opened and coerced by built-in expressions.

    An answer that isn't JSON as a whole, as one followed by other text, has none."""
    r = table(spark, d, "reasoning_responses").where("ticker is not null and as_of is not null")
    opened = F.regexp_replace(F.trim("output", F.lit(SPACES)), r"^```\w*\s*|\s*```$", "")
    # Jackson takes no number of more than 1000 digits; a double doesn't need them.
    r = r.withColumn("o", F.regexp_replace(opened, r"(\.\d{900})\d+", "$1")).withColumn("o", _valid(F.col("o")))
    inner = F.get_json_object(F.concat(F.lit("["), "o", F.lit("]")), "$[0]")
    r = r.withColumn("i", F.when(F.col("o").startswith('"'), inner))
    plain = F.when(F.col("o").startswith('"'), _valid(F.col("i"))).otherwise(F.col("o"))

    def get(path: str):
        # A number beyond a double's range comes out as a quoted word; a letter for its type isn't part of a number in SQL, an underscore may be.
        text = F.regexp_replace(F.regexp_replace(F.get_json_object("j", path), r'^"(-?Infinity)"$', "$1"), r"(?<=\d)_(?=\d)", "")
        return F.when(~text.rlike(r"[0-9.][dDfF]\s*$"), text.try_cast("double"))

    named = r.select("response_id", "model", market_symbol(F.col("ticker")).alias("symbol"), F.col("as_of").alias("t"), plain.alias("j"))
    return named.select("response_id", "model", "symbol", "t", F.round(get("$.next_day_direction")).try_cast("int").alias("pred_direction"), get("$.next_day_closing_price").alias("pred_price"), *(get(f"$.forecast.{k}").alias(f"p_{k}") for k in ("up", "down", "unchanged")))


def q_predictions(spark, d):
    return _predictions(spark, d)


def _scored(spark, d):
    # Read and written once: keys, scores and medians would each open the answers again.
    return scoring.score_predictions(materialize(_predictions(spark, d)), _bars(spark, d))


def q_scored(spark, d):
    return _scored(spark, d).select("response_id", "model", "symbol", "d", "base_close", "next_close", "pred_price", "intraday", "pred_direction", "actual_direction", "p_up", "p_down", "brier", "rps", "ape")


def q_metrics_grouping_sets(spark, d):
    return scoring.metric_suite(_scored(spark, d), [["model"], ["model", "symbol"]])


def q_direction_metrics(spark, d):
    return scoring.metric_suite(_scored(spark, d), [["model"]]).select("model", "accuracy", "f1_weighted", "mcc")


def q_model_report(spark, d):
    return scoring.long_report(scoring.metric_suite(_scored(spark, d), [["model"]]), ["model"])


#: Models compared in the wide report.
COMPARED = ("tsllm-base-8", "tsllm-sft-8", "tsllm-dpo-8")


def q_wide_report(spark, d):
    """The metrics of three models side by side."""
    wide = scoring.wide_report(scoring.metric_suite(_scored(spark, d), [["model"]]), "model", list(COMPARED))
    return wide.select("metric", *(F.round(f"`{m}`", 6).alias(m.replace("-", "_")) for m in COMPARED))


def q_portfolio_sim(spark, d):
    rows = _scored(spark, d).where("intraday is not null").withColumn("position", backtest.positions(F.col("p_up"), F.col("p_down")))
    return backtest.simulate(rows)


def q_baseline_brsf(spark, d):
    return backtest.simulate(backtest.reversal_baseline(_bars(spark, d)).withColumn("model", F.lit("reversal")))


def q_baseline_random(spark, d):
    return backtest.simulate(backtest.random_baseline(_bars(spark, d)).withColumn("model", F.lit("random")))


def _moves(spark, d):
    b = bars.movement_targets(_bars(spark, d)).where("close is not null")
    w = bars.by_symbol()
    return b.select("symbol", "d", "close", "target", F.coalesce((F.col("close") > F.lag("close").over(w)).cast("int"), F.lit(0)).alias("prediction"))


def q_movement_metrics(spark, d):
    return scoring.movement_metrics(_moves(spark, d))


def q_movement_summary(spark, d):
    m = scoring.movement_metrics(_moves(spark, d))
    return m.agg(F.avg("accuracy").alias("accuracy_mean"), F.stddev_samp("accuracy").alias("accuracy_std"), F.avg("f1").alias("f1_mean"), F.stddev_samp("f1").alias("f1_std"))


def q_risk_profiles(spark, d):
    return backtest.risk_profiles(_moves(spark, d))


def q_risk_profile_means(spark, d):
    r = q_risk_profiles(spark, d)
    return r.groupBy("profile").agg(*(F.avg(c).alias(c) for c in ("annual_return", "max_drawdown", "sharpe")))


def _labels(spark, d):
    p = table(spark, d, "rl_pairs")
    keys = p.select(market_symbol(F.col("ticker")).alias("symbol"), F.to_date("pair_date", "yyyyMMdd").alias("t")).where("symbol is not null and t is not null").distinct()
    return bars.label_forward(keys, _bars(spark, d))


def _pairs(spark, d):
    p = table(spark, d, "rl_pairs")
    return p.select("pair_id", market_symbol(F.col("ticker")).alias("symbol"), F.to_date("pair_date", "yyyyMMdd").alias("t"), "input", "output1", "output2", "timeseries")


def q_preference_pairs(spark, d):
    return preference.preference_pairs(_pairs(spark, d), _labels(spark, d)).select("pair_id", "symbol", "t", "winner", "actual_close", "winner_error")


def q_dpo_dataset(spark, d):
    out = preference.preference_pairs(_pairs(spark, d), _labels(spark, d))
    return out.select("input", F.coalesce(F.size("timeseries"), F.lit(0)).alias("n_series"), F.col("symbol").alias("ticker"), F.date_format("t", "yyyyMMdd").alias("date"), "actual_close", "winner_error", "chosen", "rejected")


def q_json_salvage(spark, d):
    """The preferred object of each paired answer, in each of the three ways of reading."""
    p = table(spark, d, "rl_pairs")
    return p.select("pair_id", *(jsonx.salvaged(F.col("output1"), m).alias(m) for m in ("last", "any", "outer")))


def q_validate(spark, d):
    p = table(spark, d, "rl_pairs").select("pair_id", F.explode(F.array("output1", "output2")).alias("answer"))
    return p.select("pair_id", jsonx.validated(F.col("answer")).alias("v")).select("pair_id", "v.*")


def q_group_success(spark, d):
    """Per model: answers, valid answers, and questions none of whose runs is valid."""
    r = table(spark, d, "reasoning_responses").select("model", "ticker", "as_of", F.get_json_object(F.regexp_replace("output", r"^```\w*\s*|\s*```$", ""), "$.next_day_closing_price").isNotNull().alias("ok"))
    groups = r.groupBy("model", "ticker", "as_of").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.bool_or("ok").alias("any_ok"))
    return groups.groupBy("model").agg(F.sum("n").alias("n_answers"), F.sum("n_ok").alias("n_valid"), F.count("*").alias("n_groups"), F.count_if(~F.col("any_ok")).alias("n_failed_groups"))


def q_score_parse(spark, d):
    r = table(spark, d, "reasoning_responses")
    return r.select("response_id", text.parse_score(F.col("output")).alias("score"), text.parse_movement(F.col("chain_of_thought")).alias("movement"))


def q_sft_dataset(spark, d):
    """Prompt, rendered response and annotated series of each question, from the last document by its day."""
    docs = table(spark, d, "company_docs").select("record_id", market_symbol(F.col("ticker")).alias("symbol"), F.col("date_range.end").try_cast("date").alias("doc_date"), F.col("stock_data").alias("s"))
    latest = asof.keep_last(docs.where("symbol is not null and doc_date is not null"), ["symbol", "doc_date"], ["record_id"])
    r = table(spark, d, "reasoning_responses").select("response_id", market_symbol(F.col("ticker")).alias("symbol"), F.col("as_of").alias("t"), "prompt", "chain_of_thought", "output")
    x = asof.asof_backward(r, latest, "symbol", "t", "doc_date").where("doc_date is not null").withColumn("series", prompts.named_series({c: F.col(f"s.{c}") for c in bars.SERIES})).where("size(series) > 0")
    text_in = F.concat_ws("\n\n", "prompt", prompts.series_notes(F.col("series")))
    return x.select("response_id", text_in.alias("input"), prompts.answer_text(F.col("chain_of_thought"), F.col("output")).alias("output"), F.array_join(F.transform("series", lambda x: F.size(x["v"]).cast("string")), ",").alias("series_sizes"))


#: The question put to a model of movements; the domain's own wording is the caller's.
MOVEMENT = "{symbol} on {d}. News: {news}. Bars traded so far: {volume}. Closes so far: <ts><ts/>. RISE or FALL?"


def q_movement_prompts(spark, d):
    """A prompt for each bar with the last news and the closes up to it."""
    b = _bars(spark, d)
    known = asof.asof_backward(b.select("symbol", "d", "volume"), market._news(spark, d), "symbol", "d", "news_date")
    closes = bars.trailing_closes(b).where("size(history) > 0").select("symbol", "d", F.size("history").alias("n_closes"))
    filled = prompts.fill(MOVEMENT, symbol=F.col("symbol"), d=F.col("d"), news=F.col("news_title"), volume=text.humanize_billions(F.col("volume")))
    return known.join(closes, ["symbol", "d"]).select("symbol", "d", "n_closes", filled.alias("prompt"))


def q_asked_ranges(spark, d):
    """The year before each document's day as a checked range."""
    docs = table(spark, d, "company_docs")
    r = dates.checked_range(F.col("date_range.start"), F.col("date_range.end"), F.lit("2024-06-01").cast("timestamp"))
    return docs.select("record_id", r.alias("r")).select("record_id", "r.start", "r.end", "r.start_s", "r.end_s")


def q_story_days(spark, d):
    """The day each story was created, from times written in different ways."""
    return table(spark, d, "hacker_news_articles").select("article_id", dates.story_day(F.col("created_at")).alias("day"))


_PRED = r"""preds AS (
  SELECT response_id, model, symbol, t, TRY_CAST(json_extract_string(j, '$.next_day_direction') AS INT) AS pred_direction, TRY_CAST(json_extract_string(j, '$.next_day_closing_price') AS DOUBLE) AS pred_price,
    TRY_CAST(json_extract_string(j, '$.forecast.up') AS DOUBLE) AS p_up, TRY_CAST(json_extract_string(j, '$.forecast.down') AS DOUBLE) AS p_down, TRY_CAST(json_extract_string(j, '$.forecast.unchanged') AS DOUBLE) AS p_unchanged
  FROM (SELECT response_id, model, translate(upper(ticker), '_ .', '---') AS symbol, as_of AS t, CASE WHEN json_valid(j) THEN j END AS j FROM (
    SELECT *, CASE WHEN json_valid(o) AND json_type(o) = 'VARCHAR' THEN json_extract_string(o, '$') ELSE o END AS j FROM (
      SELECT *, regexp_replace(regexp_replace(trim(output), '^```\w*\s*', ''), '\s*```$', '') AS o FROM reasoning_responses WHERE ticker IS NOT NULL AND as_of IS NOT NULL))))"""
_LABEL = """n AS (
  SELECT symbol, d AS base_date, close AS base_close, lead(d) OVER w AS next_date, lead(open) OVER w AS next_open, lead(close) OVER w AS next_close, lead(split) OVER w AS next_split
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d)),
lab AS (
  SELECT a.symbol, a.t, n.*EXCLUDE (symbol), CASE WHEN abs((next_close - base_close) / base_close) <= 0.005 THEN 0 WHEN (next_close - base_close) / base_close > 0 THEN 1 WHEN (next_close - base_close) / base_close < 0 THEN -1 END AS actual_direction
  FROM asked a ASOF JOIN n ON a.symbol = n.symbol AND a.t >= n.base_date
  WHERE n.base_date >= a.t - 40 AND n.next_date < a.t + 10 AND n.next_split = 0)"""
_SCORED = f"""WITH {BARS}, {ASKED}, {_PRED}, {_LABEL},
tot AS (SELECT *, CASE WHEN p_up IS NOT NULL OR p_down IS NOT NULL OR p_unchanged IS NOT NULL THEN coalesce(p_up, 0) + coalesce(p_down, 0) + coalesce(p_unchanged, 0) END AS s FROM preds),
x AS (SELECT response_id, model, symbol, t, pred_direction, pred_price, CASE WHEN s > 0 THEN coalesce(p_up, 0) / s END AS p_up, CASE WHEN s > 0 THEN coalesce(p_down, 0) / s END AS p_down, CASE WHEN s > 0 THEN coalesce(p_unchanged, 0) / s END AS p_unchanged FROM tot),
scored AS (
  SELECT x.*, l.next_date AS d, l.base_close, l.next_close, l.actual_direction, (l.next_close - l.next_open) / nullif(l.next_open, 0) AS intraday,
    (p_up - (actual_direction = 1)::INT) ** 2 + (p_down - (actual_direction = -1)::INT) ** 2 + (p_unchanged - (actual_direction = 0)::INT) ** 2 AS brier,
    (p_down - (actual_direction = -1)::INT) ** 2 + (p_down + p_unchanged - (actual_direction <= 0)::INT) ** 2 AS rps,
    abs((pred_price - l.next_close) / nullif(l.next_close, 0)) AS ape
  FROM x JOIN lab l ON x.symbol = l.symbol AND x.t = l.t)"""


def _suite(group: str, select: str) -> str:
    ok = "pred_direction IS NOT NULL AND actual_direction IS NOT NULL"
    cls = ", ".join(f"count(*) FILTER ({ok} AND actual_direction = {c}) AS a{i}, count(*) FILTER ({ok} AND pred_direction = {c}) AS p{i}, count(*) FILTER ({ok} AND actual_direction = {c} AND pred_direction = {c}) AS h{i}" for i, c in enumerate((-1, 0, 1)))
    f1 = " + ".join(f"a{i}::DOUBLE / n * coalesce(2.0 * h{i} / nullif(a{i} + p{i}, 0), 0)" for i in range(3))
    dot = lambda a, b: " + ".join(f"{a}{i}::DOUBLE * {b}{i}" for i in range(3))
    root = f"sqrt((n::DOUBLE * n - ({dot('p', 'p')})) * (n::DOUBLE * n - ({dot('a', 'a')})))"
    return f"""{_SCORED}, agg AS (
  SELECT model, {'symbol, ' if 'symbol' in group else ''}count(*) AS n_rows, avg(rps) AS rps, avg(brier) AS brier, count(*) FILTER ({ok}) AS n, count(*) FILTER ({ok} AND pred_direction = actual_direction) AS hits, {cls},
    sqrt(avg((next_close - pred_price) ** 2)) AS rmse, avg(2 * abs(next_close - pred_price) / (abs(next_close) + abs(pred_price))) AS smape, median(ape) AS mdape
  FROM scored GROUP BY {group}),
m AS (SELECT *, (a0 > 0)::INT + (a1 > 0)::INT + (a2 > 0)::INT > 1 AS many FROM agg),
suite AS (SELECT *, CASE WHEN many THEN hits::DOUBLE / n END AS accuracy, CASE WHEN many THEN {f1} END AS f1_weighted, CASE WHEN many THEN CASE WHEN {root} = 0 THEN 0 ELSE (hits::DOUBLE * n - ({dot('a', 'p')})) / {root} END END AS mcc FROM m)
SELECT {select} FROM suite"""


_RATE = "(pow(1.04, 1.0 / 252) - 1)"


def _simulation(rows: str) -> str:
    return f"""{rows}, daily AS (SELECT model, d, sum(position * intraday - abs(position) * 0.0005) / count(symbol) AS ret FROM sim GROUP BY model, d),
spine AS (SELECT model, CAST(d AS DATE) AS d FROM (SELECT DISTINCT model FROM daily), (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS d FROM sim) WHERE isodow(d) < 6),
f AS (SELECT s.model, s.d, coalesce(y.ret, {_RATE}) AS ret FROM spine s LEFT JOIN daily y ON s.model = y.model AND s.d = y.d),
v AS (SELECT *, product(1 + ret) OVER w * 100000 AS value FROM f WINDOW w AS (PARTITION BY model ORDER BY d ROWS UNBOUNDED PRECEDING)),
u AS (SELECT *, value / max(value) OVER (PARTITION BY model ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS fall FROM v)
SELECT model, pow(max_by(value, d) / 100000, 252.0 / count(*)) - 1 AS annual_return, CASE WHEN stddev_samp(ret - {_RATE}) > 0 THEN avg(ret - {_RATE}) / stddev_samp(ret - {_RATE}) * sqrt(252) ELSE 0 END AS sharpe, min(fall) AS max_drawdown FROM u GROUP BY model"""


_MOVES = f"""WITH {BARS}, mv0 AS (SELECT symbol, d, close, coalesce(CAST(lead(close) OVER (PARTITION BY symbol ORDER BY d) > close AS INT), 0) AS target FROM bars),
mv AS (SELECT symbol, d, close, target, coalesce(CAST(close > lag(close) OVER (PARTITION BY symbol ORDER BY d) AS INT), 0) AS prediction FROM mv0 WHERE close IS NOT NULL)"""
_MOVEMENT = f"""{_MOVES}, met AS (SELECT symbol, count(*) FILTER (target = prediction)::DOUBLE / count(*) AS accuracy,
  coalesce(2.0 * count(*) FILTER (target = 1 AND prediction = 1) / nullif(count(*) FILTER (prediction = 1) + count(*) FILTER (target = 1), 0), 0) AS f1 FROM mv GROUP BY symbol)"""
_RISK = f"""WITH RECURSIVE {_MOVES[5:]},
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d) AS i FROM mv),
pr AS (SELECT * FROM (VALUES ('Conservative', 0.5::DOUBLE, 1.0::DOUBLE), ('M.Conservative', 0.7, 1.0), ('M.Aggressive', 1.0, 0.5), ('Aggressive', 1.0, 0.3)) AS t(profile, buy, sell)),
path AS (
  SELECT DISTINCT pr.profile, pr.buy, pr.sell, r.symbol, 0::BIGINT AS i, 100000.0::DOUBLE AS cash, 0.0::DOUBLE AS shares, 100000.0::DOUBLE AS value FROM pr, r
  UNION ALL
  SELECT p.profile, p.buy, p.sell, p.symbol, r.i,
    CASE WHEN r.prediction = 1 AND p.cash > 1 THEN p.cash - p.cash * p.buy WHEN r.prediction = 0 AND p.shares > 0 THEN p.cash + p.shares * p.sell * r.close ELSE p.cash END,
    CASE WHEN r.prediction = 1 AND p.cash > 1 THEN p.shares + p.cash * p.buy / r.close WHEN r.prediction = 0 AND p.shares > 0 THEN p.shares - p.shares * p.sell ELSE p.shares END,
    CASE WHEN r.prediction = 1 AND p.cash > 1 THEN p.cash - p.cash * p.buy WHEN r.prediction = 0 AND p.shares > 0 THEN p.cash + p.shares * p.sell * r.close ELSE p.cash END
    + CASE WHEN r.prediction = 1 AND p.cash > 1 THEN p.shares + p.cash * p.buy / r.close WHEN r.prediction = 0 AND p.shares > 0 THEN p.shares - p.shares * p.sell ELSE p.shares END * r.close
  FROM path p JOIN r ON p.symbol = r.symbol AND r.i = p.i + 1),
st AS (SELECT *, value / lag(value) OVER w - 1 AS step, (max(value) OVER w - value) / max(value) OVER w AS fall FROM path WINDOW w AS (PARTITION BY profile, symbol ORDER BY i)),
sp AS (SELECT symbol, max(d) - min(d) AS span FROM r GROUP BY symbol),
risk AS (SELECT profile, st.symbol, CASE WHEN any_value(span) > 0 THEN pow(max_by(value, i) / min_by(value, i), 365.0 / any_value(span)) - 1 END AS annual_return, max(fall) AS max_drawdown,
  CASE WHEN stddev_samp(step) = 0 THEN 0 ELSE avg(step) / stddev_samp(step) * sqrt(252) END AS sharpe FROM st JOIN sp ON st.symbol = sp.symbol GROUP BY profile, st.symbol)"""
_ALL = "model, n_rows, rps, brier, accuracy, f1_weighted, mcc, rmse, smape, mdape"
SQL = {
    "q_predictions": f"WITH {_PRED} SELECT * FROM preds",
    "q_scored": f"{_SCORED} SELECT response_id, model, symbol, d, base_close, next_close, pred_price, intraday, pred_direction, actual_direction, p_up, p_down, brier, rps, ape FROM scored",
    "q_metrics_grouping_sets": _suite("GROUPING SETS ((model), (model, symbol))", _ALL.replace("model,", "model, symbol,")),
    "q_direction_metrics": _suite("model", "model, accuracy, f1_weighted, mcc"),
    "q_model_report": "SELECT model, metric, value FROM (SELECT model, unnest(['rps', 'brier', 'accuracy', 'f1_weighted', 'mcc', 'rmse', 'smape', 'mdape']) AS metric, unnest([rps, brier, accuracy, f1_weighted, mcc, rmse, smape, mdape]) AS value FROM (" + _suite("model", _ALL) + "))",
    "q_portfolio_sim": _simulation(f"{_SCORED}, sim AS (SELECT model, symbol, d, intraday, CASE WHEN p_down > 0.55 THEN -1 WHEN p_up > 0.55 THEN 1 ELSE 0 END AS position FROM scored WHERE intraday IS NOT NULL)"),
    "q_baseline_brsf": _simulation(f"WITH {BARS}, sim AS (SELECT 'reversal' AS model, symbol, d, (close - open) / open AS intraday, coalesce(sign(lag(close, 1) OVER w - lag(close, 2) OVER w), 0) AS position FROM bars WHERE open IS NOT NULL AND close IS NOT NULL AND open <> 0 WINDOW w AS (PARTITION BY symbol ORDER BY d))"),
    "q_baseline_random": _simulation(
        f"WITH {BARS}, sim AS (SELECT 'random' AS model, symbol, d, (close - open) / open AS intraday, (list_reduce(list_prepend(7::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(symbol, '')]), lambda a, x: (a * 31 + x) % 1000003) * 7919 + (d - DATE '1970-01-01') * 104729) % 1000003 % 3 - 1 AS position FROM bars WHERE open IS NOT NULL AND close IS NOT NULL AND open <> 0)"
    ),
    "q_movement_metrics": f"{_MOVEMENT} SELECT * FROM met",
    "q_movement_summary": f"{_MOVEMENT} SELECT avg(accuracy) AS accuracy_mean, stddev_samp(accuracy) AS accuracy_std, avg(f1) AS f1_mean, stddev_samp(f1) AS f1_std FROM met",
    "q_risk_profiles": f"{_RISK} SELECT * FROM risk",
    "q_risk_profile_means": f"{_RISK} SELECT profile, avg(annual_return) AS annual_return, avg(max_drawdown) AS max_drawdown, avg(sharpe) AS sharpe FROM risk GROUP BY profile",
    "q_score_parse": r"""SELECT response_id, coalesce(TRY_CAST(nullif(regexp_extract(output, '([0-3])', 1), '') AS INT), -1) AS score,
  CAST(coalesce(list_contains(list_filter(regexp_split_to_array(upper(chain_of_thought), '[\s\x{A0}\x{2007}\x{202F}]+'), lambda w: w <> '')[-6:], 'RISE'), FALSE) AS INT) AS movement FROM reasoning_responses""",
    "q_group_success": r"""WITH r AS (SELECT model, ticker, as_of, CASE WHEN json_valid(o) THEN json_extract_string(o, '$.next_day_closing_price') END IS NOT NULL AS ok FROM (SELECT *, regexp_replace(regexp_replace(output, '^```\w*\s*', ''), '\s*```$', '') AS o FROM reasoning_responses)),
g AS (SELECT model, ticker, as_of, count(*) AS n, count(*) FILTER (ok) AS n_ok, bool_or(ok) AS any_ok FROM r GROUP BY ALL)
SELECT model, CAST(sum(n) AS BIGINT) AS n_answers, CAST(sum(n_ok) AS BIGINT) AS n_valid, count(*) AS n_groups, count(*) FILTER (NOT any_ok) AS n_failed_groups FROM g GROUP BY model""",
}


def _object(c: str) -> str:
    """The object of an answer: JSON, JSON in a string, or what lies between the outermost braces."""
    inner = f"json_extract_string({c}, '$')"
    braces = f"regexp_extract({c}, '(?s)\\{{.*\\}}', 0)"
    return f"CASE WHEN json_valid({c}) THEN CASE WHEN json_type({c}) = 'VARCHAR' AND json_valid({inner}) THEN {inner} ELSE {c} END WHEN json_valid({braces}) THEN {braces} END"


_PAIR = f"""WITH {BARS}, p AS (SELECT pair_id, translate(upper(ticker), '_ .', '---') AS symbol, CAST(strptime(pair_date, '%Y%m%d') AS DATE) AS t, {_object('output1')} AS j1, {_object('output2')} AS j2 FROM rl_pairs WHERE input IS NOT NULL AND output1 IS NOT NULL AND output2 IS NOT NULL),
q AS (SELECT pair_id, symbol, t, {', '.join(f"TRY_CAST(json_extract_string(j{i}, '$.output.next_day_direction') AS BIGINT) AS d{i}, TRY_CAST(json_extract_string(j{i}, '$.output.next_day_closing_price') AS DOUBLE) AS c{i}" for i in (1, 2))} FROM p),
r AS (SELECT k.symbol, k.t, b.d, b.close, row_number() OVER (PARTITION BY k.symbol, k.t ORDER BY b.d) AS rn FROM (SELECT DISTINCT symbol, t FROM p) k JOIN bars b ON k.symbol = b.symbol AND b.d >= k.t AND b.d < k.t + 10),
lab AS (SELECT x.symbol, x.t, y.close AS actual, CASE WHEN y.close = x.close THEN 0 WHEN y.close > x.close THEN 1 WHEN y.close < x.close THEN -1 END AS dir FROM r x JOIN r y ON x.symbol = y.symbol AND x.t = y.t AND x.rn = 1 AND y.rn = 2),
v AS (SELECT q.*, lab.actual, {', '.join(f"(d{i} IS NOT NULL AND c{i} IS NOT NULL) AS v{i}, coalesce(d{i} = dir AND c{i} IS NOT NULL, FALSE) AS r{i}, CASE WHEN d{i} IS NOT NULL THEN abs((c{i} - actual) / nullif(actual, 0)) END AS e{i}" for i in (1, 2))} FROM q JOIN lab ON q.symbol = lab.symbol AND q.t = lab.t),
w AS (SELECT *, CASE WHEN NOT v1 AND NOT v2 THEN 0 WHEN v1 AND NOT v2 THEN 1 WHEN v2 AND NOT v1 THEN 2 WHEN r1 AND NOT r2 THEN 1 WHEN r2 AND NOT r1 THEN 2 WHEN e1 < e2 THEN 1 ELSE 2 END AS winner FROM v)
SELECT pair_id, symbol, t, winner, actual AS actual_close, CASE WHEN winner = 1 THEN e1 ELSE e2 END AS winner_error FROM w WHERE winner > 0"""
SQL["q_preference_pairs"] = _PAIR
SQL["q_movement_prompts"] = f"""WITH {BARS}, {NEWS}, h AS (SELECT symbol, d, volume, count(close) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 30 PRECEDING AND CURRENT ROW) AS n FROM bars)
SELECT h.symbol, h.d, CAST(h.n AS INT) AS n_closes, h.symbol || ' on ' || CAST(h.d AS VARCHAR) || '. News: ' || coalesce(n.news_title, '') || '. Bars traded so far: ' || coalesce(CAST(CAST(h.volume / 1e9 AS DECIMAL(18,2)) AS VARCHAR) || 'B', 'N/A') || '. Closes so far: <ts><ts/>. RISE or FALL?' AS prompt
FROM h ASOF LEFT JOIN news n ON h.symbol = n.symbol AND h.d >= n.news_date WHERE h.n > 0"""
SQL["q_asked_ranges"] = """WITH r AS (SELECT record_id, TRY_CAST(date_range.start AS DATE) AS a, TRY_CAST(date_range."end" AS DATE) AS b FROM company_docs)
SELECT record_id, CASE WHEN a <= b THEN a END AS start, CASE WHEN a <= b THEN least(b, DATE '2024-06-01') END AS "end", CASE WHEN a <= b THEN CAST(epoch(a) AS BIGINT) END AS start_s, CASE WHEN a <= b THEN CAST(epoch(least(b, DATE '2024-06-01')) AS BIGINT) END AS end_s FROM r"""
SQL["q_story_days"] = "SELECT article_id, coalesce(strftime(TRY_CAST(created_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%d'), '') AS day FROM hacker_news_articles"
SQL["q_dpo_dataset"] = f"""SELECT p.input, CAST(coalesce(len(p.timeseries), 0) AS INT) AS n_series, f.symbol AS ticker, strftime(f.t, '%Y%m%d') AS date, f.actual_close, f.winner_error,
  CASE WHEN winner = 1 THEN output1 ELSE output2 END AS chosen, CASE WHEN winner = 1 THEN output2 ELSE output1 END AS rejected FROM ({_PAIR}) f JOIN rl_pairs p ON f.pair_id = p.pair_id"""
SQL["q_sft_dataset"] = """WITH docs AS (SELECT translate(upper(ticker), '_ .', '---') AS symbol, TRY_CAST(date_range."end" AS DATE) AS doc_date, arg_max(stock_data, record_id) AS s, max(record_id) AS last FROM (SELECT * FROM company_docs) WHERE ticker IS NOT NULL AND TRY_CAST(date_range."end" AS DATE) IS NOT NULL GROUP BY 1, 2),
u AS (SELECT d.symbol, d.doc_date, c.stock_data AS s FROM docs d JOIN company_docs c ON d.last = c.record_id),
x AS (SELECT r.*, u.s FROM (SELECT response_id, translate(upper(ticker), '_ .', '---') AS symbol, as_of AS t, prompt, chain_of_thought, output FROM reasoning_responses) r ASOF JOIN u ON r.symbol = u.symbol AND r.t >= u.doc_date),
y AS (SELECT *, list_filter([{'name': 'open', 'v': coalesce(s.open, [])}, {'name': 'high', 'v': coalesce(s.high, [])}, {'name': 'low', 'v': coalesce(s.low, [])}, {'name': 'close', 'v': coalesce(s.close, [])}, {'name': 'volume', 'v': coalesce(s.volume, [])}], lambda q: len(q.v) > 0) AS series FROM x)
SELECT response_id, concat_ws(chr(10) || chr(10), prompt, array_to_string([q.name || ': Min: ' || printf('%.4f', list_min(q.v)) || ', Max: ' || printf('%.4f', list_max(q.v)) || ' <ts><ts/>' FOR q IN series], chr(10))) AS input,
  CASE WHEN chain_of_thought IS NOT NULL THEN chain_of_thought || chr(10) || chr(10) || 'Final Prediction: ' || coalesce(output, '') ELSE output END AS output, array_to_string([CAST(len(q.v) AS VARCHAR) FOR q IN series], ',') AS series_sizes FROM y WHERE len(series) > 0"""
_LONG_REPORT = SQL["q_model_report"]
SQL["q_wide_report"] = f"SELECT metric, {', '.join(f"""max(round(value, 6)) FILTER (model = '{m}') AS {m.replace('-', '_')}""" for m in COMPARED)} FROM ({_LONG_REPORT}) GROUP BY metric"
#: Results of sums of floating-point numbers, given to six places: their last bits depend on the order.
ROUNDED = {
    "q_scored": ("p_up", "p_down", "brier", "rps", "ape", "intraday"),
    **dict.fromkeys(("q_metrics_grouping_sets",), ("rps", "brier", "accuracy", "f1_weighted", "mcc", "rmse", "smape", "mdape")),
    "q_direction_metrics": ("accuracy", "f1_weighted", "mcc"),
    "q_model_report": ("value",),
    **dict.fromkeys(("q_portfolio_sim", "q_baseline_brsf", "q_baseline_random", "q_risk_profiles", "q_risk_profile_means"), ("annual_return", "max_drawdown", "sharpe")),
    "q_movement_metrics": ("accuracy", "f1"),
    "q_movement_summary": ("accuracy_mean", "accuracy_std", "f1_mean", "f1_std"),
    "q_preference_pairs": ("winner_error",),
    "q_dpo_dataset": ("winner_error",),
}


def _rounded(f, columns: tuple[str, ...]):
    def query(spark, d):
        return f(spark, d).withColumns({c: F.round(c, 6) for c in columns})

    return query


for _name, _columns in ROUNDED.items():
    SQL[_name] = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in _columns)}) FROM ({SQL[_name]})"
QUERIES = {n: _rounded(f, ROUNDED[n]) if n in ROUNDED else f for n, f in list(globals().items()) if n.startswith("q_")}
