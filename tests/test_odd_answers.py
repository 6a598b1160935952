"""Queries over answers whose numbers are written in odd ways or without bound, against DuckDB."""

import datetime as dt
import json

import pytest

from bellwether.plans import evaluation
from tests.compare import connect, rows_of_duckdb, rows_of_spark

#: Numbers of answers as JSON: with a point or in a string, in halves, beyond a double's range, without bound, no numbers.
NUMBERS = ("1", "-1.0", "0.5", "-2.5", '"1.0"', '" 1 "', "1e400", "-1e400", '"Infinity"', '"NaN"', '"1.0f"', "null", "true", "3000000000")
MODELS = evaluation.COMPARED
PRICES = "open_price double, high_price double, low_price double, close_price double"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(len(NUMBERS) + 1)]
    bars = [(n, n, "A", t, *[10.0 + n % 3] * 4, 100, 0.0, dt.datetime(2025, 1, 1)) for n, t in enumerate(days)]
    spark.createDataFrame(bars, f"bar_id bigint, fetch_id bigint, ticker string, bar_date date, {PRICES}, volume bigint, stock_splits double, fetched_at timestamp").write.parquet(f"{d}/price_bars.parquet")
    # The first model's prices are mostly numbers, half of the second's are infinite, and the third's are mostly no numbers.
    prices = {MODELS[0]: lambda i: NUMBERS[i], MODELS[1]: lambda i: "1e400" if i % 2 else "12", MODELS[2]: lambda i: '"NaN"' if i else "12"}
    answers = [(f'{{"next_day_direction": {x}, "next_day_closing_price": {price(i)}, "forecast": {{"up": {x}, "down": 0.5, "unchanged": 0.25}}}}', days[i], m) for m, price in prices.items() for i, x in enumerate(NUMBERS)]
    answers = [(n, "A", t, m, x) for n, (x, t, m) in enumerate(answers)]
    spark.createDataFrame(answers, "response_id bigint, ticker string, as_of date, model string, output string").write.parquet(f"{d}/reasoning_responses.parquet")
    return d


@pytest.mark.parametrize("name", ["q_scored", "q_model_report", "q_wide_report"])
def test_against_sql(spark, tables, name):
    got = rows_of_spark(evaluation.QUERIES[name](spark, tables))
    assert got[1] and got == rows_of_duckdb(connect(tables), evaluation.SQL[name])


def test_directions_written_with_a_point(spark, tables):
    got = {r.response_id: r.pred_direction for r in evaluation.QUERIES["q_scored"](spark, tables).where(f"model = '{MODELS[0]}'").collect()}
    assert [got[i] for i in range(len(NUMBERS))] == [1, -1, 1, -3, 1, 1, *[None] * 8]


def test_medians_of_errors_without_bound(spark, tables):
    got = {r.model: r.value for r in evaluation.QUERIES["q_model_report"](spark, tables).where("metric = 'mdape'").collect()}
    assert got[MODELS[1]] == float("inf") and got[MODELS[2]] != got[MODELS[2]] and 0 < got[MODELS[0]] < float("inf")


#: Answers around one object: spaces, fences, strings, what follows or trails, and whether SQL takes them for JSON.
OBJECT = '{"next_day_direction": 1, "next_day_closing_price": 12.5, "forecast": {"up": 0.5, "down": 0.25, "unchanged": 0.25}}'
WRAPPED = {
    OBJECT: True,
    f"\u00a0{OBJECT}\u2003": True,
    f"```json\n{OBJECT}\n```": True,
    f" {json.dumps(OBJECT)}": True,
    f"```json\n{json.dumps(OBJECT)}\n```": True,
    json.dumps(OBJECT[:-1] + ', "why": "\\u00e9 \\"up\\" \\\\"}'): True,
    OBJECT[:-1] + ",}": True,
    OBJECT[:-1] + ', "more": NaN}': True,
    OBJECT[:-1] + ', "why": "it\'s NaN, up"}': True,
    OBJECT.replace("0.5", "0.5" + "0" * 1200): True,
    OBJECT.replace("12.5", '"1_2.5"'): True,
    f"{OBJECT} up": False,
    f"{OBJECT}}}": False,
    f'{OBJECT}"': False,
    f"{OBJECT},{OBJECT}": False,
    OBJECT.replace('"', "'"): False,
    OBJECT[:-1] + ', "why": "a\nb"}': False,
}


def test_answers_that_are_json_as_a_whole(spark, tmp_path):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(len(WRAPPED) + 1)]
    bars = [(n, n, "A", t, *[10.0 + n % 3] * 4, 100, 0.0, dt.datetime(2025, 1, 1)) for n, t in enumerate(days)]
    spark.createDataFrame(bars, f"bar_id bigint, fetch_id bigint, ticker string, bar_date date, {PRICES}, volume bigint, stock_splits double, fetched_at timestamp").write.parquet(f"{tmp_path}/price_bars.parquet")
    answers = [(n, "A", days[n], MODELS[n % 3], x) for n, x in enumerate(WRAPPED)]
    spark.createDataFrame(answers, "response_id bigint, ticker string, as_of date, model string, output string").write.parquet(f"{tmp_path}/reasoning_responses.parquet")
    got = {r.response_id: (r.pred_direction, r.pred_price, r.p_up, r.p_down, r.p_unchanged) for r in evaluation.QUERIES["q_predictions"](spark, str(tmp_path)).collect()}
    assert got == {n: (1, 12.5, 0.5, 0.25, 0.25) if ok else (None,) * 5 for n, ok in enumerate(WRAPPED.values())}
    for name in ("q_predictions", "q_scored", "q_model_report", "q_wide_report"):
        rows = rows_of_spark(evaluation.QUERIES[name](spark, str(tmp_path)))
        assert rows[1] and rows == rows_of_duckdb(connect(str(tmp_path)), evaluation.SQL[name])
