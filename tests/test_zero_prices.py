"""Queries over bars and answers whose prices are zero, against DuckDB."""

import datetime as dt
import json

import pytest

from bellwether.plans import evaluation, market
from tests.compare import connect, rows_of_duckdb, rows_of_spark

#: Closes by day: to zero, zero after zero, from zero, within the band, a symbol that ends at zero, one without, and one that rises to zero.
CLOSES = {"A": [10.0, 0.0, 0.0, 5.0, 5.0, 6.0, 0.0, 4.0, None, 3.0, 3.01], "B": [1.0, 2.0, 3.0, 0.0, 0.0, 0.0], "C": [8.0, 9.0, 10.0, 9.0], "D": [-1.0, 0.0, 2.0, 1.0]}
MODELS = ("tsllm-base-8", "tsllm-sft-8", "tsllm-dpo-8")
QUERIES = market.QUERIES | evaluation.QUERIES
SQL = market.SQL | evaluation.SQL


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("zero"))
    bars = [(s, day(i), c) for s, closes in CLOSES.items() for i, c in enumerate(closes)]
    bars = [(n, n, s, t, c, c, c, c, 100, 0.0, dt.datetime(2025, 1, 1)) for n, (s, t, c) in enumerate(bars)]
    prices = ", ".join(f"{k}_price double" for k in ("open", "high", "low", "close"))
    spark.createDataFrame(bars, f"bar_id bigint, fetch_id bigint, ticker string, bar_date date, {prices}, volume bigint, stock_splits double, fetched_at timestamp").write.parquet(f"{d}/price_bars.parquet")
    asked = [(m, s, i) for m in MODELS for s, closes in CLOSES.items() for i in range(len(closes))]
    answers = [(n, s, day(i), m, json.dumps({"next_day_direction": n % 3 - 1, "next_day_closing_price": float(n % 4 if m != MODELS[1] else 2), "forecast": {"up": 0.25, "down": 0.5, "unchanged": 0.25}})) for n, (m, s, i) in enumerate(asked)]
    spark.createDataFrame(answers, "response_id bigint, ticker string, as_of date, model string, output string").write.parquet(f"{d}/reasoning_responses.parquet")
    return d


@pytest.mark.parametrize("name", ["q_direction_metrics", "q_metrics_grouping_sets", "q_risk_profile_means", "q_scored", "q_label_backward", "q_model_report", "q_risk_profiles", "q_wide_report"])
def test_against_sql(spark, tables, name):
    got = rows_of_spark(QUERIES[name](spark, tables))
    assert got[1] and got == rows_of_duckdb(connect(tables), SQL[name])


def test_smape_of_zero_foretold_as_zero(spark, tables):
    rows = QUERIES["q_metrics_grouping_sets"](spark, tables).where("symbol is null").collect()
    smape = {r.model: r.smape for r in rows}
    want = {m: v for m, v in connect(tables).sql(f"select model, smape from ({SQL['q_metrics_grouping_sets']}) where symbol is null").fetchall()}
    assert [m for m in MODELS if smape[m] != smape[m]] == [m for m in MODELS if want[m] != want[m]] == [MODELS[0], MODELS[2]]
    assert smape[MODELS[1]] == pytest.approx(want[MODELS[1]])


def test_directions_from_zero(spark, tables):
    got = {r.t: (r.base_close, r.next_close, r.direction) for r in QUERIES["q_label_backward"](spark, tables).where("symbol = 'A' and base_date = t").collect()}
    assert got[day(0)] == (10.0, 0.0, -1) and got[day(1)] == (0.0, 0.0, 1) and got[day(2)] == (0.0, 5.0, 1) and got[day(3)] == (5.0, 5.0, 0)


def test_no_number_is_not_null(spark, tables):
    columns = ("annual_return", "max_drawdown", "sharpe")
    kind = lambda v: "null" if v is None else "nan" if v != v else "number"
    got = {(r.profile, r.symbol): [kind(r[c]) for c in columns] for r in QUERIES["q_risk_profiles"](spark, tables).collect()}
    want = connect(tables).sql(f"select profile, symbol, {', '.join(columns)} from ({SQL['q_risk_profiles']})").fetchall()
    assert got == {(p, s): [kind(v) for v in vs] for p, s, *vs in want}
    assert got["Aggressive", "A"][2] == got["Aggressive", "D"][2] == "nan" and got["Conservative", "C"][2] == "number"
