import datetime as dt
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from bellwether.operators import asof, backtest, bars, documents, filings, nested, news, preference, ranking, scoring, spikes, universe
from bellwether.operators.quantile import exact_median
from bellwether.plans import evaluation
from bellwether.session import join_counted, materialize

D = dt.date


def day(n):
    return D(2024, 1, 1) + dt.timedelta(days=n)


def test_asof_against_brute_force(spark):
    rng = random.Random(3)
    left = [(rng.choice("ab"), day(rng.randrange(200)), i) for i in range(80)] + [(None, day(3), 900), ("a", None, 901)]
    seen = {(rng.choice("ab"), day(rng.randrange(200))) for _ in range(40)}
    right = [(k, t, None if i % 3 == 0 else i) for i, (k, t) in enumerate(sorted(seen))] + [(None, day(1), 5)]
    a = spark.createDataFrame(left, "k string, t date, id int")
    b = spark.createDataFrame(right, "k string, r date, v int")
    for strict in (False, True):
        got = {r.id: (r.r, r.v) for r in asof.asof_backward(a, b, "k", "t", "r", strict).collect()}
        assert len(got) == len(left)
        for k, t, i in left:
            met = [(r, v) for kk, r, v in right if k and t and kk == k and (r < t if strict else r <= t)]
            assert got[i] == (max(met, key=lambda x: x[0]) if met else (None, None))


def test_asof_of_empty_sides(spark):
    a = spark.createDataFrame([], "k string, t date, id int")
    b = spark.createDataFrame([], "k string, r date, v int")
    assert asof.asof_backward(a, b, "k", "t", "r").count() == 0
    one = spark.createDataFrame([("a", day(1), 1)], "k string, t date, id int")
    assert asof.asof_backward(one, b, "k", "t", "r").first().v is None


def test_rolling_last_crosses_months(spark):
    rows = [("a", day(20 * i), i) for i in range(8)] + [("a", day(20), 99), ("b", day(3), 7)]
    df = spark.createDataFrame(rows, "k string, t date, i int")
    got = {(r.k, r.t): r["last"] for r in asof.rolling_last(df, "k", "t", "i", F.col("i"), 3, "last").collect()}
    ordered = sorted((t, i) for k, t, i in rows if k == "a")
    for t in {t for t, _ in ordered}:
        assert got["a", t] == [i for u, i in ordered if u <= t][-3:]
    assert got["b", day(3)] == [7]


def test_keep_last_breaks_ties_by_the_unique_column(spark):
    df = spark.createDataFrame([("a", 1, 1, "x"), ("a", 1, 2, "y"), ("a", None, 9, "z"), (None, 1, 3, "n")], "k string, o int, id int, v string")
    assert {r.k: r.v for r in asof.keep_last(df, ["k"], ["o", "id"]).collect()} == {"a": "y", None: "n"}


def test_universe_against_replay(spark):
    rng = random.Random(5)
    names = [f"T{i}" for i in range(12)]
    log = [(rng.choice(names), rng.choice(["Added", "Removed"]), day(rng.randrange(1, 60)), i) for i in range(60)]
    log = list({(t, d): (t, k, d, i) for t, k, d, i in log}.values())
    current = {n for n in names if rng.random() < 0.5}
    dates = [day(0), day(15), day(30), day(59)]
    got = universe.universe_asof(
        spark.createDataFrame([(n,) for n in current] + [(None,), ("",)], "ticker string"),
        spark.createDataFrame(log + [(None, "Added", day(1), 1000), ("T1", None, day(1), 1001)], "ticker string, kind string, d date, change_id int"),
        spark.createDataFrame([(d,) for d in dates], "t date"),
        spark.createDataFrame([("T3",)], "ticker string"),
    ).collect()
    for t in dates:
        members = set(current)
        for ticker, kind, d, _ in sorted(log, key=lambda x: x[2], reverse=True):
            if d > t:
                (members.discard if kind == "Added" else members.add)(ticker)
        assert {r.ticker for r in got if r.t == t} == members - {"T3"}


def _bars(spark, rows):
    return spark.createDataFrame(rows, "symbol string, d date, open double, close double, split double")


def test_labels(spark):
    b = _bars(spark, [("A", day(0), 9.0, 200.0, 0.0), ("A", day(3), 10.0, 201.0, 0.0), ("A", day(4), 10.0, 220.0, 0.0), ("A", day(5), 10.0, 5.0, 2.0)])
    keys = spark.createDataFrame([("A", day(1)), ("A", day(3)), ("A", day(4)), ("A", day(60)), ("B", day(1))], "symbol string, t date")
    back = {r.t: r for r in bars.label_backward(keys, b).collect()}
    assert set(back) == {day(1), day(3)}  # split day, no next bar, no symbol drop out
    assert back[day(1)].base_date == day(0) and back[day(1)].direction == 0  # exactly half a percent
    assert back[day(3)].direction == 1
    fwd = {r.t: r for r in bars.label_forward(keys, b).collect()}
    assert set(fwd) == {day(1), day(3), day(4)} and fwd[day(1)].base_date == day(3) and fwd[day(4)].direction == -1


def test_series_and_targets(spark):
    b = spark.createDataFrame([("A", day(i), None if i == 1 else float(i), 1.0, 1.0, float(i), None) for i in range(5)], "symbol string, d date, open double, high double, low double, close double, volume bigint")
    keys = spark.createDataFrame([("A", day(4)), ("Z", day(4))], "symbol string, t date")
    got = {r.symbol: r for r in bars.last_values(b, keys, 365, 3).collect()}
    assert got["A"].close == [1.0, 2.0, 3.0] and got["A"].open == [0.0, 2.0, 3.0] and got["A"].volume == [] and got["Z"].close == []
    assert [r.target for r in bars.movement_targets(b).orderBy("d").collect()] == [1, 1, 1, 1, 0]
    assert bars.movement_targets(b, null_last=True).orderBy(F.desc("d")).first().target is None
    e = spark.createDataFrame([([], [2.0, 1.0])], "close array<double>, open array<double>")
    r = bars.series_bounds(e, ("close", "open")).first()
    assert (r.close_min, r.close_max, r.open_min, r.open_max) == (0.0, 1.0, 1.0, 2.0)


def test_filing_sets(spark):
    def f(form, n, acc):
        return ("S", acc, form, day(n))

    rows = [f("10-K", 10, "k1"), f("10-Q", 5, "q0"), f("10-Q", 20, "q1"), f("10-K/A", 30, "ka"), f("8-K", 15, "e0"), f("8-K", 25, "e1"), f("8-K", 25, "e2"), *(f("8-K", 40 + i, f"x{i:02}") for i in range(12))]
    df = spark.createDataFrame(rows, "symbol string, accession string, form string, filed date")
    keys = spark.createDataFrame([("S", day(26)), ("S", day(10)), ("S", day(11)), ("S", day(90)), ("N", day(5))], "symbol string, t date")
    got = {(r.symbol, r.t): r for r in filings.filing_sets(keys, df).collect()}
    assert (got["S", day(26)].k_accession, got["S", day(26)].q_accession, got["S", day(26)].eight_k) == ("k1", "q1", ["e2", "e1"])
    assert got["S", day(10)].k_accession is None and got["S", day(10)].q_accession == "q0" and got["S", day(10)].eight_k == []
    assert got["S", day(11)].q_accession is None and got["S", day(11)].k_accession == "k1"  # the older 10-Q is dropped
    assert got["S", day(90)].eight_k == [f"x{i:02}" for i in range(11, 1, -1)]
    assert got["N", day(5)].k_date is None


def test_modal_value_first_seen_wins_ties(spark):
    df = spark.createDataFrame([("g", "b", 1), ("g", "a", 2), ("g", "a", 3), ("g", "b", 4), ("g", None, 5), ("h", None, 6)], "g string, v string, i int")
    assert [(r.g, r.v) for r in filings.modal_value(df, "g", "v", "i").collect()] == [("g", "b")]


def _budget_by_rewind(paragraphs, articles, limit, total):
    """The removals by levels with a rewind inside the level that fits."""
    left, taken = total, 0
    for what, scores in documents.LEVELS:
        if what == "paragraph":
            level = [c for section in paragraphs for c in [p[1] for p in reversed(section) if p[0] in scores]]
        else:
            found = [a for a in articles if a[0] in scores]
            level = [a[2 if what == "news" else 1] for a in (reversed(found) if what == "news" else found)]
        if not level or left <= limit:
            continue
        if left - sum(level) <= limit:
            for c in level:
                left, taken = left - c, taken + 1
                if left <= limit:
                    return left, taken, False
        left, taken = left - sum(level), taken + len(level)
    return left, taken, left > limit


def _document(rng, i):
    words = lambda n: " ".join(["w"] * n) if n else None
    section = lambda: [words(rng.randrange(0, 9)) for _ in range(rng.randrange(0, 5))]
    arts = [(words(2), "2024", "u", words(rng.randrange(0, 6)), rng.choice([None, 0, 1, 2, 3]), None) for _ in range(rng.randrange(0, 4))]
    report = lambda: None if rng.random() < 0.2 else (section(), None)
    return (i, "Some Name", "T", None, None, report(), report(), [report() for _ in range(rng.randrange(0, 3))] if rng.random() < 0.8 else None, arts if rng.random() < 0.8 else None)


def test_budget_against_levels_with_rewind(spark):
    from bellwether import schemas

    rng = random.Random(11)
    rows = [_document(rng, i) for i in range(120)]
    df = spark.createDataFrame(rows, f"record_id bigint, company_name string, ticker string, date_range struct<start:string,end:string>, stock_data {schemas.SERIES}, latest_10k {schemas.REPORT}, latest_10q {schemas.REPORT}, eight_k_reports array<{schemas.REPORT}>, hacker_news_articles array<{schemas.ARTICLE}>")
    scored = documents.scored(df, documents.hash_score)
    for limit in (1, 8, 20, 60):
        x = documents.budget(scored, limit)
        done = {r.record_id: r for r in documents.apply_budget(x).withColumn("again", documents._total()).collect()}
        for r in x.collect():
            doc = rows[r.record_id]
            runs = lambda t: 0 if t is None else t.count(" ")
            sections = []
            for k, s in enumerate([doc[5], doc[6], *(doc[7] or [])]):
                s_id = min(k, 2)
                sections.append([((r.record_id * 31 + s_id * 7 + j) % 5 - 1, runs(t)) for j, t in enumerate(s[0]) if t is not None] if s else [])
            arts = [(a[4], runs(a[3]), sum(map(runs, (a[0], a[1], a[2], a[3])))) for a in doc[8] or []]
            total = 1 + 1 + sum(c for s in sections for _, c in s) + sum(a[2] for a in arts)
            assert r.total == total
            left, taken, minimal = _budget_by_rewind(sections, arts, limit, total)
            assert (r.final, len(r.applied), r.minimal) == (left, taken, minimal)
            if not minimal:
                assert done[r.record_id].again == r.final


def test_budget_by_another_count(spark):
    """The strategy of counting is a parameter: letters instead of white space."""
    df = documents.scored(spark.read.parquet("/root/testdata/sf0.001/company_docs.parquet"), documents.hash_score) if os.path.isdir("/root/testdata/sf0.001") else pytest.skip("no test tables")
    letters = lambda c: F.coalesce(F.length(c), F.lit(0))
    some = documents.apply_budget(documents.budget(df, 2000, letters)).where("not minimal and size(applied) > 0").drop("total")
    left = some.withColumn("total", documents._total(letters)).select("final", "total").collect()
    assert left and all(r.final == r.total <= 2000 for r in left)


def test_news(spark):
    df = spark.createDataFrame([("s", f"2024-01-{i:02}", i) for i in range(1, 31)] + [("s", "", 99), ("s", None, 98), ("t", None, 1)], "s string, d string, i int")
    got = news.newest(df, "s", "d", "i", 3).collect()
    assert sorted(r.i for r in got if r.s == "s") == [28, 29, 30] and [r.i for r in got if r.s == "t"] == [1]


ARTICLES = "article_id bigint, title string, url string, publish_date string, points bigint, num_comments bigint"


def test_search(spark):
    rows = [(1, "Acme Grain Works opens", "a", "2024-01-01", 1, 0), (2, "works of ACME, and grain", "b", "2024-01-03", 0, 0), (3, "Acme only", "c", "2024-01-02", 1, 1), (4, None, "d", "2024-01-02", 1, 1), (5, "grain acme works", "e", None, 1, 1)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], ARTICLES + ", query string")
    asked = spark.createDataFrame([(1, "acme grain works"), (2, "ACME"), (3, "acme nowhere"), (4, ""), (5, None), (1, "acme grain works")], "query_id int, query string")
    got = sorted((r.query_id, r["rank"], r.article_id) for r in news.search(df.drop("query"), asked).collect())
    assert got == [(1, 1, 2), (1, 2, 1), (1, 3, 5), (2, 1, 2), (2, 2, 3), (2, 3, 1), (2, 4, 5)]
    assert [(r.query_id, r.article_id) for r in news.search(df, asked, 1, "2024-01-02", "2024-01-02").collect()] == [(2, 3)]
    assert news.search(df.limit(0), asked).count() == 0 and news.search(df, asked.limit(0)).count() == 0


def _cascade_by_loop(rows, company, wanted):
    """The widening searches of one company, one after the other."""
    name, ticker, industry, rivals = company
    words = lambda t: set(re.findall(r"[a-z0-9]+", (t or "").lower()))
    out, seen = [], set()

    def ask(query, room, tier):
        if not words(query):
            return
        hits = sorted((r for r in rows if words(query) <= words(r[1])), key=lambda r: (r[3] or "", r[0]), reverse=True)
        for r in hits[: min(room, wanted)]:
            if (r[4] or r[5]) and r[2] and r[2] not in seen:
                seen.add(r[2])
                out.append((tier, r[0]))

    ask(name, wanted, 1)
    if len(out) < wanted * 0.5 and ticker and len(ticker) >= 3:
        ask(f"{ticker} {name}", wanted - len(out), 2)
    if len(out) < wanted * 0.3:
        left = wanted - len(out)
        if industry:
            ask(industry, left // 2, 3)
            main = [w for w in industry.split() if w.lower() not in news.MODIFIERS]
            if len(out) < wanted * 0.3 and " " in industry and main and main[-1] != industry:
                ask(main[-1], left // 2, 4)
        if rivals and len(out) < wanted * 0.5:
            some, left = rivals[:3], wanted - len(out)
            for k, rival in enumerate(some):
                if len(out) >= wanted:
                    break
                ask(rival, left // len(some), 5 + k)
    return out[:wanted]


def test_cascade_against_a_loop(spark):
    rng = random.Random(4)
    vocabulary = "acme grain works energy costs pricing board abcd xy".split()
    rows = [(i, " ".join(rng.sample(vocabulary, rng.randrange(1, 5))), rng.choice(["", f"u{i % 70}"]), f"2024-01-{rng.randrange(1, 29):02d}", rng.choice([0, 1]), rng.choice([0, None, 2])) for i in range(160)]
    companies = [(f"k{i}", rng.choice(["acme", "acme grain works", "grain works energy costs", "nobody", None]), rng.choice(["abcd", "xy", None]), rng.choice(["general pricing", "energy costs", "specialty", "unknown trade", None]), rng.choice([None, [], ["board"], ["works acme", "nobody", "pricing", "energy"]])) for i in range(40)]
    df = spark.createDataFrame(rows, ARTICLES)
    firms = spark.createDataFrame(companies, "key string, name string, ticker string, industry string, competitors array<string>")
    for wanted in (4, 12):
        got = {}
        for r in sorted(news.cascade(df, firms, wanted).collect(), key=lambda r: (r.key, r["rank"])):
            got.setdefault(r.key, []).append((r.tier, r.article_id))
        want = {k: x for k, *c in companies if (x := _cascade_by_loop(rows, (c[0] or "", c[1], c[2], c[3]), wanted))}
        assert got == want
    assert news.cascade(df.limit(0), firms, 5).count() == 0


def test_preference(spark):
    assert preference.read_candidate('{"output": {"next_day_direction": "1", "next_day_closing_price": "2.5"}}') == (True, 1, 2.5)
    assert preference.read_candidate('{"output": {"next_day_direction": true, "next_day_closing_price": 1}}') == (False, None, None)
    assert preference.read_candidate(None) == (False, None, None)
    cases = [(True, True, 0.1, True, True, 0.1, 2), (True, False, 0.1, True, True, 9.0, 2), (True, True, 0.1, True, True, 0.2, 1), (False, False, None, True, False, 1.0, 2), (True, False, None, True, False, 1.0, 2), (False, False, None, False, False, None, 0)]
    df = spark.createDataFrame(cases, "v1 boolean, r1 boolean, e1 double, v2 boolean, r2 boolean, e2 double, want int")
    assert all(r.got == r.want for r in df.withColumn("got", preference.winner(*(F.col(c) for c in ("v1", "r1", "e1", "v2", "r2", "e2")))).collect())


def test_metrics_bounds_and_gate(spark):
    rows = [("m", 1, 1, 0.7, 0.2, 0.1, 10.0, 10.0, 0.0), ("m", -1, 1, 0.1, 0.8, 0.1, 11.0, 10.0, 0.1), ("m", None, 0, None, None, None, None, 9.0, None), ("one", 1, 1, 1.0, 0.0, 0.0, 5.0, 5.0, 0.0)]
    df = spark.createDataFrame(rows, "model string, pred_direction int, actual_direction int, p_up double, p_down double, p_unchanged double, pred_price double, next_close double, ape double")
    df = df.withColumn("brier", scoring.brier(F.col("p_up"), F.col("p_down"), F.col("p_unchanged"), F.col("actual_direction"))).withColumn("rps", scoring.ranked_probability(F.col("p_down"), F.col("p_unchanged"), F.col("actual_direction")))
    assert all(r.brier is None or 0 <= r.brier <= 2 and 0 <= r.rps <= 2 for r in df.collect())
    got = {r.model: r for r in scoring.metric_suite(df, [["model"]]).collect()}
    assert got["one"].accuracy is None and got["m"].accuracy is None  # one class happened among labelled rows
    assert got["m"].rmse == pytest.approx(np.sqrt(0.5))


def test_simulation_edges(spark):
    rows = [("m", "A", D(2024, 1, 1), 1, 0.01), ("m", "B", D(2024, 1, 1), 0, 0.5), ("m", "A", D(2024, 1, 3), 0, 0.2)]
    df = spark.createDataFrame(rows, "model string, symbol string, d date, position int, intraday double")
    r = backtest.simulate(df).first()
    rate = 1.04 ** (1 / 252) - 1
    rets = [(0.01 - 0.0005) / 2, rate, 0.0]
    assert r.annual_return == pytest.approx(np.prod([1 + x for x in rets]) ** (252 / 3) - 1) and r.max_drawdown == 0
    assert backtest.simulate(df.limit(0)).count() == 0


def _risk_by_day(days, buy, sell):
    cash, shares, path = 100_000.0, 0.0, [100_000.0]
    for before, (_, close) in zip([None, *days], days):
        if before and close > before[1]:
            if cash > 1:
                cash, shares = cash - cash * buy, shares + cash * buy / close
        elif shares > 0:
            cash, shares = cash + shares * sell * close, shares - shares * sell
        path.append(cash + shares * close)
    steps, top = np.diff(path) / path[:-1], np.maximum.accumulate(path)
    annual = (path[-1] / path[0]) ** (365 / (days[-1][0] - days[0][0]).days) - 1
    return [annual, ((top - path) / top).max(), steps.mean() / steps.std(ddof=1) * 252**0.5]


def test_risk_profiles_of_all_days(spark, tmp_path):
    rng = np.random.default_rng(3)
    spans = {"OLD": D(2020, 3, 2), "LONG": D(2023, 9, 1), "NEW": D(2025, 1, 6)}  # none, a part and none of the first half of 2024
    series = {s: [(a + dt.timedelta(days=i), float(c)) for i, c in enumerate(np.round(50 * np.exp(np.cumsum(rng.normal(0, 0.03, 400 if s == "LONG" else 30))), 2))] for s, a in spans.items()}
    rows = [(n, s, d, c) for n, (s, d, c) in enumerate((s, d, c) for s, days in series.items() for d, c in days)]
    raw = spark.createDataFrame(rows, "bar_id bigint, ticker string, bar_date date, close_price double").withColumns({**{f"{k}_price": F.col("close_price") for k in ("open", "high", "low")}, "volume": F.lit(1).cast("bigint"), "stock_splits": F.lit(0.0), "fetched_at": F.lit("2025-10-01").cast("timestamp")})
    raw.write.parquet(f"{tmp_path}/price_bars.parquet")
    columns = ("annual_return", "max_drawdown", "sharpe")
    got = {(r.profile, r.symbol): [r[c] for c in columns] for r in evaluation.QUERIES["q_risk_profiles"](spark, str(tmp_path)).collect()}
    want = {(k, s): _risk_by_day(days, *o) for k, o in backtest.PROFILES.items() for s, days in series.items()}
    assert got == {k: pytest.approx(v, abs=2e-6) for k, v in want.items()}
    means = {r.profile: [r[c] for c in columns] for r in evaluation.QUERIES["q_risk_profile_means"](spark, str(tmp_path)).collect()}
    assert means == {k: pytest.approx(np.mean([want[k, s] for s in series], axis=0).tolist(), abs=2e-6) for k in backtest.PROFILES}


def test_risk_profiles_of_a_long_path(spark):
    rng = np.random.default_rng(5)
    closes = np.round(50 * np.exp(np.cumsum(rng.normal(0, 0.01, 4000))), 2).tolist()
    days = [(D(2010, 1, 1) + dt.timedelta(days=i), c) for i, c in enumerate(closes)]
    rows = spark.createDataFrame([("S", d, c, int(i > 0 and c > closes[i - 1])) for i, (d, c) in enumerate(days)], "symbol string, d date, close double, prediction int")
    df = backtest.risk_profiles(rows)
    got = {r.profile: [r.annual_return, r.max_drawdown, r.sharpe] for r in df.collect()}
    assert got == {k: pytest.approx(_risk_by_day(days, *o), abs=2e-6) for k, o in backtest.PROFILES.items()}
    # The fold's state doesn't grow: no day copies the days before it.
    assert "concat(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_article_tasks_keep_4000_words(spark):
    report = "struct<paragraphs: array<string>>"
    text = [" ".join(f"w{i}" for i in range(n)) for n in (201, 4000, 4001)]
    docs = spark.createDataFrame([(1, None, None, [], [(t,) for t in text])], f"record_id bigint, latest_10k {report}, latest_10q {report}, eight_k_reports array<{report}>, hacker_news_articles array<struct<text: string>>")
    got = {r.place: r.text for r in documents.explode_tasks(docs).collect()}
    assert got == {0: text[0], 1: text[1], 2: text[1]}


def test_exact_median(spark):
    rng = np.random.default_rng(1)
    data = {"a": rng.exponential(size=501), "b": rng.exponential(size=40), "c": np.zeros(6), "d": np.array([0.5, 0.5, 2.0, 2.0]), "e": np.array([3.0])}
    rows = [(k, float(x)) for k, v in data.items() for x in v] + [("f", None), (None, 1.0)]
    got = {r.k: r.median for r in exact_median(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert got == {k: pytest.approx(float(np.median(v)), rel=1e-15) for k, v in data.items()}
    assert exact_median(spark.createDataFrame([], "k string, v double"), "k", "v").count() == 0


def test_exact_median_of_infinity_and_no_number(spark):
    inf, nan = float("inf"), float("nan")
    data = {"a": [1.0, inf, nan], "b": [1.0, 2.0, inf], "c": [0.0, 3.0, 2.0, nan], "d": [1.0, nan], "e": [inf, inf], "f": [nan], "g": [2.0, inf]}
    rows = [(k, v) for k, values in data.items() for v in values]
    got = {r.k: str(r.median) for r in exact_median(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert got == {"a": "inf", "b": "2.0", "c": "2.5", "d": "nan", "e": "inf", "f": "nan", "g": "inf"}


def test_normal_moves_skip_no_numbers(spark):
    nan = float("nan")
    rows = [(1, "A", [1.0, 2.0, nan, nan, nan, 4.0, 5.0])]
    got = {r.ticker: r.scale for r in spikes.normal_moves(spark.createDataFrame(rows, "record_id bigint, ticker string, close array<double>")).collect()}
    assert got == {"A": pytest.approx(0.625)}


def _spikes_by_rule(series, scale):
    o, h, lo, c, v = (series[f] or [] for f in spikes.FIELDS)
    n = max(map(len, (o, h, lo, c, v)), default=0)
    at = lambda s, i: s[i] if 0 <= i < len(s) else None
    out = {}

    def run(s, i):
        if at(s, i) is None:
            return 0
        a = b = i
        while a > 0 and at(s, a - 1) == s[i]:
            a -= 1
        while at(s, b + 1) == s[i]:
            b += 1
        return b - a + 1

    for i in range(n):
        p = {f: at(s, i) for f, s in zip("ohlcv", (o, h, lo, c, v), strict=True)}
        lt = lambda x, y: x is not None and y is not None and x < y
        if any(p[f] is not None and p[f] <= 0 for f in "ohlc") or lt(p["v"], 0) or lt(p["h"], p["l"]) or any(lt(p["h"], p[f]) or lt(p[f], p["l"]) for f in "oc"):
            out[i] = "impossible"
        elif max(run(c, i), run(v, i)) >= 6:
            out[i] = "stuck"
        else:
            for s in (o, h, lo, c):
                x, y, z = at(s, i - 1), at(s, i), at(s, i + 1)
                if None in (x, y, z) or x <= 0 or z <= 0 or scale is None:
                    continue
                if (y > x and y > z or y < x and y < z) and abs(y / x - 1) > 8 * scale and abs(y / z - 1) > 8 * scale:
                    out[i] = "spike"
    return out


def _series(rng, n):
    base = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    s = {f: [round(float(x), 2) for x in base] for f in ("open", "high", "low", "close")}
    s["high"] = [x + 1 for x in s["high"]]
    s["low"] = [x - 1 for x in s["low"]]
    s["volume"] = [float(x) for x in rng.integers(100, 10**6, n)]
    for _ in range(rng.integers(0, 6)):
        i, f = int(rng.integers(n)), str(rng.choice(spikes.FIELDS))
        s[f][i] = rng.choice([None, -1.0, 0.0, s[f][i] and s[f][i] * 1.6])
        s[f][i] = None if s[f][i] is None else float(s[f][i])
    if rng.random() < 0.4:
        i, k = int(rng.integers(n)), int(rng.integers(3, 9))
        for j in range(i, min(n, i + k)):
            s["close"][j] = s["close"][i]
    if rng.random() < 0.2:
        s["volume"] = s["volume"][: n // 2]
    return s


def test_spikes_against_the_rules(spark):
    from bellwether import schemas

    rng = np.random.default_rng(7)
    rows = []
    for i in range(60):
        a, b = _series(rng, int(rng.integers(1, 60))), _series(rng, int(rng.integers(1, 30)))
        rows.append((i, ["X", "Y", None][i % 3], tuple(a[f] for f in spikes.FIELDS), None if i % 7 == 0 else tuple(b[f] for f in spikes.FIELDS), "clash"))
    rows += [(100, "X", None, None, ""), (101, "X", ([], [], [], [], []), (None,) * 5, ""), (102, "Q", ([1.0], None, None, [5.0], None), None, "")]
    df = spark.createDataFrame(rows, f"record_id bigint, ticker string, stock_data {schemas.SERIES}, future_stock_data {schemas.SERIES}, series string")
    moves = {}
    for _, ticker, *both, _ in rows:
        for s in both:
            c = s[3] if s else None
            for x, y in zip(c or [], (c or [])[1:], strict=False):
                if x and y is not None:
                    moves.setdefault(ticker, []).append(abs(y / x - 1))
    want = set()
    for rid, ticker, *both, _ in rows:
        for name, s in zip(("stock_data", "future_stock_data"), both, strict=True):
            if s:
                scale = float(np.median(moves[ticker])) if ticker in moves and ticker else None
                want |= {(rid, name, i, k) for i, k in _spikes_by_rule(dict(zip(spikes.FIELDS, s, strict=True)), scale).items()}
    flags = spikes.flag_readings(df).collect()
    got = [(r.record_id, r.series, r.pos, r.kind) for r in flags if r.kind]
    assert len(got) == len(set(got)) and set(got) == want and {k for *_, k in got} == {"impossible", "stuck", "spike"}
    assert all(0.5 <= r.p_abnormal <= 1 and r.state in spikes.STATES[1:] for r in flags)
    assert spikes.flag_readings(df.limit(0)).count() == 0


def test_the_model_finds_what_no_rule_names(spark):
    """A run of four and a move of six normal moves are under the rules' bounds; a calm series has no flag."""
    from bellwether import schemas

    rng = np.random.default_rng(11)
    rows = []
    for i in range(30):
        c = [float(x) for x in 100 * np.exp(np.cumsum(rng.choice([-0.01, 0.01], 120)))]
        if i == 1:
            c[40:44] = [c[40]] * 4
        if i == 2:
            c[60] = max(c[59], c[61]) * 1.06
        rows.append((i, "X", (c, [x * 1.001 for x in c], [x * 0.999 for x in c], c, [float(x) for x in rng.integers(1, 10**9, 120)]), None))
    df = spark.createDataFrame(rows, f"record_id bigint, ticker string, stock_data {schemas.SERIES}, future_stock_data {schemas.SERIES}")
    got = {(r.record_id, r.pos, r.state, r.kind) for r in spikes.flag_readings(df).collect()}
    assert got == {(1, k, "stuck", None) for k in range(40, 44)} | {(2, 60, "spike", None)}


def test_transitions_are_trained_by_source():
    """A source that is often stuck comes to expect it; probabilities add up and stay positive."""
    n, t = 40, 60
    x = {f: np.cumsum(np.ones((n, t)), 1) + 50 for f in spikes.FIELDS}
    x["close"][:, 20:35] = x["close"][:, 20:21]
    for f in ("open", "high", "low"):
        x[f] = x["close"].copy()
    readings = spikes.Readings(x, np.full(n, 0.01))
    p, steps = spikes.posterior(readings.scores(), readings.valid, np.broadcast_to(spikes.TRANSITIONS, (n, 4, 4)))
    assert np.allclose(p.sum(2), 1) and np.allclose(steps.sum((1, 2)), t - 1)
    assert (p[:, 22:33, 2] > 0.99).all() and (p[:, :18, 0] > 0.9).all()
    assert (steps[:, 2, 2] > 10).all()


def test_nested(spark):
    import json

    doc = {"stock_data": {"open": [1, 2, None], "close": [1.5]}, "latest_10k": json.dumps({"paragraphs": ["a", None, {"text": "b", "score": 2}]}), "eight_k_reports": [None, {"report": "r"}, {"paragraphs": json.dumps(["x", {"text": "y"}])}], "hacker_news_articles": [{"title": "t"}, None, json.dumps({"title": "u"})], "latest_10q": {"paragraphs": ["never"]}}
    rows = [(1, json.dumps(doc)), (2, "not json"), (3, None), (4, "[]"), (5, "null"), (6, json.dumps({"past_stock_data": {"low": [1]}, "eight_k_reports": {"paragraphs": ["p"]}, "latest_10k": {"report": "whole"}})), (7, "{}"), (8, json.dumps(json.dumps(doc))), (9, "")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "raw_id bigint, payload string, child_kind string")
    got = nested.flatten_documents(df).collect()
    cells = lambda i: sorted((r.child_kind, r.parent_pos, r.child_pos) for r in got if r.raw_id == i)
    want = [("article", 0, 0), ("article", 0, 2), ("bar", 0, 0), ("bar", 0, 1), ("bar", 0, 2), ("eight_k", 0, 1), ("eight_k", 0, 2), ("eight_k_paragraph", 1, 0), ("eight_k_paragraph", 2, 0), ("eight_k_paragraph", 2, 1), ("tenk_paragraph", 0, 0), ("tenk_paragraph", 0, 2)]
    assert cells(1) == want and cells(8) == want
    assert cells(6) == [("bar", 0, 0), ("eight_k", 0, 0), ("eight_k_paragraph", 0, 0), ("tenk_paragraph", 0, 0)]
    assert {r.raw_id for r in got} == {1, 6, 8}
    assert {(r.child_pos, r.text, r.score) for r in got if r.raw_id == 1 and r.child_kind == "tenk_paragraph"} == {(0, "a", None), (2, "b", 2)}
    assert nested.flatten_documents(df.limit(0)).count() == 0
    assert {r.child_kind for r in nested.flatten_documents(df, ("eight_k",)).collect()} == {"eight_k"}


def test_nested_shapes(spark):
    """Several annual reports, a null node beside another name of it, deep quoting, broken and doubled payloads, readings that are no numbers."""
    import json

    deep = {"latest_10k": [{"paragraphs": ["a"]}, None, {"report": "b"}, "bare"]}
    quoted = deep
    for _ in range(6):
        quoted = json.dumps(quoted)
    rows = [(1, json.dumps(deep)), (2, quoted), (3, '{"stock_data": null, "past_stock_data": {"close": [1, "x", true, 2.5]}}'), (4, json.dumps(deep) + " tail"), (5, json.dumps(deep)[:-3]), (6, '{"a": 1}, {"latest_10k": {"report": "x"}}'), (7, '  {"hacker_news_articles": ["[not json", {"text": {"a": 1}, "score": "high"}]}  ')]
    got = nested.flatten_documents(spark.createDataFrame(rows, "raw_id bigint, payload string")).collect()
    cells = lambda i: sorted((r.child_kind, r.parent_pos, r.child_pos) for r in got if r.raw_id == i)
    assert cells(1) == cells(2) == [("tenk_paragraph", 0, 0), ("tenk_paragraph", 2, 0)]
    assert [r.close for r in sorted((r for r in got if r.raw_id == 3), key=lambda r: r.child_pos)] == [1.0, None, None, 2.5]
    assert {r.raw_id for r in got} == {1, 2, 3, 7}
    assert {(r.child_pos, r.text, r.score) for r in got if r.raw_id == 7} == {(0, "[not json", None), (1, '{"a":1}', None)}


def test_global_row_numbers(spark):
    df = spark.range(0, 1000).selectExpr("id", "id % 7 as g").repartition(5)
    got = ranking.global_row_number(df, ["g", "id"]).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.rn)] == [x for _, x in sorted((i % 7, i) for i in range(1000))]
    assert ranking.chunks(df.limit(0), ["g", "id"], 3).count() == 0
    assert {r["count"] for r in ranking.shards(df, ["id"], 4).groupBy("shard").count().collect()} == {250}


def test_business_days(spark):
    r = spark.createDataFrame([(D(2024, 1, 5), D(2024, 1, 9)), (D(2024, 1, 2), D(2024, 1, 1)), (None, D(2024, 1, 1))], "a date, b date")
    got = [x[0] for x in r.select(bars.business_days(F.col("a"), F.col("b"))).collect()]
    assert got == [[D(2024, 1, 5), D(2024, 1, 8), D(2024, 1, 9)], [], None]


def test_join_counted_keeps_results(spark):
    a, b = spark.range(10), spark.range(5).withColumn("x", F.lit(1))
    assert join_counted(a, b, "id").count() == join_counted(a, b, "id", rows=1).count() == 5
    assert materialize(a).count() == 10
