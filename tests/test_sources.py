import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from bellwether.sources import files, remote, sinks
from bellwether.sources.remote import PagedReader, PagedSource, TokenBucket, with_retries
from bellwether.streaming import incremental


def fetch(key, options):
    return [(key, f"{key}-{i}") for i in range(2)]


def test_json_documents_and_corrupt_ones(spark, tmp_path):
    (tmp_path / "A_20240101_data.json").write_text(json.dumps({"ticker": "A", "hacker_news_articles": [{"title": "é"}]}, indent=2))
    (tmp_path / "B_20240101_data.json").write_text("{broken")
    got = {r.file_name: r for r in files.json_documents(spark, str(tmp_path)).collect()}
    assert got["A_20240101_data.json"].hacker_news_articles[0].title == "é" and got["A_20240101_data.json"]._corrupt_record is None
    assert got["B_20240101_data.json"]._corrupt_record is not None


def test_text_csv_and_symbols(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/x.txt").write_text("a\nb")
    assert files.text_files(spark, str(tmp_path / "t")).first().text == "a\nb"
    (tmp_path / "n.csv").write_text('Stock_symbol,Title\nA,"one\ntwo"\nB,x\n')
    rows = files.symbols_of(files.csv_table(spark, str(tmp_path / "n.csv"), "Stock_symbol string, Title string", multi_line=True), ["A"]).collect()
    assert [r.Title for r in rows] == ["one\ntwo"]
    (tmp_path / "big.csv").write_text("Stock_symbol,Title\n" + "".join(f"S{i},title {i}\n" for i in range(20_000)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    big = files.csv_table(spark, str(tmp_path / "big.csv"), "Stock_symbol string, Title string")
    assert big.count() == 20_000 and big.rdd.getNumPartitions() > 2
    spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_registry_index_and_feed(spark):
    df = spark.createDataFrame([(json.dumps({"0": {"cik_str": 7, "ticker": "A", "title": "Acme"}}),)], "text string")
    assert files.registry(df).first().cik_str == 7
    index = {"filings": {"recent": {"accessionNumber": ["1", "2"], "form": ["10-K"], "primaryDocument": ["a", "b"], "filingDate": ["2024-01-02", "bad"]}}}
    got = files.filing_index(spark.createDataFrame([(json.dumps(index),)], "text string")).orderBy("accession").collect()
    assert [r.form for r in got] == ["10-K", None] and got[1].filed is None
    feed = spark.createDataFrame([("x CIK=123& CIK=123 <cik>9</cik>",)], "text string")
    assert {r.cik: r.n for r in files.cik_candidates(feed).collect()} == {"0000000123": 2, "0000000009": 1}


def test_cik_of_a_feed(spark):
    entry = lambda cik, day: f"<entry><filing-date>{day}</filing-date><a href='?CIK={cik}'/></entry>"
    feeds = [("late", entry(5, "2024-05-01") + entry(7, "2023-05-01") + entry(5, "2024-06-01")), ("none", entry(5, "2024-05-01") + entry(7, "2024-05-01") + entry(7, "2024-05-02")), ("plain", "<cik>12</cik>"), ("empty", "")]
    got = {r.k: r.cik for r in files.cik_before(spark.createDataFrame(feeds, "k string, text string"), "2024-01-01", "k").collect()}
    assert got == {"late": "0000000007", "none": "0000000007", "plain": "0000000012", "empty": None}


def test_membership_page(spark):
    page = "<table><tr><th>Symbol</th></tr><tr><td>A</td></tr></table><table><tr><th>Date</th></tr><tr><td>March 1, 2024</td><td>B</td><td>Bee</td><td>C</td><td>Cee</td><td>why</td></tr></table>"
    current, changes = files.membership(spark, page)
    assert [r.ticker for r in current.collect()] == ["A"]
    assert sorted((r.kind, r.ticker, str(r.d)) for r in changes.collect()) == [("Added", "B", "2024-03-01"), ("Removed", "C", "2024-03-01")]
    with pytest.raises(ValueError):
        files.membership(spark, "<p></p>")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A.B", "2024-01-02", None, ["x", "y"])], "ticker string, as_of string, n int, parts array<string>").withColumn("as_of", F.to_date("as_of"))
    assert sinks.compact_json(df.select("ticker", "n"), ["ticker"]).first().json == '{"n":null}'
    sinks.write_documents(df, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).first().symbol == "A_B"
    sinks.write_by_symbol(df.select(F.col("ticker").alias("symbol"), "n"), str(tmp_path / "s"))
    assert (tmp_path / "s/symbol=A.B").is_dir()
    sinks.write_split(spark.range(3), "id > 0", str(tmp_path / "g"), str(tmp_path / "b"))
    assert spark.read.json(str(tmp_path / "g")).count() == 2 and spark.read.json(str(tmp_path / "b")).count() == 1
    sinks.write_lines(df.select("n"), str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).first().value == '{"n":null}'
    sinks.write_texts(df, str(tmp_path / "x"), "parts")
    assert sinks.unprocessed(spark.range(3), spark.range(1), "id").count() == 2


def test_token_bucket_and_retries():
    now, naps = [0.0], []

    def sleep(s):
        naps.append(s)
        now[0] += s

    b = TokenBucket(10, 2, clock=lambda: now[0], sleep=sleep)
    for _ in range(4):
        b.take()
    assert sum(naps) == pytest.approx(0.2)
    # A refusal makes it hold off: as long as asked, else five seconds, then twice as long.
    b.slow_down(3.0)
    assert b.take(timeout=1.0) is None and b.take() == pytest.approx(3.0, abs=0.2)
    b.slow_down()
    b.slow_down()
    assert b.take() == pytest.approx(10.0, abs=0.2)
    b.slow_down()
    assert b.take() == pytest.approx(5.0, abs=0.2)
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert with_retries(flaky, 3, sleep=lambda s: None) == "ok"
    with pytest.raises(OSError):
        with_retries(lambda: (_ for _ in ()).throw(OSError()), 2, sleep=lambda s: None)


def test_errors_are_told_apart():
    class Response:
        def __init__(self, status, headers=None):
            self.status_code, self.headers = status, headers or {}

    class HTTPError(Exception):
        def __init__(self, response):
            super().__init__("failed")
            self.response = response

    refused, gone, broken = HTTPError(Response(429, {"Retry-After": "7"})), HTTPError(Response(404)), HTTPError(Response(503))
    assert remote.is_refusal(refused) and remote.asked_pause(refused) == 7 and remote.is_refusal(ValueError("Too Many Requests")) and not remote.is_refusal(broken)
    assert [remote.is_passing(e) for e in (refused, gone, broken, TimeoutError(), ValueError("x"))] == [True, False, True, True, False]
    calls, now = [], [0.0]

    def sleep(s):
        now[0] += s

    def call():
        calls.append(now[0])
        if len(calls) == 1:
            raise refused
        return "ok"

    bucket = TokenBucket(100, 5, clock=lambda: now[0], sleep=sleep)
    assert with_retries(call, sleep=lambda s: None, bucket=bucket) == "ok" and calls[1] - calls[0] == pytest.approx(7.0)
    with pytest.raises(HTTPError):
        with_retries(lambda: (_ for _ in ()).throw(gone), 3, sleep=lambda s: pytest.fail("no second try"))


def test_hosts_wait_for_themselves_only():
    now = [0.0]

    def sleep(s):
        now[0] += s

    limiter = remote.HostLimiter(7.0, 3.0, clock=lambda: now[0], sleep=sleep, draw=lambda: 1.0)
    assert [limiter.take(u) for u in ("https://a.example/x", "https://b.example/x", "https://A.example/y", "https://b.example/z")] == [0.0, 0.0, 10.0, 0.0]
    assert limiter.take("a.example/plain") == pytest.approx(10.0)


def test_archived_indexes(spark):
    import json

    arrays = lambda *rows: dict(zip(("form", "filingDate", "accessionNumber", "primaryDocument"), map(list, zip(*rows, strict=True)), strict=True))
    main = {"filings": {"recent": arrays(("10-K", "2022-03-01", "n1", "d1"), ("8-K", "2022-01-01", "n2", "d2")), "files": [{"name": "old.json", "filingFrom": "2000-01-01", "filingTo": "2019-12-31"}, {"name": "late.json", "filingFrom": "2020-01-01", "filingTo": "2021-12-31"}]}}
    old, late = arrays(("10-k", "2018-05-01", "o1", "x1"), ("10-K", "2019-05-01", "o2", "x2")), arrays(("10-K", "2021-05-01", "l1", "y1"))
    indexes = spark.createDataFrame([("1", json.dumps(main)), ("2", "no json")], "cik string, text string")
    older = spark.createDataFrame([("old.json", json.dumps(old)), ("late.json", json.dumps(late))], "name string, text string")
    asked = spark.createDataFrame([("1", "10-K", dt.date(2023, 1, 1)), ("1", "10-K", dt.date(2020, 6, 1)), ("1", "8-K", None), ("1", "10-Q", None), ("2", "10-K", None)], "cik string, form string, before date")
    got = {(r.cik, r.form, r.before): r.accession for r in files.latest_filing(indexes, older, asked).collect()}
    # The archive that goes beyond the date is not read.
    assert got == {("1", "10-K", dt.date(2023, 1, 1)): "n1", ("1", "10-K", dt.date(2020, 6, 1)): "o2", ("1", "8-K", None): "n2"}


def test_registry_refresh_keeps_a_backup(spark, tmp_path):
    path = str(tmp_path / "registry.json")
    entry = lambda t: '{"0": {"cik_str": 1, "ticker": "%s", "title": "T"}}' % t
    assert files.refresh_registry(spark, path, lambda: entry("A")).first().ticker == "A"
    assert files.refresh_registry(spark, path, lambda: entry("B")).first().ticker == "B"
    assert '"A"' in open(path + ".backup").read() and '"B"' in open(path).read()
    assert files.refresh_registry(spark, path, lambda: 1 / 0) is None and files.refresh_registry(spark, path, lambda: "{}") is None and '"B"' in open(path).read()


def test_copies_by_symbol(spark, tmp_path):
    (tmp_path / "from").mkdir()
    (tmp_path / "from/AAA.csv").write_text("1")
    (tmp_path / "from/bbb.csv").write_text("2")
    df = spark.createDataFrame([("aaa",), ("BBB",), ("ccc",), (None,)], "symbol string")
    run = lambda **k: {r.symbol: r.status for r in sinks.copy_by_symbol(df, str(tmp_path / "from"), str(tmp_path / "to"), **k).collect()}
    assert run() == {"aaa": "copied", "BBB": "copied_lower", "ccc": "missing"} and (tmp_path / "to/BBB.csv").read_text() == "2"
    (tmp_path / "from/AAA.csv").write_text("9")
    assert run() == {"aaa": "skipped", "BBB": "skipped", "ccc": "missing"} and (tmp_path / "to/AAA.csv").read_text() == "1"
    assert run(overwrite=True)["aaa"] == "copied" and (tmp_path / "to/AAA.csv").read_text() == "9"


def test_remembered_values(spark, tmp_path):
    asked = []

    def compute(keys):
        asked.append(sorted(r.k for r in keys.collect()))
        return keys.where("k <> 'none'").withColumn("v", F.length("k"))

    path = str(tmp_path / "memo")
    run = lambda *ks: {r.k: r.v for r in sinks.remembered(spark.createDataFrame([(k,) for k in ks], "k string"), path, ["k"], compute).collect()}
    assert run("a", "bb", "none") == {"a": 1, "bb": 2} and run("bb", "ccc", "none") == {"bb": 2, "ccc": 3}
    assert asked == [["a", "bb", "none"], ["ccc", "none"]]


def test_paged_source(spark):
    reader = PagedReader({"keys": "a,b,c", "partitions": "2", "fetch": "tests.test_sources:fetch", "kind": "prices"}, None)
    parts = reader.partitions()
    assert sorted(r for p in parts for r in reader.read(p)) == [(k, f"{k}-{i}") for k in "abc" for i in range(2)]
    spark.dataSource.register(PagedSource)
    df = spark.read.format("paged").option("keys", "a,b").option("fetch", "tests.test_sources:fetch").load()
    assert df.count() == 4


def test_incremental_runs_take_new_files_only(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"k": "a", "v": 1}\n')
    run = lambda: incremental.process_new(spark, str(src), "k string, v int", lambda df: df.withColumn("w", F.col("v") * 2), str(tmp_path / "out"), str(tmp_path / "state"))
    run()
    (src / "2.json").write_text('{"k": "b", "v": 2}\n')
    run()
    run()
    assert sorted(r.w for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 4]
    stream = spark.readStream.schema("k string, v int").json(str(src))
    incremental.append_by_key(stream, "k", str(tmp_path / "by"), str(tmp_path / "state2"))
    assert (tmp_path / "by/batch=0/k=a").is_dir() and spark.read.parquet(str(tmp_path / "by")).count() == 2


def test_bars_keep_their_state_bounded(spark, tmp_path):
    """Over several runs late events are dropped once the watermark has passed, and bars are read back whole."""
    schema = "ts timestamp, event_type string, value double"
    events = lambda n, *rows: spark.createDataFrame([(dt.datetime.fromisoformat(t), k, v) for t, k, v in rows], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    run = lambda: sorted((str(r.start)[:10], r.event_type, r.open, r.close, r.n) for r in incremental.run_bars(spark, str(tmp_path / "in/*"), schema, str(tmp_path / "out")).collect())
    events(1, ("2024-01-01T10:00", "a", 1.0), ("2024-01-01T11:00", "a", 2.0))
    assert run() == [("2024-01-01", "a", 1.0, 2.0, 2)]
    events(2, ("2024-01-01T09:00", "a", 3.0), ("2024-02-01T09:00", "a", 4.0))
    assert run() == [("2024-01-01", "a", 3.0, 2.0, 3), ("2024-02-01", "a", 4.0, 4.0, 1)]
    events(3, ("2024-01-01T08:00", "a", 9.0), ("2024-02-01T10:00", "a", 5.0))
    assert run() == [("2024-01-01", "a", 3.0, 2.0, 3), ("2024-02-01", "a", 4.0, 5.0, 2)]
