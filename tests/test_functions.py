from pyspark.sql import Row
from pyspark.sql import functions as F

from bellwether.functions import dates, html, jsonx, prompts, text, tickers


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_html_order_of_steps():
    assert html.clean("&lt;p&gt;a&lt;/p&gt;<b>x</b>") == "a\nx"
    assert html.clean("<script>bad()</script><style>p{}</style>ok") == "ok"
    assert html.clean("<ix:hidden>secret</ix:hidden><xbrli:context id='a'>c</xbrli:context>seen") == "seen"
    assert html.clean("<h1>Title</h1><ul><li>a</li><li>b</li></ul>") == "Title\n\n• a\n• b"
    assert html.clean("<dl><dt>k</dt><dd>v</dd></dl>") == "k: v"
    assert html.clean(None) is None
    assert html.clean("") == ""


def test_html_tables():
    row = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    assert html.clean("<table>" + row("Sales", "$", "1,200", "", "(", "5.1", ")", "%") + "</table>") == "Sales | $ 1,200 | (5.1)%"
    assert html.clean("<table>" + row("a", "", "") + row("", "") + "</table>") == "a"
    assert html.clean("<table>" + row("Loss", "(46,446", ")") + "</table>") == "Loss | (46,446)"
    assert html.merge_cells(["7", ")%"]) == ["(7)%"]


def test_html_column_keeps_nulls(spark):
    df = spark.createDataFrame([(None,), ("<p>a</p>",)], "h string")
    assert [r[0] for r in df.select(html.clean_html(F.col("h"))).collect()] == [None, "a"]


def test_paragraphs(spark):
    long = " ".join(["w"] * 20)
    p = text.paragraphs(F.col("t"))
    assert one(spark, p, t=f"short\n\n{long}\n\nrest") == [f"short\n\n{long}", "rest"]
    assert one(spark, p, t="  \n\n ") == []
    assert one(spark, p, t="") == []
    assert one(spark, p, t=None) is None
    assert one(spark, text.count_words(F.col("t")), t="a b  c") == 3
    assert one(spark, text.count_words(F.col("t")), t=None) == 0


def test_words_and_scores(spark):
    assert one(spark, text.first_words(F.col("t"), 2), t="a  b c") == "a b"
    assert one(spark, text.first_words(F.col("t"), 3), t="a  b c") == "a  b c"
    assert one(spark, text.parse_score(F.col("t")), t="42") == 2
    assert one(spark, text.parse_score(F.col("t")), t="²9") == -1
    assert one(spark, text.parse_score(F.col("t")), t=None) == -1
    assert one(spark, text.parse_movement(F.col("t")), t="so I say RISE or fall") == 1
    assert one(spark, text.parse_movement(F.col("t")), t="rise a b c d e f") == 0
    assert one(spark, text.parse_movement(F.col("t")), t=None) == 0
    assert one(spark, text.humanize_billions(F.col("x")), x=1234567890.0) == "1.23B"
    assert one(spark, text.host(F.col("t")), t="https://a.example/x") == "a.example"
    assert one(spark, text.host(F.col("t")), t="nothing") is None


def test_names(spark):
    assert one(spark, tickers.simplify_name(F.col("t")), t="Acme Holdings Inc.") == "Acme"
    assert one(spark, tickers.simplify_name(F.col("t")), t="Acme Co Corporation") == "Acme"
    assert one(spark, tickers.strip_endings(F.col("t")), t="Acme, Inc.") == "Acme"
    assert one(spark, tickers.resolve_symbol(F.col("t")), t="Apple") == "AAPL"
    assert one(spark, tickers.resolve_symbol(F.col("t")), t="ABC") == "ABC"
    assert one(spark, tickers.resolve_symbol(F.col("t")), t="abc") == "ABC"
    assert one(spark, tickers.resolve_symbol(F.col("t")), t="Unknown Name") == "Unknown Name"
    assert one(spark, tickers.pad_cik(F.col("t")), t="12345678901") == "12345678901"
    assert one(spark, tickers.pad_cik(F.col("t")), t="123") == "0000000123"
    assert one(spark, tickers.parse_file_name(F.col("t")), t="A_B_20240828_data_run_1") == Row(ticker="A_B", date="20240828")
    assert one(spark, tickers.parse_file_name(F.col("t")), t="nodate") is None
    assert one(spark, tickers.run_group(F.col("t")), t="A_20240828_data_run_1") == "A_20240828"


def test_json_salvage():
    assert jsonx.candidates('"{\\"a\\": 1}"', "last") == [{"a": 1}]
    assert jsonx.candidates('x {"a": 1} y {"b": 2} {', "last") == [{"a": 1}, {"b": 2}]
    assert jsonx.candidates('"{\\"a\\": 1}"', "any") == ['{"a": 1}']
    assert jsonx.candidates("[1]", "any") == [[1]]
    assert jsonx.candidates('x {"a": {"b": 1}} y', "outer") == [{"a": {"b": 1}}]
    assert jsonx.candidates('{"a": 1} and {bad}', "outer") == [{"a": 1}]
    assert jsonx.candidates("nothing", "outer") == []
    assert jsonx.candidates(None, "last") == []


def test_validation():
    good = '{"next_day_direction": 1, "next_day_closing_price": 2, "forecast": {"up": 1, "down": 0, "unchanged": 0.0}}'
    wrapped = jsonx.validate(f" text {good} ")
    assert wrapped["valid"] and wrapped["chain_of_thought"] == f"text {good}" and wrapped["price"] == 2.0
    assert jsonx.validate('{"chain_of_thought": "c", "output": {"next_day_direction": true}}')["reason"] == "next_day_direction"
    assert jsonx.validate('{"chain_of_thought": "c", "output": ' + good.replace('"up": 1', '"up": "1"') + "}")["reason"] == "forecast.up"
    assert jsonx.validate(None) == {"valid": False, "reason": "no JSON"}
    assert jsonx.validate("[1]")["reason"] == "no object"


def test_ranges_and_days(spark):
    now = F.lit("2024-06-01").cast("timestamp")
    r = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(dates.checked_range(F.col("a"), F.col("b"), now)).first()[0]
    assert str(r("2024-01-01", "2024-12-31").end) == "2024-06-01" and r("2024-01-01", "2024-01-02").end_s - r("2024-01-01", "2024-01-02").start_s == 86400
    assert r("2024-02-01", "2024-01-01") is None and r("x", "2024-01-01") is None and r(None, None) is None
    assert one(spark, dates.story_day(F.col("t")), t="2024-01-02T23:30:00-02:00") == "2024-01-03"
    assert one(spark, dates.story_day(F.col("t")), t="soon") == "" and one(spark, dates.story_day(F.col("t")), t=None) == ""


def test_prompts(spark):
    df = spark.createDataFrame([("A", None, [1.0, 2.5], [])], "a string, b string, x array<double>, y array<double>")
    assert df.select(prompts.fill("{a}-{b}!", a=F.col("a"), b=F.col("b"))).first()[0] == "A-!"
    s = df.select(prompts.named_series({"x": F.col("x"), "y": F.col("y")}).alias("s"))
    assert s.select(prompts.series_notes(F.col("s"))).first()[0] == "x: Min: 1.0000, Max: 2.5000 <ts><ts/>"
    assert df.select(prompts.answer_text(F.col("b"), F.col("a"))).first()[0] == "A"
    out = prompts.with_model(df.select("a"), "a", lambda ps: [p.lower() for p in ps])
    assert out.first().answer == "a"
