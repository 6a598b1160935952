import base64
import itertools
import json
import os
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from bellwether.llm import encode, lines, lookalike, neardup, packing, pairs, queries, residue, truncation
from tests.compare import DATA, connect, rows_of_duckdb, rows_of_spark

VOCABULARY = encode.VOCABULARY
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no public tokenizers")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    cols, rows = rows_of_spark(queries.QUERIES[name](spark, DATA))
    if name in queries.SQL:
        want_cols, want = rows_of_duckdb(connect(), queries.SQL[name])
        assert cols == want_cols and rows == want
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))


# Problem 1


def _sets(rng, n):
    base = [f"e{i}" for i in range(300)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            s = set(rng.choice(out))
            for _ in range(rng.randrange(0, 12)):
                (s.discard if rng.random() < 0.5 else s.add)(rng.choice(base))
        else:
            s = set(rng.sample(base, rng.choice([1, 2, 3, 5, 20, 60, 120])))
        out.append(sorted(s))
    return out


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_near_duplicates_against_all_pairs(spark, threshold):
    rng = random.Random(2)
    sets = _sets(rng, 150) + [[], None] + [["x", "y", "z"]] * 12
    df = spark.createDataFrame(list(enumerate(sets)), "record_id bigint, e array<string>").withColumn("rid", F.lit("clash")).withColumn("hs", F.lit(1))
    got = [tuple(r) for r in neardup.near_duplicates(df, "record_id", F.coalesce("e", F.array().cast("array<string>")), threshold).collect()]
    want = set()
    for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2):
        if a and b and len(set(a) & set(b)) >= threshold * len(set(a) | set(b)) - 1e-9:
            want.add((i, j))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert neardup.near_duplicates(df.limit(0), "record_id", F.col("e")).count() == 0


def test_no_side_is_broadcast_unseen(spark):
    """The planner's estimates after checkpoints and Arrow functions are far too small: no join may trust them."""
    rng = random.Random(5)
    df = spark.createDataFrame(list(enumerate(_sets(rng, 60))), "record_id bigint, e array<string>")
    e = F.col("e")
    members, similar = neardup.similar_classes(df, "record_id", e, F.transform(e, lambda x: F.xxhash64(x)), 0.6)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for plan in (members, similar, neardup.near_duplicates(df, "record_id", e, 0.6)):
            assert "BroadcastHashJoin" not in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"


def test_record_elements(spark):
    from bellwether import schemas

    doc = lambda p, q, c, v: ((p, None) if p is not None else None, (q, None), (None, None, None, c, v))
    rows = [doc(["A b-c D", None, "a b", ""], ["a B c"], [1.0, 2.0, None], [10.0, None, 3.0]), doc(None, None, None, None)]
    df = spark.createDataFrame(rows, f"latest_10k {schemas.REPORT}, latest_10q {schemas.REPORT}, stock_data {schemas.SERIES}")
    got = [set(r[0]) for r in df.select(neardup.record_elements()).collect()]
    assert got == [{"a b c", "b c d", "=1.0|10.0", "=|3.0"}, set()]


def test_bands_cover_all_sizes():
    sizes = [s for b in range(0, neardup.band_of(2000)) for s in range(neardup.band_sizes(b)[0], neardup.band_sizes(b)[1] + 1)]
    assert sizes == list(range(1, len(sizes) + 1))
    bands = neardup.Bands(0.6)
    for a in range(1, 300):
        met = {b: d for b, d in bands.asked(a)}
        for b in range(1, a + 1):
            if b >= 0.6 * a:
                assert neardup.band_of(b) in met and 2 * bands.segments(neardup.band_of(b)) > bands.difference(a, b) and met[neardup.band_of(b)] >= bands.difference(a, b)


# Problems 2, 3, 4

FULL = [
    "The board reviewed the covenant package as churn settled. The lender group expanded spare capacity in the plateau.",
    "The lender group reviewed spare capacity as churn settled. The board expanded the covenant package in the plateau.",
    "The finance team put net debt at 12.5 million. The board reviewed spare capacity in the lower valley.",
    "In the lower valley, the board put net debt at 7.25 million as churn settled.",
]


def test_truncated(spark):
    whole = FULL * 4 + [t + "\n\n— north desk 4" for t in FULL] + [t + "\n\nTags: earnings" for t in FULL] + [t + ' "More to come."' for t in FULL]
    cut = ["The board reviewed the covenant pack", "The lender group expanded spare", "As churn settled, the board put net debt at 12.", "In the lower valley,", FULL[0] + " The finance te�", FULL[1] + " The board rev… [+120 chars]", FULL[2] + " The board reviewed the... (continued)", FULL[3] + " The lender gro <a hre"]
    rows = [(i, t) for i, t in enumerate(whole + cut)] + [(900, None), (901, ""), (902, " ​")]
    df = spark.createDataFrame(rows, "i int, x string").withColumn("text", F.lit("clash"))
    got = {r.i for r in truncation.truncated(df, ["i"], "x").collect()}
    assert got == set(range(len(whole), len(whole) + len(cut)))
    assert truncation.truncated(df.limit(0), ["i"], "x").count() == 0
    rates = truncation.truncation_rates(df.withColumn("s", F.col("i") % 2), truncation.truncated(df, ["i"], "x"), ["i"], ["s"]).collect()
    assert sum(r.n_truncated for r in rates) == len(cut) and sum(r.n_texts for r in rates) == len(rows)


def test_the_counts_decide_what_is_cut(spark, monkeypatch):
    """Without the counts other texts come out: finished ends, labels and tags are learned, not listed."""
    said = ["the board spoke", "rates stayed high", "costs fell", "sales rose"]
    text = lambda i: f"{said[i % 4]} ¤ {said[(i + 1) % 4]} , {said[(i // 4) % 4]} ¤"
    rows = [text(i) for i in range(40)] + [text(i) + "\n\nfiled under markets" for i in range(40, 60)] + ["the board spoke , rates", "costs fell ,", "sales rose ¤ the bo"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, x string")
    got = {r.i for r in truncation.truncated(df, ["i"], "x").collect()}
    assert got == {60, 61, 62}
    monkeypatch.setattr(truncation, "EVIDENCE", 10**9)
    assert {r.i for r in truncation.truncated(df, ["i"], "x").collect()} != got


def test_truncated_by_long_remains(spark):
    whole = [" ".join(FULL) + f" Note {i} is here." for i in range(8)]
    cut = [FULL[0] + " The finance team <a href='" + "x" * 3000, FULL[1] + " The board rev" + " " * 900, FULL[2] + " The lender gro" + "\u200b" * 700 + "\n" * 60]
    df = spark.createDataFrame(list(enumerate(whole + [FULL[0] + " " * 900] + cut)), "i int, x string")
    assert {r.i for r in truncation.truncated(df, ["i"], "x").collect()} == {9, 10, 11}


PROMPT = "Company: Acme (ACME), as of 2024-01-02. Closing prices: 1.5; 2.5; 3.5. The board reviewed the covenant package while rates stayed high. Explain how Acme is likely to close on the next trading day and give probabilities."
GOOD = json.dumps({"chain_of_thought": FULL[0], "output": {"next_day_direction": 1}})


@pytest.mark.parametrize(
    "answer,want",
    [
        (None, "empty"), ("", "empty"), ("​", "empty"), ("...", "empty"), ("N/A", "empty"), ("null", "empty"), ('""', "empty"), ("```json\n```", "empty"), ("<answer></answer>", "empty"),
        ('{"chain_of_thought": "", "output": null}', "empty"), (GOOD, None), (f"```json\n{GOOD}\n```", None), (json.dumps(GOOD), None), (FULL[0] + "\n\nFinal Prediction: " + '{"a": 1}', None),
        (GOOD[:60], "truncated"), (f"```json\n{GOOD[:70]}", "truncated"), (json.dumps(GOOD)[:80], "truncated"), (FULL[0] + '\n\nFinal Prediction: {"a": ', "truncated"),
        (PROMPT, "copy"), ("Question: " + PROMPT.upper(), "copy"), ("> " + PROMPT.replace(". ", ".\n> "), "copy"), (FULL[1] + " The board reviewed the covenant package while rates stayed high. " + FULL[2], None),
        ("I'm sorry, but I can't provide price forecasts.", "refusal"), ("Désolé, je ne peux pas répondre à cette demande.", "refusal"), (json.dumps({"chain_of_thought": "Request declined.", "output": None}), "refusal"),
        ("Management declined to update guidance, I cannot rule out a reversal. " + FULL[0], None),
        ("La demande intérieure a pesé sur les comptes pendant que les taux restaient élevés, et le volume apporte peu dans cette séance.", "language"),
        ("The label Zukunft und Technik is known. " + FULL[0], None),
    ],
)
def test_defects_of_one_answer(answer, want):
    assert pairs.judge_row(PROMPT, "en", {"a": answer}, frozenset())[0]["defect"] == want


def test_refusals_by_phrases():
    for text in ("The move is beyond my earlier estimate and I see a gain.", "As an airline, the firm would rather not hedge.", "Costs ran against my model.", "I cannot provide a point estimate. I expect the share to rise."):
        assert not pairs.refuses(text), text
    for text in ("That is beyond my abilities.", "“I’d rather not” say.", "This is against my policies, please ask someone else."):
        assert pairs.refuses(text), text


def test_answers_quoted_often():
    quoted = "{}"
    for _ in range(12):
        quoted = json.dumps(quoted)
    assert pairs.take_apart(quoted)[0] == "empty"


def test_refusals_that_are_long_or_late():
    why = "Such a statement would need facts about the firm that nobody outside it has, and readers could take it for advice. "
    judged = lambda text: pairs.judge_row(PROMPT, "en", {"a": text}, frozenset())[0]["defect"]
    assert len((why * 6).split()) > pairs.REFUSAL_WORDS
    assert judged("I'm sorry, but I can't provide price forecasts. " + why * 6) == "refusal"
    assert judged(why * 4 + "For these reasons I must decline.") == "refusal"
    # A long forecast that has such words is none.
    assert judged("The unit was not permitted to sell. " + " ".join(FULL) + " Sales rose by 4 percent, so the stock should close higher. " * 3 + why * 4) is None


def test_rates_over_all_texts(spark, tmp_path):
    articles = [(i, "site", t) for i, t in enumerate([*FULL, "Lorem ipsum dolor sit amet.", " ", None])]
    spark.createDataFrame([(*a, "t") for a in articles], "article_id bigint, site string, text string, title string").write.parquet(f"{tmp_path}/hacker_news_articles.parquet")
    answers = [FULL[0], PROMPT, "I'm sorry, but I can't provide price forecasts.", GOOD[:60], None]
    spark.createDataFrame([(i, "m", PROMPT, "en", t, "{}") for i, t in enumerate(answers)], "response_id bigint, model string, prompt string, prompt_lang string, chain_of_thought string, output string").write.parquet(f"{tmp_path}/reasoning_responses.parquet")
    got = {r.source: (r.n_texts, r.n_truncated) for r in queries.p2_rates(spark, str(tmp_path)).collect()}
    assert got == {"site": (len(FULL) + 1, 0), "m": (4, 1)}  # the answer cut inside its JSON is one of the four


def test_suffix_automaton_against_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        a, b = [[rng.choice("abc") for _ in range(rng.randrange(0, 25))] for _ in range(2)]
        for run in (1, 2, 4):
            hit = set()
            for i in range(len(b) - run + 1):
                if any(a[j : j + run] == b[i : i + run] for j in range(len(a))):
                    hit |= set(range(i, i + run))
            assert pairs.SuffixAutomaton(a).covered(b, run) == len(hit)


def test_defective_answers(spark):
    r = spark.createDataFrame([(1, PROMPT, "en", FULL[0], "[]"), (2, PROMPT, None, PROMPT, '{"a": 1'), (3, None, None, FULL[1] + " The board reviewed the cov", '{"a": 1}'), (4, None, None, None, None)] + [(10 + i, PROMPT, "en", t, '{"a": 1}') for i, t in enumerate(FULL * 3)], "response_id bigint, prompt string, prompt_lang string, chain_of_thought string, output string")
    p = spark.createDataFrame([(1, PROMPT, GOOD, None)], "pair_id bigint, input string, output1 string, output2 string")
    got = sorted(tuple(x) for x in pairs.defective_answers(r, p).select("source_table", "row_id", "answer_field", "defect").collect())
    t = "reasoning_responses"
    assert got == [(t, 1, "output", "empty"), (t, 2, "chain_of_thought", "copy"), (t, 2, "output", "truncated"), (t, 3, "chain_of_thought", "truncated"), (t, 4, "chain_of_thought", "empty"), (t, 4, "output", "empty"), ("rl_pairs", 1, "output2", "empty")]
    assert pairs.defective_answers(r.limit(0), p.limit(0)).count() == 0


def test_residue(spark):
    article = " ".join(FULL)
    bad = [("t", "Shares of ${ticker} closed. " + article), ("[HEADLINE GOES HERE]", article), ("t", "Lorem ipsum dolor sit amet."), ("Page not found | x.example", ""), ("t", "Please enable JavaScript."), ("t", article + " By [INSERT NAME], {{ site }}."), ("x – {{site_name}}", article), ("t", "undefined")]
    good = [("t", article), ("t", "The builder compiles `{{ name }}` tags. " + article), ("Access was denied to auditors", article + " Every visitor saw a 503 error, page not found."), ("t", None), (None, ""), (None, None), ("Gains of 5% [sic] at <b>Acme</b>", article)]
    pages = [("s", f"Members of club {i} only, ask at the desk.") for i in range(4)]  # one page template over four sites
    blank = [("t", f"Sales of goods rose to {i} crowns in the north. " + article) for i in range(10)] + [("t", "Sales of goods rose to crowns in the north. " + article)]
    rows = [(t, x, "one", True) for t, x in bad] + [(t, x, "one", False) for t, x in good] + [(t, x, f"site{i}", True) for i, (t, x) in enumerate(pages)] + [(t, x, "one", i == 10) for i, (t, x) in enumerate(blank)]
    df = spark.createDataFrame([(i, *r[:3], "clash") for i, r in enumerate(rows)], "article_id bigint, title string, text string, site string, reason string")
    got = {r.article_id for r in residue.residue(df).collect()}
    assert got == {i for i, r in enumerate(rows) if r[3]}
    assert residue.residue(df.limit(0)).count() == 0


def test_residue_is_found_by_alignment(spark):
    """What comes back is told by its template; the lists only name what comes once."""
    say = "Results for {} beat forecasts in the north."
    kept = [(f"Story of {w}", f"The {w} desk wrote this. " + say.format("{quarter}"), "s") for w in ("amber", "basin", "cedar")]
    filled = [(f"Note {i}", say.format(f"Q{i % 4 + 1}") + f" Costs of unit {'abcdefghij'[i]} fell.", "s") for i in range(9)]
    once = [("Tale", "The ember desk wrote that. It says {{ who }} was there.", "s")]
    quoted = [("How to", f"The {w} page explains `{{quarter}}` in full.", "s") for w in ("delta", "fjord", "grove", "haven")]
    pages = [("Any", "The desk is shut, ring the bell twice.", f"site{i}") for i in range(3)]
    titles = [(f"The {w} story | %SITE%", f"A story about {w} and more.", "s") for w in ("inlet", "jetty", "knoll")]
    got = _residue_of(spark, kept + filled + once + quoted + pages + titles)
    at = len(kept) + len(filled)
    assert got == dict.fromkeys(range(3), "slot") | {at: "mark"} | dict.fromkeys(range(at + 5, at + 8), "page") | dict.fromkeys(range(at + 8, at + 11), "slot")


def _residue_of(spark, rows):
    """{article_id: reason} of (title, text, site) rows."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "article_id bigint, title string, text string, site string")
    return {r.article_id: r.reason for r in residue.residue(df).collect()}


def test_residue_of_names_and_defaults_in_slots(spark):
    sentence = "At {}, sales of goods rose to 7 million."
    proper = [("t", sentence.format(f"Firm{chr(65 + i)} Works"), "s") for i in range(24)]
    own = ["{0}", "%%name%%", "COMPANY_NAME", "[Your Name]", "[insert company here]", "Company Name"]
    bad = [("t", sentence.format(x), "s") for x in own[:2]]
    assert set(_residue_of(spark, proper + bad)) == {24, 25}
    for x in own[2:]:
        assert _residue_of(spark, [*proper, ("t", sentence.format(x), "s")]) == {24: "slot"}, x
    # At the head of a sentence, and as a name that comes back in texts that don't have it elsewhere.
    heads = [("t", f"Firm{chr(65 + i)} said on a call that sales rose.", "s") for i in range(12)]
    assert _residue_of(spark, [*heads, ("t", "COMPANY_NAME said on a call that sales rose.", "s")]) == {12: "slot"}
    default = [("t", sentence.format("Northwind") + f" Costs fell by {i} crowns.", "s") for i in range(6)]
    assert set(_residue_of(spark, proper + default)) == set(range(24, 30))
    # Articles about one firm, copies of one article, and marks in a slot that most leave empty.
    about = [(f"Northwind in quarter {i}", t, s) for i, (_, t, s) in enumerate(default)]
    copies = [default[0]] * 6
    sic = [("t", "At FirmA Works, sales of [sic] goods rose to 7 million.", "s")]
    assert _residue_of(spark, proper + about + copies + sic) == {}


def test_residue_of_one_blank_slot_of_several(spark):
    both = [("t", f"At Firm{chr(65 + i)}, sales rose to {i + 2} million.", "s") for i in range(20)]
    bad = [("t", "At FirmA, sales rose to million.", "s"), ("t", "At , sales rose to 9 million.", "s")]
    for row in bad:
        assert _residue_of(spark, [*both, row]) == {20: "blank"}
    # Side by side, slots are told apart by kind and by commas; a name of two words or with a digit is one.
    near = [("t", f"On the board Firm{chr(65 + i)} 2{i}, Person{chr(65 + i)} was heard.", "s") for i in range(24)]
    near += [("t", "On the board Old FirmA 25, New PersonA was heard.", "s"), ("t", "On the board 3M 25, PersonA was heard.", "s")]
    assert _residue_of(spark, near) == {}
    assert set(_residue_of(spark, [*near, ("t", "On the board FirmA, PersonA was heard.", "s")])) == {26}
    # A sentence cut off by dots has none, and a slot that many leave out is none.
    assert _residue_of(spark, [*both, ("t", "At FirmA, sales rose to million...", "s")]) == {}
    assert _residue_of(spark, both + [("t", "At FirmA, sales rose to million.", "s")] * 5) == {}


def test_residue_of_long_pages(spark):
    words = "amber basin cedar delta ember fjord grove haven inlet jetty knoll ledge".split()
    page = " ".join(f"Members may ask at the desk for the {w} {v} card." for w in words[:6] for v in words[6:8])
    assert len(page.split()) > residue.PAGE_WORDS
    rows = [(f"Story {i} of the day", page, f"site{i % 4}") for i in range(8)]  # the same page under all titles of four sites
    assert _residue_of(spark, rows) == dict.fromkeys(range(8), "page")
    assert _residue_of(spark, [("One story", page, f"site{i % 4}") for i in range(8)]) == {}  # an article that four sites have
    filler = "Lorem ipsum dolor sit amet, consectetur adipiscing elit. Sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum. "
    consent = "We use cookies on this site to remember what you like. " * 8
    article = page + " One visitor saw page not found."
    titled = consent.replace("We use cookies", "We keep notes") + "Access denied. " * 4
    got = _residue_of(spark, [("t", filler * 2, "s"), ("t", consent, "s"), ("Access denied", titled, "s"), ("t", article, "s"), ("Access denied", article, "s")])
    assert got == dict.fromkeys(range(3), "notice")


# Problem 5


def test_repeated_lines(spark):
    rows = [(i, "A", ["  Legal NOTICE 12 x ", f"own {'ab'[i % 2]}{chr(97 + i)}", None, " "]) for i in range(5)] + [(10, "A", ["legal notice 7 x", "legal notice 8 x"]), (11, "B", ["legal notice 7 x"]), (12, None, ["legal notice 7 x"] * 9), (13, "A", None), (14, "A", [])]
    rows += [(20 + i, "C", ["copy one", "copy two"]) for i in range(6)]
    df = spark.createDataFrame([(*r, None, "z") for r in rows], "filing_id bigint, ticker string, paragraphs array<string>, filing_date string, keys string").withColumn("source", F.lit(1))
    got = sorted(tuple(r) for r in lines.repeated_lines(df).collect())
    assert got == [(i, 0) for i in range(5)] + [(10, 0), (10, 1)] + [(20 + i, k) for i in range(6) for k in (0, 1)]
    cleaned = {r.filing_id: r.paragraphs for r in lines.without_repeated(df).collect()}
    assert len(cleaned) == len(rows) and cleaned[0] == ["own aa", None, " "] and cleaned[13] is None and cleaned[20] == []
    # Copies are one cluster, so a line they alone repeat is no boilerplate where clusters are asked for.
    assert {r.source for r in lines.repeated_keys(df, min_clusters=2).collect()} == {"A"}
    assert lines.repeated_lines(df.limit(0)).count() == 0 and lines.without_repeated(df.limit(0)).count() == 0


def test_republished_filings_are_no_boilerplate(spark):
    """A filing published nine times is one cluster; a line needs five different filings, on three dates."""
    own = [(i, "A", [f"own {'abcdefgh'[i]}", "terms apply"], f"2024-01-0{1 + i % 4}") for i in range(6)]
    again = [(10 + i, "A", ["the same article", "its second line"], f"2024-02-0{1 + i}") for i in range(9)]
    one_day = [(20 + i, "A", [f"other {'abcdefgh'[i]}", "daily note"], "2024-03-01") for i in range(6)]
    df = spark.createDataFrame(own + again + one_day, "filing_id bigint, ticker string, paragraphs array<string>, filing_date string")
    assert {r.filing_id for r in lines.repeated_lines(df).collect()} == {r[0] for r in own + again + one_day}
    assert sorted(tuple(r) for r in lines.repeated_lines(df, min_clusters=5, min_dates=3).collect()) == [(i, 1) for i in range(6)]


# Problem 8


@needs_vocabulary
def test_encoding_against_the_public_encoder(spark):
    tiktoken = pytest.importorskip("tiktoken")
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    public = tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    texts = FULL + ["", " ", "\n\n \t x", "a" * 3000, "don't  stop", "<|endoftext|>", "日本語のテスト 📈", "é‍ x", "1,234.5 ½ ²", "x" * 47 + "é" * 30]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 1500), rng.randrange(0x4E00, 0x4F00), 32, 10])) for _ in range(rng.randrange(0, 80))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(9999, None, "x")], "doc_id bigint, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in encode.encode(df).collect()}
    assert got.pop(9999) == []
    assert got == {i: public.encode_ordinary(t) for i, t in enumerate(texts)}
    counts = {r.doc_id: r.n_tokens for r in encode.encode(df, only_count=True).collect()}
    assert counts == {i: len(x) for i, x in got.items()} | {9999: 0}
    assert encode.encode(df.limit(0)).count() == 0


def test_lexicon_is_a_minimal_map():
    rng = random.Random(6)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 8))) for _ in range(400)})
    ids = [[i, i + 1] for i in range(len(words))]
    lexicon = encode.Lexicon(encode.compile_lexicon(words, ids))
    assert lexicon.lookup(words) == ids
    asked = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    known = dict(zip(words, ids, strict=True))
    assert lexicon.lookup(asked) == [known.get(w) for w in asked]
    # As many states as there are different sets of endings.
    endings = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in {w[:i] for w in words for i in range(len(w) + 1)}}
    assert len(lexicon.finals) == len(endings)
    assert encode.Lexicon(encode.compile_lexicon([], [])).lookup([b"a"]) == [None]


# Problem 9


def test_best_fill_against_all_subsets():
    rng = random.Random(8)
    for _ in range(80):
        items = [rng.randrange(1, 30) for _ in range(rng.randrange(0, 9))]
        room = rng.randrange(0, 80)
        best = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room)
        chosen = packing.best_fill(room, {n: items.count(n) for n in set(items)})
        assert sum(n * k for n, k in chosen.items()) == best and all(k <= items.count(n) for n, k in chosen.items())


def pieces(sizes, capacity):
    return [min(capacity, s - k) for _, s in sizes if s for k in range(0, s, capacity)]


def _first_fit(items, capacity):
    """Containers that first-fit decreasing needs."""
    bins = []
    for n in sorted(items, reverse=True):
        at = next((i for i, b in enumerate(bins) if b + n <= capacity), None)
        if at is None:
            bins.append(n)
        else:
            bins[at] += n
    return len(bins)


def test_packing(spark):
    rng = random.Random(9)
    sizes = [(i, rng.choice([0, None, 1, 5, 40, 99, 100, 101, 250, rng.randrange(1, 60)])) for i in range(400)] + [(7, 30), (7, 250)]
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint").withColumn("part", F.lit("clash"))
    got = packing.pack_items(df, [(1, 100), (2, 37)]).collect()
    for budget, capacity in ((1, 100), (2, 37)):
        mine = [r for r in got if r.budget_id == budget]
        fill = {}
        for r in mine:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        assert max(fill.values()) <= capacity
        assert sorted(map(tuple, mine)) == sorted(tuple(r) for r in packing.pack_items(df.repartition(7), [(budget, capacity)]).collect())
        want = sum(s or 0 for _, s in sizes)
        assert sum(fill.values()) == want and len(fill) <= _first_fit(pieces(sizes, capacity), capacity) + 1
        for doc in {d for d, _ in sizes} - {7}:
            size = dict(sizes)[doc] or 0
            parts = sorted((r.start, r.n_tokens) for r in mine if r.doc_id == doc)
            assert parts == ([(0, 0)] if size == 0 else [(k, min(capacity, size - k)) for k in range(0, size, capacity)])
    assert packing.pack_items(df.limit(0), [(1, 100)]).count() == 0 and packing.pack_items(df, []).count() == 0


def test_packing_windows_follow_the_items(spark):
    """Many short items make many windows; items without tokens are in no group at all."""
    df = spark.range(400_000).selectExpr("id as doc_id", "cast(id % 2 as bigint) as n_tokens")
    got = packing.pack_items(df, [(1, 1 << 20)])
    per = got.groupBy("container_id").agg(F.count_if(F.col("n_tokens") == 1).alias("n"), F.sum("n_tokens").alias("s")).collect()
    assert len(per) == 2 and sum(r.n for r in per) == 200_000 and max(r.n for r in per) <= packing.ROWS
    assert packing.pack_items(df.where("n_tokens = 0"), [(1, 10)]).count() == 200_000


# Problem 10

SAME = [("Café closed at 12", "Café closed at 12"), ("The finance team", "Τhe fі​nance team"), ("ﬁnal ofﬁce", "final office"), ("ＡＢＣ １２", "ABC 12"), ("a b", "a b"), ("", "​"), ("naïve Ä", "nаïve­ Ӓ"), ("сор", "cop")]
OTHER = [("1.5 million", "1.6 million"), ("Cafe", "Café"), ("net sales, up", "net sales up"), ("a  b", "a b"), ("x²", "x2"), ("shop", "Shop")]


@pytest.mark.parametrize("words", [{}, {"The": 5, "finance": 9, "team": 2, "сор": 7, "cop": 1, "final": 3}])
def test_canonical_forms(words):
    c = lookalike.Canonical(words)
    for a, b in SAME:
        assert c.text(a) == c.text(b)
    for a, b in OTHER:
        assert c.text(a) != c.text(b)
    assert c.text(c.text(SAME[1][1])) == c.text(SAME[1][0])
    if words:
        assert c.text("cop") == "сор"  # the spelling the corpus has most


@pytest.mark.parametrize("words", [{}, {"корова": 3, "cop": 9}])
def test_words_keep_to_one_script(words):
    c = lookalike.Canonical(words)
    for text in ("корова и сорока", "Ирина Сорокина", "νόμος", "ОАО Рост", "plain Latin text"):
        assert c.text(text) == text or words
    # Mixed words come out in the script of the letters that only it has; words of look-alikes alone in the text's.
    assert c.text("кopoвa") == "корова" and c.text("pаypаl") == "paypal"
    if not words:
        assert c.text("сор на дворе") == c.text("cop на дворе") == "сор на дворе" and c.text("сор in the yard") == "cop in the yard"


def test_edit_automaton_with_a_budget():
    trie = lookalike.Trie({"finance": 2, "final": 1})
    assert trie.spellings("fіnance") == {"finance": 0} and trie.spellings("finanse") == {}
    assert trie.spellings("finanse", 1) == {"finance": 1} and trie.spellings("fnance", 1) == {"finance": 1} and trie.spellings("finnance", 1) == {"finance": 1}


def test_same_looks(spark):
    texts = [t for pair in SAME for t in pair] + [SAME[1][0], SAME[1][1]] + [t for pair in OTHER for t in pair] + [None]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, look string")
    got = sorted(tuple(r) for r in lookalike.same_looks(df).collect())
    form = lookalike.Canonical({}).text
    want = [(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if a is not None and b is not None and a != b and form(a) == form(b)]
    assert got == want and len(want) > len(SAME)
    classes = {r.doc_id: (r.class_id, r.n_spellings) for r in lookalike.look_classes(df).collect()}
    for i, a in enumerate(texts):
        same = [j for j, b in enumerate(texts) if a is not None and b is not None and form(a) == form(b)]
        assert classes.get(i) == ((min(same), len({texts[j] for j in same})) if same else None)
    out = {r.doc_id: r.canonical for r in lookalike.canonical_texts(df).collect()}
    assert out[len(texts) - 1] is None and all(v is None or unicodedata.is_normalized("NFC", v) for v in out.values())
    assert lookalike.same_looks(df.limit(0)).count() == 0
