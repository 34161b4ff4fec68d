"""Cleaning, tickers, labels and responses on literal cases."""

import html
import html.entities
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sentivane.functions import errors as E
from sentivane.functions import labels as L
from sentivane.functions import prompts as P
from sentivane.functions import text as X
from sentivane.functions import tickers as T
from sentivane.operators import weak as K
from sentivane.vocab import EMOJI_TOKENS


def apply(spark, fn, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    out = df.select("i", fn(F.col("t")).alias("x")).orderBy("i").collect()
    return [r["x"] for r in out]


def py_steps(text):
    """Brute force: the cleaning rules as Python's re applies them."""
    text = html.unescape(text)
    if text.strip() in ("[deleted]", "[removed]", "null", "nan"):
        return ""
    rules = [
        (r"https?://\S+|www\.\S+", ""), (r"\[([^\]]+)\]\([^\)]+\)", r"\1"),
        (r"(\*\*|__)(.*?)\1", r"\2"), (r"(\*|_)(.*?)\1", r"\2"),
        (r"`{1,3}(.*?)`{1,3}", r"\1"), (r"(?m)^#+\s*", ""), (r"(?m)^>\s*", ""),
    ]
    for pattern, to in rules:
        text = re.sub(pattern, to, text)
    for emoji, token in EMOJI_TOKENS:
        text = text.replace(emoji, token)
    return re.sub(r"\s+", " ", re.sub(r"[^\x00-\x7F]+", " ", text)).strip()


FIXED = [
    "Check this out &amp; profit: https://example.com/gainz **massive gain**",
    "Tesla to the moon 🚀 diamond hands 💎🙌", " [deleted] ", "[removed]", "nan", "null\n",
    "[t](https://x.org) and [plain](path) www.a.b next", "snake_case_word __b__ *i* _j_",
    "# head\r## not\n### third\n> quote\n>> two", "a b\x1cc\x85d", "⚰️ 🤡", "&notit; &copy &#39;q&#x27; &amp;lt;",
    "``code`` `x` ```y```", "**a** b **c", "line\r\nbreak\r# x", "", "&", "a &b c &hellip; d",
    "**multi\nline**", "[a]b](c)", "www.", "http://", "#", ">", "*", "**", "***", "____",
]


def reference(rnd):
    """A character reference, whole or broken, or something near one."""
    names = sorted(html.entities.html5)
    number = rnd.choice([0, 1, 9, 11, 13, 31, 65, 127, 128, 129, 159, 160, 0xD800, 0xFDD0, 0xFEFF,
                         0xFFFF, 0x1FFFE, 0x10FFFF, 0x110000, 10 ** 20, rnd.randint(0, 0x120000)])
    end = rnd.choice(["", ";", " ", "g", "="])
    return rnd.choice([
        "&" + rnd.choice(names), "&" + rnd.choice(names)[:rnd.randint(1, 6)] + end,
        f"&#{number}{end}", f"&#{rnd.choice('xX')}{rnd.choice(['', '0000'])}{number:x}{end}",
        rnd.choice(["&", "&;", "&#;", "&#x;", "&&amp;", "&amp;amp;", "&" + "x" * 40, "é", "😀", "\n"]),
    ])


def test_unescape_equals_python(spark):
    rnd = random.Random(11)
    cases = ["", None, *["".join(reference(rnd) for _ in range(rnd.randint(1, 6)))
                         for _ in range(3000)]]
    got = apply(spark, X.unescape_html, cases)
    for case, value in zip(cases, got):
        assert value == (None if case is None else html.unescape(case)), repr(case)


def test_cleaning_stays_in_the_jvm(spark):
    df = spark.createDataFrame([("a &hellip; b",)], "t string")
    plan = df.select(X.clean_text(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan  # the constants hold arrows of their own


def test_clean_text_equals_python_rules(spark):
    rnd = random.Random(7)
    alphabet = list("ab *_`#>[]()\n\r\t&;.$") + [" ", "🚀", "é", "http://x", "&amp;", "www.", " "]
    cases = FIXED + ["".join(rnd.choices(alphabet, k=rnd.randint(1, 40))) for _ in range(400)]
    got = apply(spark, X.clean_text, cases)
    for case, value in zip(cases, got):
        assert value == py_steps(case), repr(case)


def test_clean_text_null_is_empty(spark):
    assert apply(spark, X.clean_text, [None]) == [""]


def test_links_first_keeps_link_text(spark):
    case = ["see [note](https://x.org/a) now"]
    assert apply(spark, lambda c: X.clean_text(c, links_first=True), case) == ["see note now"]
    assert apply(spark, X.clean_text, case) == ["see [note]( now"]


def test_word_counts(spark):
    cases = ["", "a", " a  b\tc ", "x y"]
    assert apply(spark, X.word_count, cases) == [len(c.split()) for c in cases]
    assert apply(spark, X.clean_word_count, ["", "a", "a b c"]) == [0, 1, 3]


def test_combine(spark):
    df = spark.createDataFrame(
        [("a", "b"), ("a", "a b"), ("", "b"), ("a", ""), ("", "")], "t string, b string")
    got = [r[0] for r in df.select(X.combine_clean(F.col("t"), F.col("b"))).collect()]
    assert got == ["a -- b", "a b", "b", "a", ""]


def test_keep_long(spark):
    df = spark.createDataFrame([(1, "short"), (2, "long enough to stay")], "i int, raw string")
    rows = X.keep_long(df, F.col("raw"), 15).collect()
    assert [(r["i"], r["text"]) for r in rows] == [(2, "long enough to stay")]


def test_engagement_weight(spark):
    df = spark.createDataFrame([(0, 0), (-5, 0), (10, 2), (None, 3)], "s long, c long")
    got = [r[0] for r in df.select(X.engagement_weight(F.col("s"), F.col("c"))).collect()]
    assert got[:2] == [1.0, 1.0] and got[3] is None
    assert got[2] == pytest.approx(2.5649493574615367)


def test_cashtags_and_stop_words(spark):
    got = apply(spark, T.extract_cashtags,
                ["Buying $AAPL and $tsla calls, ignoring $FOR and $IT", "$WISH $TOOLONG", "$AB1"])
    assert got == [["AAPL", "TSLA"], ["WISH"], []]


def test_detect_tickers(spark):
    cases = [
        ("Huge news for $NVDA earnings next week", "NVDA", "Nvidia", "cashtag", 0.95),
        ("Microsoft cloud revenue grew last quarter", "MSFT", "Microsoft", "company_name", 0.85),
        ("tesla and apple", "AAPL", "Apple", "company_name", 0.85),
        ("PLTR beats XYZ and PLTR", "PLTR", "Palantir", "capital_symbol", 0.70),
        ("XYZ over ABCD with XYZ", "XYZ", "XYZ", "capital_symbol", 0.50),
        ("$AMD $GME $GME $AMD", "AMD", "Advanced Micro Devices", "cashtag", 0.95),
        ("nothing here", None, None, "none", 0.0),
        ("", None, None, "none", 0.0),
    ]
    got = apply(spark, T.detect_tickers, [c[0] for c in cases])
    for d, want in zip(got, cases):
        assert (d["ticker"], d["company"], d["method"], d["confidence"]) == want[1:], want[0]


def test_stop_words_are_a_parameter(spark):
    text = ["I WANT TO BUY A NEW CAR FOR MY DOG"]
    assert apply(spark, T.detect_tickers, text)[0]["ticker"] is None
    loose = apply(spark, lambda c: T.extract_capitals(c, []), text)[0]
    assert loose == ["WANT", "BUY", "NEW", "CAR", "FOR", "DOG"]


def test_labels(spark):
    assert apply(spark, L.normalise_label, [" Bull ", "SELL", "mixed", "moon"]) == [
        "positive", "negative", "neutral", None]
    assert apply(spark, L.label_id, ["positive", "BULLISH", "BEARISH", "odd"]) == [2, 2, 0, 1]
    assert apply(spark, lambda c: L.label_id(c, False), ["BULLISH"]) == [1]
    assert apply(spark, L.any_label_to_score, ["positive", "BEARISH", "odd"]) == [1.0, -1.0, 0.0]
    assert apply(spark, L.label_to_score, ["NEUTRAL", "odd"]) == [0.0, None]
    assert apply(spark, L.canonical, [" positive ", "x"]) == ["BULLISH", "X"]


def test_error_categories(spark):
    cases = ["guh", "iv crush", "good but bad", "puts or calls", "plain", "x" * 1001 + " guh"]
    assert apply(spark, E.error_category_4, cases) == [
        "SARCASM_MEMES", "FINANCIAL_JARGON", "MIXED_SENTIMENT", "AMBIGUOUS_TICKER",
        "IMPLICIT_OR_SUBTLE_SENTIMENT", "SARCASM_MEMES"]
    assert apply(spark, E.error_category_5, cases) == [
        "SARCASM_MEMES", "ADVANCED_INVESTING_TERMINOLOGY", "SUBTLE_IMPLICIT_SENTIMENT",
        "SUBTLE_IMPLICIT_SENTIMENT", "SUBTLE_IMPLICIT_SENTIMENT", "LONG_DUE_DILIGENCE_POSTS"]
    clown = ["EMOJI_CLOWN_SARCASTIC"]
    assert apply(spark, E.error_category_5, clown) == ["SUBTLE_IMPLICIT_SENTIMENT"]
    assert apply(spark, lambda c: E.error_category_5(c, True), clown) == ["SARCASM_MEMES"]



def test_error_patterns_in_one_line(spark):
    """Both parts must stand in one line, in order; a long line takes no time by its square."""
    cases = [("buy and hold calls", "AMBIGUOUS_TICKER"), ("calls and hold", None),
             ("buy and\nhold calls", None), ("calls and\nand puts", "AMBIGUOUS_TICKER"),
             ("and and recalls", None), ("short term up, long term down", "MIXED_SENTIMENT"),
             ("band and putsch and\r puts", "AMBIGUOUS_TICKER"), ("long term, short\nterm", None)]
    df = spark.createDataFrame([(t,) for t, _ in cases], "text string")
    got = [r[0] for r in df.select(E.error_category_4(F.col("text"))).collect()]
    assert got == [want or "IMPLICIT_OR_SUBTLE_SENTIMENT" for _, want in cases]
    began = time.time()
    long = spark.range(1).select(F.concat(F.repeat(F.lit("and yes "), 30_000), F.lit("recalls")))
    found = long.toDF("text").select(E._in_one_line(F.col("text"), r"\band\b.*\b(calls|puts)\b"))
    assert found.first()[0] is False and time.time() - began < 10


def test_parse_responses(spark):
    cases = [
        ('{"reasoning_summary": "Strong", "sentiment": "bullish"}', "ok", "positive", "Strong"),
        ('```json\n{"reasoning_summary": "miss", "sentiment": "bearish"}\n```', "ok", "negative",
         "miss"),
        ('so {"sentiment": "hold"} ok', "ok", "neutral", P.NO_REASON_JSON),
        ("REASONING: up only\nSENTIMENT: Bullish", "ok", "positive", "up only"),
        ("sentiment: sell", "ok", "negative", P.NO_REASON_TEXT),
        ('{"reasoning_summary": "x", "sentiment": "laser_eyes"}', "invalid_label", "neutral",
         P.FAILURE_PREFIX + "invalid_label"),
        ("{'sentiment': 'bullish'}", "unparsable", "neutral", P.FAILURE_PREFIX + "unparsable"),
        ('{"reasoning_summary": "x"}', "missing_sentiment", "neutral",
         P.FAILURE_PREFIX + "missing_sentiment"),
        ("", "empty", "neutral", P.FAILURE_PREFIX + "empty"),
        (None, "empty", "neutral", P.FAILURE_PREFIX + "empty"),
        ("garbage", "unparsable", "neutral", P.FAILURE_PREFIX + "unparsable"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, response string")
    got = K.parse_responses(df).orderBy("i").collect()
    for row, (raw, status, label, reason) in zip(got, cases):
        assert (row["status"], row["label"], row["reasoning_summary"]) == (status, label, reason), raw
        assert row["confidence"] == (0.85 if status == "ok" else 0.33)
    given = apply(spark, P.parse_response, ['{"sentiment": "buy", "confidence": 0.6}'])[0]
    assert given["confidence"] == 0.6


def test_prompts(spark):
    examples = spark.createDataFrame(
        [(i, "NVDA", f"text {i}", "positive", f"why {i}") for i in range(6)],
        "ord int, ticker string, text string, sentiment string, reasoning_summary string")
    posts = spark.createDataFrame([(1, "TSLA", "deliveries {ticker} up"), (2, None, "x")],
                                  "post_id int, ticker string, text string")
    rows = K.render_prompts(posts, examples, paths=2).orderBy("post_id", "path_id").collect()
    assert len(rows) == 4
    assert "Example 6:" in rows[0]["prompt"] and "deliveries {ticker} up" in rows[0]["prompt"]
    assert rows[1]["prompt"].endswith("[Sampling Path 2/2]")
    assert "Company/Ticker: stock" in rows[2]["prompt"]
    orders = set()
    for seed in (None, 42, 101, 7):
        d = P.demonstrations(examples, False, seed).first()[0]
        assert "reasoning_summary" not in d and d.count("Example ") == 6
        orders.add(tuple(line for line in d.split("\n") if line.startswith("Post")))
    assert len(orders) > 1


def test_cue_label(spark):
    bull, bear = P.cue_counts(F.col("t"))
    df = spark.createDataFrame([("buy calls calls",), ("guidance cut",), ("meh",)], "t string")
    got = [tuple(r) for r in df.select(bull, bear, P.cue_label(bull, bear)).collect()]
    assert got == [(3, 0, "positive"), (0, 2, "negative"), (0, 0, "neutral")]


def test_preview(spark):
    assert apply(spark, X.preview, ["a" * 300, "b" * 301]) == ["a" * 300, "b" * 300 + "..."]


def test_capital_words_that_are_no_symbols(spark):
    from sentivane.functions.tickers import detect_tickers, extract_capitals, extract_cashtags

    texts = ["THE BEST DROP SINCE MAY", "NEAR the PEAK", "$COOL", "I WISH", "buy XYZ now", "$LOVE TRUE"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select("text", extract_capitals(F.col("text")).alias("caps"),
                    extract_cashtags(F.col("text")).alias("cash")).collect()
    found = {r["text"]: (r["caps"], r["cash"]) for r in got}
    assert found["NEAR the PEAK"] == ([], []) and found["$COOL"][1] == []
    assert found["THE BEST DROP SINCE MAY"] == ([], [])
    assert found["I WISH"] == (["WISH"], [])  # a known symbol, which goes before the stop words
    assert found["buy XYZ now"] == (["XYZ"], []) and found["$LOVE TRUE"] == ([], [])
    tagged = df.select("text", F.inline(F.array(detect_tickers(F.col("text"))))).collect()
    assert [r["text"] for r in tagged if r["all_tickers"]] == ["I WISH", "buy XYZ now"]
