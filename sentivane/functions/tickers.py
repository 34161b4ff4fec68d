"""Ticker and company detection as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentivane.functions.let import let
from sentivane.functions.search import found_any, group_heads
from sentivane.vocab import (
    COMPANY_OF,
    COMPANY_PATTERNS,
    STOP_TICKERS,
    WORD,
)

CASHTAG = rf"\$([A-Za-z]{{1,5}})(?![{WORD}])"
CAPITALS = rf"(?<![{WORD}])([A-Z]{{2,5}})(?![{WORD}])"
DEFAULT_STOP = list(dict.fromkeys(STOP_TICKERS))


def _known(c: Column) -> Column:
    return c.isin(list(COMPANY_OF))


def _stop(c: Column, words: Sequence[str]) -> Column:
    return c.isin(list(words))


def extract_cashtags(text: Column, stop_words: Sequence[str] = DEFAULT_STOP) -> Column:
    """All `$SYMBOL` mentions in order, upper-cased, without stop words (known symbols stay)."""
    found = F.regexp_extract_all(text, F.lit(CASHTAG), F.lit(1))
    return F.filter(F.transform(found, F.upper), lambda t: _known(t) | ~_stop(t, stop_words))


def extract_capitals(text: Column, stop_words: Sequence[str] = DEFAULT_STOP) -> Column:
    """Stand-alone capitals in order: known symbols, and unknown ones of 3 or 4 letters."""
    found = F.regexp_extract_all(text, F.lit(CAPITALS), F.lit(1))
    return F.filter(
        found,
        lambda t: _known(t) | (F.length(t).isin(3, 4) & ~_stop(t, stop_words)),
    )


def extract_companies(text: Column) -> Column:
    """(ticker, company) of every name pattern found, in pattern order.

    A byte search for the words of a pattern goes before the pattern itself.
    """
    def hits(low: Column) -> Column:
        return F.array_compact(F.array(*[
            F.when(found_any(low, group_heads(pattern)) & low.rlike(pattern),
                   F.struct(F.lit(ticker).alias("ticker"), F.lit(company).alias("company")))
            for pattern, ticker, company in COMPANY_PATTERNS
        ]))

    return let(F.lower(text), hits)


def ticker_company(ticker: Column) -> Column:
    """Company of a symbol; an unknown symbol stands for itself."""
    pairs = [F.lit(x) for pair in COMPANY_OF.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), ticker), ticker)


def most_frequent(values: Column) -> Column:
    """Most frequent string, the earliest of equals; null for an empty array.

    Equal values lie side by side after a sort, so one fold over the array counts them.
    """
    placed = F.array_sort(F.transform(
        values, lambda v, i: F.struct(v.alias("value"), i.alias("at"))))
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("first"),
                    F.lit(None).cast("string").alias("value"))

    def count(s: Column, x: Column) -> Column:
        run = s["run"]
        same = run["value"].eqNullSafe(x["value"])
        longer = F.struct(
            F.when(same, run["n"] + 1).otherwise(1).alias("n"),
            F.when(same, run["first"]).otherwise(-x["at"]).alias("first"), x["value"].alias("value"))
        return let(longer, lambda r: F.struct(
            r.alias("run"), F.greatest(s["best"], r).alias("best")))

    return F.aggregate(placed, F.struct(none.alias("run"), none.alias("best")), count,
                       lambda s: s["best"]["value"])


def detect_tickers(text: Column, stop_words: Sequence[str] = DEFAULT_STOP) -> Column:
    """Cashtags, else company names, else capitals, as one struct.

    Fields: ticker, company, all_tickers (sorted, distinct), confidence, method.
    """
    none = F.lit(None).cast("string")

    def found(ticker, company, symbols, confidence, method):
        return F.struct(
            ticker.alias("ticker"),
            company.alias("company"),
            F.array_sort(F.array_distinct(symbols)).alias("all_tickers"),
            confidence.alias("confidence"),
            F.lit(method).alias("method"),
        )

    def by_cashtag(cash):
        return let(most_frequent(cash), lambda top: found(
            top, ticker_company(top), cash, F.lit(0.95), "cashtag"))

    def by_name(names):
        first = F.get(names, 0)
        return found(first["ticker"], first["company"],
                     F.transform(names, lambda x: x["ticker"]), F.lit(0.85), "company_name")

    def by_capitals(caps):
        return let(most_frequent(caps), lambda top: found(
            top, ticker_company(top), caps,
            F.when(_known(top), 0.70).otherwise(0.50), "capital_symbol"))

    nothing = found(none, none, F.array().cast("array<string>"), F.lit(0.0), "none")
    # each level is bound once and only worked out when the level before it found nothing
    level3 = let(extract_capitals(text, stop_words), lambda caps: F.when(
        F.size(caps) > 0, by_capitals(caps)).otherwise(nothing))
    level2 = let(extract_companies(text), lambda names: F.when(
        F.size(names) > 0, by_name(names)).otherwise(level3))
    return let(extract_cashtags(text, stop_words), lambda cash: F.when(
        F.size(cash) > 0, by_cashtag(cash)).otherwise(level2))
