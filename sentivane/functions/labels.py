"""Label vocabularies and the mappings between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentivane.functions.text import trim_ws
from sentivane.vocab import (
    ANY_LABEL_SCORE,
    CANONICAL,
    DISPLAY,
    LABEL_ID,
    LABEL_SCORE,
    LABEL_SYNONYMS,
)


def _lookup(c: Column, table: dict) -> Column:
    expr = None
    for key, value in table.items():
        expr = F.when(c == key, F.lit(value)) if expr is None else expr.when(c == key, value)
    return expr


def label_to_score(label: Column) -> Column:
    """BULLISH 1, BEARISH -1, NEUTRAL 0, anything else null."""
    return _lookup(label, LABEL_SCORE)


def any_label_to_score(label: Column) -> Column:
    """As `label_to_score`, also for lower-case path labels; anything else 0."""
    return F.coalesce(_lookup(label, ANY_LABEL_SCORE), F.lit(0.0))


def canonical(label: Column) -> Column:
    """Upper-case, trimmed, positive/negative renamed; other words stay as they are."""
    upper = F.upper(trim_ws(label.cast("string")))
    return F.coalesce(_lookup(upper, CANONICAL), upper)


def normalise_label(label: Column) -> Column:
    """positive / neutral / negative for any known synonym, null for an unknown word."""
    word = F.lower(trim_ws(label))
    expr = None
    for target, words in LABEL_SYNONYMS.items():
        hit = word.isin(words)
        expr = F.when(hit, F.lit(target)) if expr is None else expr.when(hit, target)
    return expr


def display_label(label: Column) -> Column:
    return _lookup(label, DISPLAY)


def label_id(label: Column, canonicalise: bool = True) -> Column:
    """negative 0, neutral 1, positive 2; anything else 1.

    Display labels (BULLISH ...) are mapped first unless `canonicalise` is off.
    """
    word = F.lower(trim_ws(label))
    if canonicalise:
        shown = {d.lower(): p for p, d in DISPLAY.items()}
        word = F.coalesce(_lookup(word, shown), word)
    return F.coalesce(_lookup(word, LABEL_ID), F.lit(1))


def threshold_label(score: Column, theta: Column | float) -> Column:
    """Strictly above theta BULLISH, strictly below -theta BEARISH, else NEUTRAL."""
    theta = theta if isinstance(theta, Column) else F.lit(float(theta))
    return (
        F.when(score > theta, "BULLISH").when(score < -theta, "BEARISH").otherwise("NEUTRAL")
    )


def forced_binary(p_bull: Column, p_bear: Column) -> Column:
    return F.when(p_bull >= p_bear, "BULLISH").otherwise("BEARISH")


def collapse_neutral(label: Column) -> Column:
    return F.when(label == "BULLISH", "BULLISH").otherwise("BEARISH")
