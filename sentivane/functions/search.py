"""Cheap searches that go before a regular expression."""

from __future__ import annotations

import operator
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def head(alternative: str) -> str:
    """The literal a simple pattern starts with: every match contains it."""
    plain = alternative.removeprefix(r"\b")
    return re.match(r"(?:[^\\.*+?|()\[\]{}^$](?![*?{]))*", plain).group(0)


def group_heads(pattern: str) -> list[str]:
    """Heads of the alternatives of a pattern of the form \\b(a|b|c)\\b."""
    inner = pattern.removeprefix(r"\b(").removesuffix(r")\b")
    return [head(a) for a in inner.split("|")]


def found_any(text: Column, words: Sequence[str]) -> Column:
    """Whether one of the words occurs; true when a word is empty (nothing to search for)."""
    if not all(words):
        return F.lit(True)
    return reduce(operator.or_, [F.contains(text, F.lit(w)) for w in dict.fromkeys(words)])
