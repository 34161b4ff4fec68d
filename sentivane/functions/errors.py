"""The two error taxonomies as ordered pattern groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentivane.functions.let import let
from sentivane.functions.search import found_any, group_heads, head
from sentivane.vocab import (
    ERROR_DEFAULT_4,
    ERROR_DEFAULT_5,
    ERROR_GROUPS_4,
    ERROR_GROUPS_5,
    ERROR_LONG_5,
    LONG_POST,
)

# The clown emoji as it looks after cleaning.
CLOWN_TOKEN = "emoji_clown_sarcastic"


def group_pattern(patterns: list[str], clown_token: bool = False) -> str:
    extra = [CLOWN_TOKEN] if clown_token and "🤡" in patterns else []
    return "|".join([*patterns, *extra])


def _in_one_line(low: Column, pattern: str) -> Column:
    """Whether a line has what stands before `.*` in the pattern, then what stands behind it.

    The first place in a line leaves the most behind it, so no other is tried: a search of its own
    from every place takes time by the square of the line's length.
    """
    first, last = pattern.split(".*")
    ends = group_heads(last) if last.startswith(r"\b(") else [head(last)]
    return (found_any(low, [head(first)]) & found_any(low, ends)
            & low.rlike(f"(?dm)^(?>.*?{first}).*{last}"))


def _first_group(low: Column, groups, default: str, clown_token: bool, start=None) -> Column:
    expr = start
    for name, patterns in groups:
        plain = [p for p in patterns if ".*" not in p]
        words = [head(p) for p in plain] + ([CLOWN_TOKEN] if clown_token else [])
        hit = found_any(low, words) & low.rlike("(?d)" + group_pattern(plain, clown_token))
        for p in patterns:
            if p not in plain:
                hit = hit | _in_one_line(low, p)
        expr = F.when(hit, name) if expr is None else expr.when(hit, name)
    return expr.otherwise(default)


def error_category_4(text: Column, clown_token: bool = False) -> Column:
    return let(F.lower(text), lambda low: _first_group(
        low, ERROR_GROUPS_4, ERROR_DEFAULT_4, clown_token))


def error_category_5(text: Column, clown_token: bool = False) -> Column:
    """Long posts first, whatever they say; then the five groups in order."""
    def rule(x: Column) -> Column:
        start = F.when(F.length(x["text"]) > LONG_POST, ERROR_LONG_5)
        return _first_group(x["low"], ERROR_GROUPS_5, ERROR_DEFAULT_5, clown_token, start)

    return let(F.struct(text.alias("text"), F.lower(text).alias("low")), rule)
