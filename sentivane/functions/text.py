"""Cleaning of post text, one step per function; `clean_text` chains them in their fixed order.

The patterns spell out Python's white space and set `(?d)` (only newline ends a line), so that
java.util.regex gives what a Python regex would on any input.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable
from functools import reduce
from html.entities import html5, name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentivane.functions.let import let
from sentivane.vocab import COMMON_ENTITIES, DELETED, EMOJI_TOKENS, SPACE, SPACE_CHARS

URL = rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+"
MD_LINK = r"\[([^\]]+)\]\([^\)]+\)"
BOLD = r"(?d)(\*\*|__)(.*?)\1"
ITALIC = r"(?d)(\*|_)(.*?)\1"
CODE = r"(?d)`{1,3}(.*?)`{1,3}"
HEADER = rf"(?md)^#+[{SPACE}]*"
QUOTE = rf"(?md)^>[{SPACE}]*"
NON_ASCII = r"[^\x00-\x7F]+"
# Every run of white space but a lone blank.
RUN = rf"[\t-\r\x1c-\x1f\x85\xa0\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}" \
      rf"\x{{205f}}\x{{3000}}][{SPACE}]*|[{SPACE}]{{2,}}"
ASCII_RUN = r"[\t-\r\x1c-\x1f][\t-\r\x1c-\x20]*|[\t-\r\x1c-\x20]{2,}"
# An entity outside the common ones: the text then goes through the full table.
RARE_ENTITY = r"&(?!(?:lt|gt|quot|apos|nbsp|amp|#39|#x27);)[#A-Za-z]"


def trim_ws(c: Column) -> Column:
    """Trim all white space (Spark's own `trim` cuts blanks only)."""
    return F.btrim(c, F.lit(SPACE_CHARS))


# What may follow `&`: a number, or up to 32 characters of a name.
REFERENCE = r"^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# Names that HTML also knows without the semicolon; the longest one that fits is taken.
OPEN_NAMES = [name for name in html5 if not name.endswith(";")]
OPEN_NAME = "^(?:" + "|".join(sorted(OPEN_NAMES, key=len, reverse=True)) + ")"
# Numbers 128 to 159 mean Windows characters; five of them have none and stay as they are.
WINDOWS = [bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)]


def _entities(names: Iterable[str]) -> Column:
    """HTML 5 names with their characters: a constant that Catalyst folds.  A map is searched from
    its beginning, so the older, commoner names go first."""
    order = sorted(names, key=lambda n: n.rstrip(";") not in name2codepoint)
    return F.str_to_map(F.lit("\x01".join(f"{n}\x02{html5[n]}" for n in order)),
                        F.lit("\x01"), F.lit("\x02"))


def _character(number: Column) -> Column:
    """The character of a code point, as HTML reads it; null (too long a number) as unknown."""
    unknown = F.lit("\ufffd")
    utf32 = F.concat(F.lit(b"\x00\x00\xfe\xff"), F.unhex(F.lpad(F.hex(number), 8, "0")))
    return (
        F.when(number.isNull() | (number == 0) | number.between(0xD800, 0xDFFF)
               | (number > 0x10FFFF), unknown)
        .when(number.between(128, 159),
              F.get(F.array(*[F.lit(w) for w in WINDOWS]), (number - 128).cast("int")))
        .when(number.between(1, 8) | (number == 11) | number.between(14, 31) | (number == 127)
              | number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(0xFFFE) == 0xFFFE), "")
        .otherwise(F.decode(utf32, "UTF-32"))
    )


def _code_point(reference: Column) -> Column:
    """The number of `#65;` or `#x41;`; null if it has more digits than any code point."""
    digits = F.regexp_extract(reference, "^#[xX]?0*([0-9a-fA-F]*)", 1)
    known = F.concat(F.lit("0"), digits)
    number = F.when(F.lower(F.substring(reference, 2, 1)) == "x", F.conv(known, 16, 10))
    return F.when(F.length(digits) <= 7, number.otherwise(known)).cast("bigint")


def _decode_piece(piece: Column) -> Column:
    """What followed an `&`, with the reference at its beginning decoded."""
    def decode(x: Column) -> Column:
        rest = F.substr(x["piece"], F.length(x["ref"]) + 1)
        name = F.regexp_extract(x["piece"], OPEN_NAME, 0)
        named = let(_entities(html5)[x["ref"]], lambda whole: F.when(
            whole.isNotNull(), F.concat(whole, rest)).otherwise(let(name, lambda n: F.when(
                n == "", F.concat(F.lit("&"), x["piece"])).otherwise(F.concat(
                    _entities(OPEN_NAMES)[n], F.substr(x["piece"], F.length(n) + 1))))))
        number = F.concat(let(_code_point(x["ref"]), _character), rest)
        return (F.when(x["ref"] == "", F.concat(F.lit("&"), x["piece"]))
                .when(F.startswith(x["ref"], F.lit("#")), number).otherwise(named))

    return let(F.struct(piece.alias("piece"),
                        F.regexp_extract(piece, REFERENCE, 0).alias("ref")), decode)


def _full_unescape(c: Column) -> Column:
    """All references of HTML 5.  None holds an `&`, so the text is cut there and each piece is
    decoded by itself."""
    return F.array_join(F.transform(F.split(c, "&"), lambda piece, i: F.when(
        i == 0, piece).otherwise(_decode_piece(piece))), "")


def unescape_html(c: Column, full: bool = True) -> Column:
    """Decode entities.

    The common ones are replaced one after the other.  With `full`, a text holding any other
    reference is cut at its ampersands and goes through the complete HTML 5 table.
    """
    common = c
    for entity, char in COMMON_ENTITIES:
        common = F.replace(common, F.lit(entity), F.lit(char))
    if full:
        common = F.when(c.rlike(RARE_ENTITY), _full_unescape(c)).otherwise(common)
    return F.when(F.contains(c, F.lit("&")), common).otherwise(c)


def drop_deleted(c: Column) -> Column:
    return let(c, lambda x: F.when(trim_ws(x).isin(DELETED), F.lit("")).otherwise(x))


def strip_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL, "")


def strip_md_links(c: Column) -> Column:
    return F.regexp_replace(c, MD_LINK, "$1")


def strip_bold(c: Column) -> Column:
    return F.regexp_replace(c, BOLD, "$2")


def strip_italic(c: Column) -> Column:
    return F.regexp_replace(c, ITALIC, "$2")


def strip_code(c: Column) -> Column:
    return F.regexp_replace(c, CODE, "$1")


def strip_headers(c: Column) -> Column:
    return F.regexp_replace(c, HEADER, "")


def strip_quotes(c: Column) -> Column:
    return F.regexp_replace(c, QUOTE, "")


def emoji_tokens(c: Column) -> Column:
    for emoji, token in EMOJI_TOKENS:
        c = F.replace(c, F.lit(emoji), F.lit(token))
    return c


def strip_non_ascii(c: Column) -> Column:
    return F.regexp_replace(c, NON_ASCII, " ")


def squash_ws(c: Column) -> Column:
    return trim_ws(F.regexp_replace(c, RUN, " "))


def _only_if(c: Column, marks: list[str], step: Callable[[Column], Column]) -> Column:
    """`step` on the texts holding one of the marks: a byte search spares most of them a regex."""
    def guarded(x: Column) -> Column:
        found = reduce(operator.or_, [F.contains(x, F.lit(m)) for m in marks])
        return F.when(found, step(x)).otherwise(x)

    return let(c, guarded)


def clean_text(
    c: Column,
    preserve_financial_emojis: bool = True,
    full_entities: bool = True,
    links_first: bool = False,
) -> Column:
    """All steps; null becomes the empty string.

    By default URLs go before markdown links, so a link to a URL loses its closing bracket with
    the URL; `links_first` swaps the two and keeps the link text whole.
    """
    urls = (["http", "www."], strip_urls)
    links = (["]("], strip_md_links)
    steps = [*([links, urls] if links_first else [urls, links]),
             (["**", "__"], strip_bold), (["*", "_"], strip_italic), (["`"], strip_code),
             (["#"], strip_headers), ([">"], strip_quotes)]
    c = drop_deleted(unescape_html(F.coalesce(c, F.lit("")), full_entities))
    for marks, step in steps:
        c = _only_if(c, marks, step)

    def to_ascii(x: Column) -> Column:
        return strip_non_ascii(emoji_tokens(x) if preserve_financial_emojis else x)

    # more bytes than characters: not plain ASCII
    c = let(c, lambda x: F.when(F.octet_length(x) > F.length(x), to_ascii(x)).otherwise(x))
    return trim_ws(F.regexp_replace(c, ASCII_RUN, " "))


def combine_clean(title: Column, body: Column) -> Column:
    """Join a cleaned title and a cleaned body.

    Bound with `let`, so that each long cleaning expression is evaluated once however often the
    rule below mentions it.
    """
    def rule(x: Column) -> Column:
        t, b = x["t"], x["b"]
        return (
            F.when((t != "") & (b != "") & ~F.startswith(b, t), F.concat_ws(" -- ", t, b))
            .when(b != "", b)
            .otherwise(t)
        )

    return let(F.struct(title.alias("t"), body.alias("b")), rule)


def keep_long(df: DataFrame, text: Column, minimum: int, name: str = "text") -> DataFrame:
    """Adds `text` as a column and keeps the rows where it has at least `minimum` characters.

    A plain filter on a computed column is pushed below its projection and computes the text a
    second time; exploding a one-element array that may be emptied computes it once.
    """
    kept = F.filter(F.array(text), lambda t: F.length(t) >= minimum)
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode(kept).alias(name))


def char_length(c: Column) -> Column:
    return F.length(c)


def word_count(c: Column) -> Column:
    """Number of runs of non-space characters; the empty text has none."""
    return F.regexp_count(c, F.lit(f"[^{SPACE}]+"))


def clean_word_count(c: Column) -> Column:
    """As `word_count`, for cleaned text: its words stand one blank apart."""
    blanks = F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    return F.when(c == "", 0).otherwise(blanks + 1)


def preview(c: Column, length: int = 300) -> Column:
    """The text itself, or its first `length` characters and three dots, for a report row."""
    return F.when(F.length(c) > length,
                  F.concat(F.substring(c, 1, length), F.lit("..."))).otherwise(c)


def engagement_weight(score: Column, comments: Column) -> Column:
    """ln(1 + max(0, score) + max(0, comments)); no engagement weighs 1, unknown is null."""
    weight = F.log1p(
        (F.greatest(F.lit(0), score) + F.greatest(F.lit(0), comments)).cast("double")
    )
    known = score.isNotNull() & comments.isNotNull()
    return F.when(known, F.when(weight == 0, F.lit(1.0)).otherwise(weight))
