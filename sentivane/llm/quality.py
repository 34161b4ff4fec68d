"""Quality rules as a short-circuit cascade.

Every rule looks at a whole text and says whether it fails.  On a sample the cascade measures each
rule's seconds a text and its share of rejected texts, then runs the rules by rejections per second;
a text leaves at its first failed rule, so dear rules see survivors only.  The verdict is that of all
rules together whatever their order.  All bounds are whole numbers, so no rounding decides.

Null texts count as empty.  An empty text has no words and fails the base rules.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentivane.llm.texts import WHITE, by_batches, narrow, raw

SAMPLE_ROWS = 2_000
SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")


def n_of(text: bytes, signs: bytes) -> int:
    return len(text) - len(text.translate(None, signs))


def word_chars(text: bytes) -> int:
    """Code points outside white space."""
    return len(text.translate(None, WHITE + _CONTINUATION))


def worded_lines(text: bytes) -> list[bytes]:
    return [line for line in text.split(b"\n") if line.strip()]


def repeat_words(w: list[bytes]) -> int:
    """Words in three-word windows that are found twice or more, the first included."""
    windows = list(zip(w, w[1:], w[2:]))
    if len(set(windows)) == len(windows):
        return 0
    first: dict = {}
    covered = bytearray(len(w))
    for i, window in enumerate(windows):
        j = first.setdefault(window, i)
        if j != i:
            covered[i:i + 3] = covered[j:j + 3] = b"\1\1\1"
    return sum(covered)


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Callable[[bytes, list[bytes]], bool]  # of a text and its words


RULES = (
    Rule("symbols", lambda t, w: 10 * n_of(t, SYMBOLS) > len(w)),
    Rule("word_length", lambda t, w: not 2 * len(w) <= word_chars(t) <= 12 * len(w)),
    Rule("exclamations", lambda t, w: 10 * n_of(t, b"!") > 3 * len(w)),
    Rule("capitals", lambda t, w: n_of(t, _UPPER) > n_of(t, _LOWER)),
    Rule("repeated_lines", lambda t, w: 10 * _repeated(t) > 4 * len(worded_lines(t))),
    Rule("letters", lambda t, w: 10 * sum(map(bool, map(_LETTER.search, w))) < 6 * len(w)),
    Rule("one_word", lambda t, w: 10 * max(Counter(w).values(), default=0) > 3 * len(w)),
)


def _repeated(text: bytes) -> int:
    lines = worded_lines(text)
    return len(lines) - len(set(lines))


def base_fails(n_words: int, n_repeat: int) -> bool:
    return n_words < 50 or 100 * n_repeat > 50 * n_words


def plan(df: DataFrame, text_col: str = "text", rules=RULES,
         sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules by rejections per second, measured on about `sample_rows` rows."""
    texts = df.select(F.lit(0).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = texts.count()

    def measure(batches):
        for b in batches:
            split = [(t, t.split()) for t in raw(b.column(1))]
            cost, cut = [], []
            for rule in rules:
                began = time.perf_counter()
                cut.append(sum(rule.fails(t, w) for t, w in split))
                cost.append(time.perf_counter() - began)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.name for r in rules]), pa.array(cost), pa.array(cut, pa.int64()),
                 pa.array([len(split)] * len(rules), pa.int64())],
                ["rule", "seconds", "rejected", "seen"])

    sampled = texts.sample(min(1.0, sample_rows / rows) if rows else 1.0, seed=7)
    found = {r["rule"]: r for r in by_batches(
        sampled, measure, "rule string, seconds double, rejected bigint, seen bigint",
    ).groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("cut")).collect()}

    def gain(rule: Rule) -> float:
        r = found.get(rule.name)
        return (r["cut"] + 0.5) / (r["s"] + 1e-9) if r else 0.0  # one row a rule comes back

    return [r.name for r in sorted(rules, key=gain, reverse=True)]


def first_failure(text: bytes, w: list[bytes], order: list[Rule]) -> str | None:
    return next((rule.name for rule in order if rule.fails(text, w)), None)


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES,
          order: list[str] | None = None) -> DataFrame:
    """Per row: the base counts, whether they fail, and whether the text is kept."""
    order = order or plan(df, text_col, rules)
    cascade = [next(r for r in rules if r.name == name) for name in order]

    def run(batches):
        for b in batches:
            out = []
            for t in raw(b.column(1)):
                w = t.split()
                n, again = len(w), repeat_words(w)
                failed = base_fails(n, again)
                out.append((n, word_chars(t), n_of(t, SYMBOLS), _repeated(t), again, failed,
                            not failed and first_failure(t, w, cascade) is None))
            columns = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in columns[:5]),
                 *(pa.array(c, pa.bool_()) for c in columns[5:])],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                 "base_failed", "kept"])

    return by_batches(
        narrow(df, id_col, text_col), run,
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
        "n_repeat_words bigint, base_failed boolean, kept boolean")


def keep(df: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows that pass, with all their columns."""
    cascade = [next(r for r in rules if r.name == name) for name in plan(df, text_col, rules)]
    at = df.columns.index(text_col)

    def good(t: bytes) -> bool:
        w = t.split()
        return (len(w) >= 50 and first_failure(t, w, cascade) is None
                and not base_fails(len(w), repeat_words(w)))

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([good(t) for t in raw(b.column(at))], pa.bool_()))

    return by_batches(df, run, df.schema)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text,
      list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
      FROM d),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n
            FROM again, (VALUES (0), (1), (2)) AS t(k) GROUP BY doc_id),
top AS (SELECT doc_id, max(n) AS n FROM (
          SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM w)
          GROUP BY doc_id, x) GROUP BY doc_id),
s AS (SELECT w.doc_id, len(w)::BIGINT AS n_words,
      length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
      (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines,
      coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(ln) AS n_lines,
      length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaim,
      length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
      length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower,
      len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letters,
      coalesce(top.n, 0) AS n_top
      FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN top USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 10 * n_symbols <= n_words AND word_chars BETWEEN 2 * n_words AND 12 * n_words
  AND 10 * n_exclaim <= 3 * n_words AND n_upper <= n_lower AND 10 * n_dup_lines <= 4 * n_lines
  AND 10 * n_letters >= 6 * n_words AND 10 * n_top <= 3 * n_words AS kept
FROM b
"""
