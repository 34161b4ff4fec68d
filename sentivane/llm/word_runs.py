"""Periodic runs of words by Kruskal's rule over falling LCP.

The suffixes of a text are sorted by prefix doubling; neighbours in that order are edges, weighted
by the length of their longest common prefix (LCP).  Edges are taken by falling LCP: union-find joins
the two classes, each an ordered set of positions.  Where the joined set has neighbours i < j from
the two sides, with d = j - i at most the LCP L, the words from i to j + L have the period d; it is
their smallest, since a smaller one would have put a position between i and j before.  L cannot grow,
so the stretch ends there; where the words before i and j differ (or i is the first word) it begins
at i.  So every run is seeded once, by its start and the place one period on.

A run that counts has at least `SHORTEST` words and two periods, so its LCP is at least half of that:
edges below are never drawn, and texts in which no `SHORTEST` / 2 words come twice are not sorted.

Null and empty texts have no words and no runs.  Rows stand alone: repeated rows have equal results.
A null id is never edited.  Memory: about 20 bytes times log2(longest period stretch) a word of the
`CHUNK_WORDS` words in hand, or of one text if that is longer.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sentivane.llm.texts import by_batches, narrow, raw

SHORTEST = 12
CHUNK_WORDS = 300_000
_HASH = np.uint64(0x9E3779B97F4A7C15)


def levels(word: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order, and per level k the ranks of the first 2^k words of every suffix.

    Suffixes of different texts differ in their first word.  Ranks that have become unique are not
    sorted again.
    """
    n = len(word)
    _, rank = np.unique(doc.astype(np.int64) * (int(word.max()) + 1) + word, return_inverse=True)
    order = np.argsort(rank, kind="stable")
    first = np.searchsorted(rank[order], rank)  # a class has the place of its first member
    rank = first.astype(np.int64)
    out, width = [rank.copy()], 1
    while True:
        same = np.flatnonzero(rank[order[1:]] == rank[order[:-1]])
        if not len(same):
            return order, out
        at = np.unique(np.concatenate([same, same + 1]))  # places in the order that share a rank
        open_ = order[at]
        # a suffix that ends inside its first `width` words is alone with its rank already, so the
        # place `width` on lies in the same text or is the first beyond it, with a rank of another
        beyond = open_ + width
        inside = beyond < n
        second = np.where(inside, rank[np.minimum(beyond, n - 1)] + 1, 0)
        second[inside & (doc[np.minimum(beyond, n - 1)] != doc[open_])] = 0
        by = np.lexsort((second, rank[open_]))
        open_, second = open_[by], second[by]
        order[at] = open_
        before = rank[open_]
        new = np.ones(len(at), bool)
        new[1:] = (before[1:] != before[:-1]) | (second[1:] != second[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        rank[open_] = at[head]
        out.append(rank.copy())
        width *= 2


def neighbours_lcp(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Common words of each suffix and the next one in the order, by halving the levels' widths."""
    n = len(order)
    i, j = order[:-1].copy(), order[1:].copy()
    length = np.zeros(n - 1, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        padded = np.append(ranks[k], -1)
        same = padded[i] == padded[j]
        step = same.astype(np.int64) << k
        i, j, length = i + step, j + step, length + step
    return length


def seeds(first: list[int], second: list[int], common: list[int],
          word: list[int], begins: list[bool], shortest: int) -> list[tuple[int, int, int]]:
    """Kruskal over edges (first, second, common), given by falling `common`."""
    root: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    found = []

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    def pair(i: int, j: int, length: int) -> None:
        d = j - i
        if d <= length and d + length >= shortest and (begins[i] or word[i - 1] != word[j - 1]):
            found.append((i, d + length, d))

    for a, b, length in zip(first, second, common):
        a, b = find(a), find(b)
        large, small = members.pop(a, None) or [a], members.pop(b, None) or [b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        root[b] = a
        # members of the small set that fall into one gap of the large one are neighbours already
        last, gap = None, -1
        for p in small:
            k = bisect_left(large, p)
            if k != gap:
                if last is not None and gap < len(large):
                    pair(last, large[gap], length)
                if k:
                    pair(large[k - 1], p, length)
            last, gap = p, k
        if gap < len(large):
            pair(last, large[gap], length)
        if len(small) * 8 > len(large):
            large += small
            large.sort()
        else:
            for p in small:
                insort(large, p)
        members[a] = large
    return found


def repeating(word: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the texts in which some `width` words (may) come twice; never misses one."""
    n = len(word) - width + 1
    if n < 2:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = doc[:n].astype(np.uint64) * _HASH
        for k in range(width):
            h = (h ^ (h >> np.uint64(29))) * _HASH + word[k:k + n].astype(np.uint64)
        h *= _HASH
    inside = doc[:n] == doc[width - 1:]
    h, owner = h[inside], doc[:n][inside]
    by = np.argsort(h)
    same = h[by[1:]] == h[by[:-1]]
    return np.unique(owner[by[1:][same]])


def runs(texts: list[np.ndarray], shortest: int = SHORTEST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text of word numbers, by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    size = np.array([len(t) for t in texts], np.int64)
    if not size.sum():
        return out
    word = np.concatenate(texts).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), size)
    # the least LCP a run's start and the place one period on can have
    least = (shortest + 1) // 2
    wanted = repeating(word, doc, least)
    if not len(wanted):
        return out
    keep = np.isin(doc, wanted)
    word, doc = word[keep], doc[keep]
    order, ranks = levels(word, doc)
    common = neighbours_lcp(order, ranks)
    edge = np.flatnonzero(common >= least)
    edge = edge[np.argsort(-common[edge], kind="stable")]
    begins = np.ones(len(doc), bool)
    begins[1:] = doc[1:] != doc[:-1]
    base = np.flatnonzero(begins)
    first_of = dict(zip(doc[base].tolist(), base.tolist()))
    owner = doc.tolist()
    for start, length, period in seeds(
            order[edge].tolist(), order[edge + 1].tolist(), common[edge].tolist(),
            word.tolist(), begins.tolist(), shortest):
        d = owner[start]
        out[d].append((start - first_of[d], length, period))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def edited(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The text that is searched: for a tenth of the ids the words from one on repeat a stretch."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    stretch = words[a:a + p]
    return words[:a] + (stretch * ((n - a) // p + 1))[:n - a]


def numbered(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Words as numbers, equal for equal words."""
    flat = pa.array([w for t in texts for w in t], pa.binary())
    number = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return np.split(number, np.cumsum([len(t) for t in texts])[:-1])


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not found:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    start, length, period = np.array(found).T
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    return list(compress(words, (np.cumsum(depth[:-1]) == 0).tolist()))


def _chunks(ids, texts: list[bytes], edit: bool):
    """(ids, words of each text) with about `CHUNK_WORDS` words at a time."""
    some_ids, some, n = [], [], 0
    for i, t in zip(ids, texts):
        w = t.split()
        some_ids.append(i)
        some.append(edited(w, i) if edit else w)
        n += len(w)
        if n >= CHUNK_WORDS:
            yield some_ids, some
            some_ids, some, n = [], [], 0
    if some:
        yield some_ids, some


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         shortest: int = SHORTEST) -> DataFrame:
    """(id, start, length, period): every run of every text."""

    def run(batches):
        for b in batches:
            for ids, texts in _chunks(b.column(0).to_pylist(), raw(b.column(1)), False):
                got = [(i, *r) for i, rs in zip(ids, runs(numbered(texts), shortest)) for r in rs]
                columns = list(zip(*got)) or [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns],
                    ["id", "start", "length", "period"])

    return by_batches(narrow(df, id_col, text_col), run,
                      "id bigint, start bigint, length bigint, period bigint")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of the edited texts: runs, the longest one, digests of all runs and of the rest."""

    def row(i, words, found):
        start, length, period = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found \
            else (None, None, None)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        return (i, len(found), start, length, period, found and 1000 * length // period or None,
                hashlib.sha256(lines.encode()).hexdigest(),
                hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest())

    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
             "collapsed_sha256"]

    def run(batches):
        for b in batches:
            for ids, texts in _chunks(b.column(0).to_pylist(), raw(b.column(1)), True):
                got = list(zip(*map(row, ids, texts, runs(numbered(texts)))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.string() if k > 5 else pa.int64()) for k, c in enumerate(got)],
                    names)

    return by_batches(
        narrow(df, id_col, text_col), run,
        "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, "
        "exponent_milli bigint, runs_sha256 string, collapsed_sha256 string")
