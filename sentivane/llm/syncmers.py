"""Document fingerprints of closed syncmers.

A k-mer of a text's bytes is an anchor if its least s-mer (by hash) is its first or its last: a
property of the k-mer alone, so an edit elsewhere never moves an anchor.  One of any `K` - `S` + 1
k-mers in a row is an anchor, about 2 in as many.  The fingerprint holds all anchors of the text, in
their order: per anchor 12 hex digits of hash and 2 of the distance from the anchor before (the first
from the text's beginning), which that bound keeps small.  It is a function of the text, so equal
texts have equal fingerprints.

Likeness of two fingerprints: of the different hashes of both together the share that both have,
counting only matches whose (first) positions rise together.  A text too short for an anchor has the
hash of the whole text at position 0.  Null counts as empty; an empty text has an empty fingerprint,
like only to another empty one.

The following document of each one (by ascending id, the first after the last) comes from one shuffle
of the texts: ids are cut into ranges, each range is sorted in its task, and a copy of the next
range's first document closes it.  Rows of one id are ordered by the hash of their text; rows without
an id come first.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentivane.llm.texts import by_batches, narrow

K, S = 32, 8
ROWS_IN_RANGE = 1_000
# The cuts between ranges are held by the driver and the tasks; beyond that, ranges grow.
MAX_RANGES = 100_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _A
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    return x


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all closed syncmers and the hashes of their k-mers."""
    n = len(text)
    if n >= K:
        grams = np.ndarray((n - S + 1,), "<u8", text, strides=(1,)).copy()
        s = _mix(grams)
        low, width = s, 1  # least of the s-mers of each k-mer, over windows that double
        while 2 * width <= K - S + 1:
            low, width = np.minimum(low[:-width], low[width:]), 2 * width
        more = K - S + 1 - width
        low = np.minimum(low[:len(low) - more], low[more:])
        at = np.flatnonzero((s[:len(low)] == low) | (s[K - S:] == low))
        if len(at):
            h = np.zeros(len(at), np.uint64)
            for k in range(0, K, S):
                h = _mix(h ^ grams[at + k])
            return at, h
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    whole = int.from_bytes(hashlib.sha256(text).digest()[:8], "little")
    return np.zeros(1, np.int64), np.array([whole], np.uint64)


@dataclass(frozen=True)
class Sketch:
    """All anchors of a text: positions and 48-bit hashes in text order, and the different hashes."""

    at: np.ndarray
    hashes: np.ndarray

    @cached_property
    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Rising hashes and the first position of each."""
        h, first = np.unique(self.hashes, return_index=True)
        return h, self.at[first]

    def hex(self) -> str:
        out = np.empty((len(self.at), 7), np.uint8)
        out[:, :6] = self.hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
        out[:, 6] = np.diff(self.at, prepend=0)
        return out.tobytes().hex()


def sketch(text: bytes) -> Sketch:
    at, h = anchors(text)
    return Sketch(at, h >> np.uint64(16))


def of_text(fingerprint: str) -> Sketch:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 7)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw[:, :6]
    return Sketch(np.cumsum(raw[:, 6].astype(np.int64)),
                  wide.reshape(-1).view(">u8").astype(np.uint64))


def likeness(a: Sketch, b: Sketch) -> float:
    if not len(a.at) or not len(b.at):
        return float(len(a.at) == len(b.at))
    (x, x_at), (y, y_at) = a.distinct, b.distinct
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    there = y_at[j[np.argsort(x_at[i])]]
    chain: list[int] = []  # longest row of matches with rising positions
    if (np.diff(there) > 0).all():
        chain = there
    else:
        for p in there.tolist():
            k = bisect_left(chain, p)
            chain[k:k + 1] = [p]
    return len(chain) / (len(x) + len(y) - len(both))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row."""

    def run(batches):
        for b in batches:
            f = [sketch((t or "").encode()).hex() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, pa.string())],
                                             ["doc_id", "fingerprint"])

    return by_batches(narrow(df, id_col, text_col), run, "doc_id bigint, fingerprint string")


def with_next(docs: DataFrame, rows_in_range: int = ROWS_IN_RANGE) -> DataFrame:
    """(range, closing, id, text): ranges of rising ids, each closed by the next one's first row."""
    n = docs.count()
    ranges = min(MAX_RANGES, n // rows_in_range + 1)
    cuts = docs.agg(F.percentile_approx(
        "id", [k / ranges for k in range(1, ranges)], max(10_000, 10 * ranges))).first()[0] \
        if ranges > 1 else None
    edge = np.array(cuts or [], np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        have = ids.notna().to_numpy()
        out = np.zeros(len(ids), np.int32)
        out[have] = np.searchsorted(edge, ids[have].to_numpy(np.int64), side="right")
        return pd.Series(out)

    placed = docs.select(range_of("id").alias("range"), F.lit(False).alias("closing"), "id", "text")
    # one row per range: the ranges that have rows, and the least id of each (null is less)
    found = docs.select(range_of("id").alias("range"), "id").groupBy("range").agg(
        F.min("id").alias("least"), F.max(F.col("id").isNull()).alias("null")).collect()
    found = sorted((r["range"], None if r["null"] else r["least"]) for r in found) \
        if found else []
    after = {head: found[k - 1][0] for k, (_, head) in enumerate(found)}  # the last before the first
    heads = docs.sparkSession.createDataFrame(
        pa.table({"head": pa.array(list(after), pa.int64()),
                  "range": pa.array(list(after.values()), pa.int32())}))
    # at most MAX_RANGES rows
    first = docs.join(F.broadcast(heads), F.col("id").eqNullSafe(F.col("head"))).groupBy(
        "range", "id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return placed.union(first.select("range", F.lit(True), "id", "text"))


def edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           rows_in_range: int = ROWS_IN_RANGE) -> DataFrame:
    """Every text beside its edited text (its last quarter replaced by the beginning of the next)."""

    def row(doc, own, text, other):
        n = len(text)
        changed = (text[:n - n // 4] + other[0][:n // 4]).encode()
        new = sketch(changed)
        return (doc, n, hashlib.sha256(changed).hexdigest(), own.hex(), new.hex(),
                likeness(own, new), likeness(own, other[1]))

    def run(batches):
        last = None  # (range, id, fingerprint, text) that waits for its next
        for b in batches:
            out = []
            for part, closing, doc, text in zip(*(c.to_pylist() for c in b.columns)):
                text = text or ""
                own = sketch(text.encode())
                if last is not None and last[0] == part:
                    out.append(row(*last[1:], (text, own)))
                last = None if closing else (part, doc, own, text)
            columns = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)

    rows = with_next(narrow(df, id_col, text_col), rows_in_range)
    order = rows.repartition("range").sortWithinPartitions(
        "range", "closing", "id", F.xxhash64("text"))
    return by_batches(
        order, run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double")


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
          "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(),
          pa.float64()]
