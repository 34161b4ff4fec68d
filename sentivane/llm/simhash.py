"""Near-duplicates by SimHash with an exact, tiled comparison of all fingerprints.

A text's fingerprint has a bit set where over half of its shingle hashes have it.  Equal fingerprints
fold into one class first.  Classes are dealt by population count into strips of bounded size; every
two strips whose counts differ by no more than the radius meet in one task.  There, tiles of
fingerprints sorted by the population counts of their four 16-bit parts are compared by exclusive-or
and bit count; a tile pair is skipped when its counts, part by part, differ by more than the radius
in sum (differing bits are at least that many, so no pair is lost).  A task returns a spanning forest
of what it linked, never all pairs, and distributed components join the forests.

The number of comparisons is quadratic in the number of different fingerprints within nearby
population counts: that is the price of an exact answer without candidate buckets.

Texts without a word, and null texts, have fingerprint zero and are linked like any other.  Rows
without an id get the group of their fingerprint; a group without any id has a null component.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentivane.llm.components import components
from sentivane.llm.texts import LOWER, by_batches, narrow, raw
from sentivane.session import stage

SHINGLE = 4
RADIUS = 4
STRIP = 16_384
TILE = 256


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """As a signed 64-bit number."""
    w = text.translate(LOWER).split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= k:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        starts = list(accumulate(map(len, w), lambda at, n: at + n + 1, initial=0))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b - 1], 42) for a, b in zip(starts, starts[k:])]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1)
    over = 2 * np.add.reduce(bits, axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over).view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 k: int = SHINGLE) -> DataFrame:
    """(id, fp) of every row."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([fingerprint(t, k) for t in raw(b.column(1))], pa.int64())],
                ["id", "fp"])

    return by_batches(narrow(df, id_col, text_col), run, "id bigint, fp bigint")


class _Sets:
    """Groups of positions that are linked; every position knows its group's least one."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.label[a], self.label[b]
        new = x != y
        if not new.any():
            return
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            while (p := parent.get(v, v)) != v:
                parent[v] = parent.get(p, p)
                v = p
            return v

        for u, v in np.unique(np.stack([x[new], y[new]], 1), axis=0).tolist():
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
        to = np.arange(len(self.label))
        old = list(parent)
        to[old] = [root(v) for v in old]
        self.label = to[self.label]


def _tiles(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the counts of the parts; least and largest counts of each tile of that order."""
    parts = np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int16)
    order = np.lexsort(parts.T[::-1])
    cuts = np.arange(0, len(fp), TILE)
    return (order, np.minimum.reduceat(parts[order], cuts), np.maximum.reduceat(parts[order], cuts))


def linked(left: np.ndarray, right: np.ndarray | None, radius: int) -> np.ndarray:
    """Labels of all positions (left, then right) after linking every pair within the radius.

    Without `right` the pairs lie within `left`.
    """
    n = len(left)
    sets = _Sets(n + (0 if right is None else len(right)))
    order_a, low_a, high_a = _tiles(left)
    order_b, low_b, high_b = (order_a, low_a, high_a) if right is None else _tiles(right)
    other, shift = (left, 0) if right is None else (right, n)
    a, b = left[order_a], other[order_b]
    for i in range(len(low_a)):
        gap = np.maximum(np.maximum(low_b - high_a[i], low_a[i] - high_b), 0).sum(1)
        near = np.flatnonzero(gap <= radius)
        rows = a[i * TILE:(i + 1) * TILE, None]
        for j in near[near >= i] if right is None else near:
            hit = np.bitwise_count(rows ^ b[None, j * TILE:(j + 1) * TILE]) <= radius
            if hit.any():
                x, y = np.nonzero(hit)
                sets.link(order_a[i * TILE + x], shift + order_b[j * TILE + y])
    return sets.label


def _forest(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    fp = pdf["fp"].to_numpy()
    second = pdf["second"].to_numpy()
    fp = np.concatenate([fp[~second], fp[second]])
    codes, n = fp.astype(np.int64).view(np.uint64), int((~second).sum())
    label = linked(codes[:n], codes[n:] if n < len(codes) else None, radius)
    child = np.flatnonzero(label != np.arange(len(label)))
    return pd.DataFrame({"a": fp[child], "b": fp[label[child]]})


def links(classes: DataFrame, radius: int = RADIUS, strip: int = STRIP) -> DataFrame:
    """Edges (a, b) between different fingerprints that connect whatever lies within the radius."""
    counted = classes.select("fp", F.bit_count("fp").alias("ones"))
    # at most 65 rows: how many fingerprints have each population count
    size = {r["ones"]: r["n"] for r in
            counted.groupBy("ones").agg(F.count("*").alias("n")).collect()}
    strips = F.create_map(*[F.lit(int(x)) for p in range(65)
                            for x in (p, -(-size.get(p, 0) // strip))])
    own = counted.withColumn(
        "strip", F.pmod(F.xxhash64("fp"), F.greatest(strips[F.col("ones")], F.lit(1))).cast("int"))
    there = F.filter(F.sequence(F.col("ones") - radius, F.col("ones") + radius),
                     lambda q: (q >= 0) & (q <= 64) & (strips[q] > 0))
    partners = F.flatten(F.transform(there, lambda q: F.transform(
        F.sequence(F.lit(0), strips[q] - 1),
        lambda t: F.struct(q.alias("ones"), t.alias("strip")))))
    me = F.struct("ones", "strip")
    met = own.select("fp", me.alias("me"), F.explode(partners).alias("you")).select(
        "fp", F.least("me", "you").alias("first"), F.greatest("me", "you").alias("last"),
        (F.col("me") > F.col("you")).alias("second"))
    return met.groupBy("first", "last").applyInPandas(
        lambda pdf: _forest(pdf, radius), "a bigint, b bigint")


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
           radius: int = RADIUS, strip: int = STRIP) -> DataFrame:
    """(id, fp, component): one row per row of `df` with the least id of its group."""
    rows = stage(fingerprints(df, id_col, text_col, k), "fingerprints")
    classes = stage(rows.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    member = components(links(classes, radius, strip))
    of = stage(classes.join(member.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("group")), "groups")
    least = of.groupBy("group").agg(F.min("least").alias("component"))
    known = of.join(least, "group").select("fp", "component")
    return rows.join(known, "fp").select("id", "fp", "component")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
             radius: int = RADIUS) -> DataFrame:
    """The document with the least id of every group, with all its columns.

    Rows that repeat that id count as one document, any of them stays.  Rows without an id can't be
    named by a group and stay.
    """
    taken = {c.lower() for c in df.columns}
    own, again = (next(n for i in range(len(taken) + 1) if (n := f"{base}{i}") not in taken)
                  for base in ("_kept_id", "_kept_again"))
    stay = groups(df, id_col, text_col, k, radius).filter("id = component").groupBy(
        F.col("id").alias(own)).agg((F.count("*") > 1).alias(again))
    kept = df.join(stay, F.col(id_col).cast("bigint") == F.col(own))
    alone = kept.filter(~F.col(again)).select(df.columns)
    repeated = kept.filter(F.col(again)).select(df.columns).dropDuplicates([id_col])
    return alone.union(repeated).union(df.filter(F.col(id_col).isNull()))
