"""Exact duplicates and overlap between splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentivane.session import stage

# Bits of one bitmap of bitmap_construct_agg (4 KB), and how many bitmaps make the filter: 16 MB.
BITMAP_BITS = 32_768
BITMAPS = 4_096


def first_per_text(df: DataFrame, text: str, order: str, bitmaps: int = BITMAPS) -> DataFrame:
    """One row per text: the one with the lowest `order`, which must be unique.

    The rows are computed and written once, with a digest of their text.  Digests fold by a hash
    aggregate on narrow rows, where a text copied a billion times is one row per task.  Those seen
    twice set bits in a filter of fixed size; rows that miss it are unique and stay where they
    are, the others meet the lowest order of their digest.  A full filter costs an exchange of
    more rows, never a result.  A null text counts as a text of its own; rows without an order
    are left out.
    """
    rows = stage(df.filter(F.col(order).isNotNull()).select(
        F.struct(*df.columns).alias("row"), F.col(order).alias("order"),
        F.coalesce(digest(F.col(text)), F.lit("")).alias("digest")), "texts")
    twice = stage(
        rows.groupBy("digest").agg(F.min("order").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("digest", "first"), "twice")
    marked = seen_in(rows, seen_filter(twice, "digest", bitmaps), "digest", bitmaps)
    alone = marked.filter(~F.col("seen")).select("row")
    copies = marked.filter("seen").join(twice, "digest", "left").filter(
        F.col("first").isNull() | (F.col("order") == F.col("first"))).select("row")
    return alone.unionAll(copies).select("row.*")


def _bit(key: str, bitmaps: int) -> tuple[Column, Column]:
    """The bitmap of a key and its bit there."""
    place = F.pmod(F.xxhash64(key), F.lit(bitmaps * BITMAP_BITS))
    return F.floor(place / BITMAP_BITS).cast("int"), F.pmod(place, F.lit(BITMAP_BITS))


def seen_filter(keys: DataFrame, key: str, bitmaps: int = BITMAPS) -> DataFrame:
    """(bitmap, bits): a filter with one hash function, at most `bitmaps` rows of 4 KB."""
    which, bit = _bit(key, bitmaps)
    return keys.groupBy(which.alias("bitmap")).agg(F.bitmap_construct_agg(bit).alias("bits"))


def seen_in(df: DataFrame, bits: DataFrame, key: str, bitmaps: int = BITMAPS) -> DataFrame:
    """Adds `seen`: false only if the filter surely does not hold the key."""
    which, bit = _bit(key, bitmaps)
    byte = F.conv(F.hex(F.substr("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10)
    on = byte.cast("int").bitwiseAND(
        F.pow(F.lit(2), F.pmod(bit, F.lit(8))).cast("int")) > 0
    # the filter's size is fixed: bitmaps * 4 KB
    return df.withColumn("bitmap", which).join(F.broadcast(bits), "bitmap", "left").withColumn(
        "seen", F.coalesce(on, F.lit(False))).drop("bitmap", "bits")


def digest(text: Column) -> Column:
    """SHA-256, so that texts are told apart by 64 characters; null as null."""
    return F.sha2(text, 256)


def split_overlap(df: DataFrame, key: Column, split: str = "split") -> DataFrame:
    """Keys shared by each pair of splits, in one pass."""
    names = ["train", "val", "test"]
    seen = df.groupBy(digest(key).alias("_k")).agg(
        *[F.max((F.col(split) == s).cast("int")).alias(s) for s in names]
    )
    pairs = [("train", "val"), ("train", "test"), ("val", "test")]
    counts = seen.agg(*[
        F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).cast("bigint").alias(f"{a}_{b}")
        for a, b in pairs
    ])
    stacked = ", ".join(f"'{a}_{b}', {a}_{b}" for a, b in pairs)
    return counts.selectExpr(f"stack({len(pairs)}, {stacked}) AS (pair, shared)")
