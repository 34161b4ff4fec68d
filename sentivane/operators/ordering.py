"""Global order without a one-task window: running totals, exact quantiles, ranks, rank cuts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentivane.session import stage

# monotonically_increasing_id keeps the partition number above this bit.
_PARTITION_BIT = 33


def running_totals(df: DataFrame, keys: Sequence[str], amount: str = "n") -> DataFrame:
    """Adds `before`: the sum of `amount` over all rows whose keys sort lower.

    `df` has one row per key (aggregate first: that also takes the heat out of frequent values).
    A range-partitioned sort numbers the rows inside each partition, and only the sums per
    partition, one row each, are added up in one place.
    """
    keys = list(keys)
    numbered = stage(
        df.orderBy(*keys).withColumn("_row", F.monotonically_increasing_id()), "ordered"
    ).withColumn("_part", F.shiftright("_row", _PARTITION_BIT))
    parts = numbered.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = (
        Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        numbered.withColumn("_in", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        # one row per sort partition: as many as the shuffle has tasks
        .join(F.broadcast(offsets), "_part")
        .withColumn("before", (F.col("_offset") + F.col("_in")).cast("bigint"))
        .drop("_row", "_part", "_in", "_offset")
    )


def value_totals(df: DataFrame, column: str) -> DataFrame:
    """(value, n, before) for the non-null values of a column."""
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    )
    return running_totals(counts, ["value"])


def average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, rank) with ranks from 1 and ties averaged; one sort for all columns."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value"))
        for c in columns
    ])).alias("v")
    counts = (
        df.select(pairs).select("v.*").filter(F.col("value").isNotNull())
        .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    totals = running_totals(counts, ["column_name", "value"])
    first = totals.groupBy("column_name").agg(F.min("before").alias("start"))
    # one row per column
    return totals.join(F.broadcast(first), "column_name").select(
        "column_name", "value",
        (F.col("before") - F.col("start") + (F.col("n") + 1) / F.lit(2.0)).alias("rank"),
    )


def carried_ranks(df: DataFrame, row: str, columns: Sequence[str]) -> DataFrame:
    """(row, column_name, rank): tie-averaged ranks from 1 of every non-null value, with its row.

    One sort lays out all columns one after the other; a row's own number ends the sort key, so a
    frequent value spreads over many partitions.  Ranks are counted inside each partition.  Only
    the first and the last value of a partition can go on in a neighbour: their runs are added up
    over all partitions in a table of at most two rows per partition, which every row can meet.
    """
    values = F.explode(F.array(*[
        F.struct(F.lit(i).alias("column_no"), F.col(c).cast("double").alias("value"))
        for i, c in enumerate(columns)])).alias("v")
    laid = stage(
        df.select(F.col(row).alias("row"), values).select("row", "v.*")
        .filter(F.col("value").isNotNull()).orderBy("column_no", "value", "row")
        .withColumn("_row", F.monotonically_increasing_id()), "laid",
    ).withColumn("_part", F.shiftright("_row", _PARTITION_BIT))
    inside = Window.partitionBy("_part").orderBy("column_no", "value")
    placed = laid.select(
        "row", "column_no", "value", "_part",
        F.rank().over(inside).alias("low"), F.count(F.lit(1)).over(inside).alias("high"))
    # per partition: its rows, and the runs of its first and last value
    runs = laid.groupBy("_part", "column_no", "value").agg(F.count(F.lit(1)).alias("n"))
    run = F.struct("column_no", "value", "n")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stage(runs.groupBy("_part").agg(
        F.sum("n").alias("size"), F.min(run).alias("first"), F.max(run).alias("last"),
    ).withColumn("offset", F.coalesce(F.sum("size").over(earlier), F.lit(0))), "parts")
    edges = F.explode(F.array_distinct(F.array(
        F.struct("first.*", F.col("offset").alias("before")),
        F.struct("last.*", (F.col("offset") + F.col("size") - F.col("last.n")).alias("before")),
    ))).alias("edge")
    carried = parts.select(edges).select("edge.*").groupBy("column_no", "value").agg(
        F.min("before").alias("run_before"), F.sum("n").alias("run_n"))
    lower = Window.orderBy("column_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = laid.groupBy("column_no").agg(F.count(F.lit(1)).alias("n")).select(
        "column_no", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("start"))
    before = F.coalesce("run_before", F.col("offset") + F.col("low") - 1) - F.col("start")
    n = F.coalesce("run_n", F.col("high") - F.col("low") + 1)
    # one row per sort partition, two per sort partition, one per column
    return (
        placed.join(F.broadcast(parts.select("_part", "offset")), "_part")
        .join(F.broadcast(carried), ["column_no", "value"], "left")
        .join(F.broadcast(starts), "column_no")
        .select("row", F.get(F.array(*[F.lit(c) for c in columns]), F.col("column_no"))
                .alias("column_name"), (before + (n + 1) / F.lit(2.0)).alias("rank"))
    )


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> DataFrame:
    """One row with q0, q1, ...: exact quantiles, linear between neighbours."""
    totals = value_totals(df, column)
    size = totals.agg(F.max(F.col("before") + F.col("n"))).scalar()
    spots = totals.withColumn("size", size)
    out = []
    for i, p in enumerate(probabilities):
        spot = (F.col("size") - 1) * F.lit(float(p))
        low, high = F.floor(spot), F.ceil(spot)

        def at(k: Column) -> Column:
            inside = (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
            return F.max(F.when(inside, F.col("value").cast("double")))

        frac = F.max(spot - low)
        out.append((at(low) * (1 - frac) + at(high) * frac).alias(f"q{i}"))
    return spots.agg(*out)


def rank_cuts(
    df: DataFrame, coarse: Sequence[str], fine: Sequence[str], ranks: Sequence[int]
) -> dict[int, tuple]:
    """The fine key of the row at each rank (from 0) in the order (coarse, fine).

    `coarse` must be a non-decreasing function of the row order.  A histogram over it finds the
    cells that hold the ranks; only the rows of those cells are sorted.  The keys come back to
    the driver: one per rank.
    """
    ranks = sorted(set(ranks))
    if not ranks:
        return {}
    coarse, fine = list(coarse), list(fine)
    cells = running_totals(df.groupBy(*coarse).agg(F.count(F.lit(1)).alias("n")), coarse)

    def holds_any(wanted) -> Column:
        expr = F.lit(False)
        for k in wanted:
            expr = expr | ((F.col("before") <= k) & (F.lit(k) < F.col("before") + F.col("n")))
        return expr

    # at most one cell per rank comes back
    hit = sorted(cells.filter(holds_any(ranks)).collect(), key=lambda c: c["before"])
    inside: dict[int, int] = {}  # rank -> position among the rows of the hit cells
    start = 0
    for cell in hit:
        for k in ranks:
            if cell["before"] <= k < cell["before"] + cell["n"]:
                inside[k] = start + k - cell["before"]
        start += cell["n"]
    same_cell = F.lit(False)
    for cell in hit:
        here = F.lit(True)
        for c in coarse:
            here = here & F.col(c).eqNullSafe(F.lit(cell[c]))
        same_cell = same_cell | here
    order = [*coarse, *[c for c in fine if c not in coarse]]
    rows = df.filter(same_cell).groupBy(*order).agg(F.count(F.lit(1)).alias("n"))
    found = running_totals(rows, order).filter(holds_any(inside.values())).collect()
    return {
        k: tuple(row[c] for c in fine)
        for k, spot in inside.items() for row in found
        if row["before"] <= spot < row["before"] + row["n"]
    }


def exact_floor(n: int, share: float) -> int:
    return int(math.floor(n * share))
