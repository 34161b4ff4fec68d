"""Train / val / test splits as one added column.

The split of a row follows from its key and two cut keys per class, so the wide table is never
shuffled: only the narrow keys around the cuts are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentivane.operators.ordering import exact_floor, rank_cuts, running_totals
from sentivane.session import stage


def tie_key(id_col: Column, seed: int | str | None = None) -> Column:
    """A spread-out key: md5 of the id, behind a seed if given."""
    text = id_col.cast("string")
    return F.md5(text if seed is None else F.concat(F.lit(f"{seed}|"), text))


def _check_ratios(train: float, val: float, test: float) -> None:
    if abs(train + val + test - 1.0) >= 1e-5:
        raise ValueError("ratios must sum to 1")


def _below(key: Column, cut: Column | None) -> Column:
    return F.lit(True) if cut is None else key < cut


def _as_number(ts: Column, kind: T.DataType) -> Column:
    """Times as microseconds: cuts pass the driver, whose time zone must not move them."""
    return F.unix_micros(ts) if isinstance(kind, T.TimestampType) else ts


def chronological_key(ts: Column, id_col: Column) -> Column:
    return F.struct(ts.alias("ts"), tie_key(id_col).alias("tie"))


def split_chronological(
    df: DataFrame, ts: str = "timestamp", id_col: str = "post_id",
    train: float = 0.70, val: float = 0.15,
) -> DataFrame:
    """First part of the time order train, next val, rest test; equal times by md5 of the id.

    Ids must be unique.  Rows without a timestamp sort first.
    """
    when = _as_number(F.col(ts), df.schema[ts].dataType)
    keys = df.select(
        F.to_date(ts).alias("day"), when.alias("ts"), tie_key(F.col(id_col)).alias("tie"))
    n = df.count()
    ends = [exact_floor(n, train), exact_floor(n, train + val)]
    cuts = rank_cuts(keys, ["day"], ["ts", "tie"], [k for k in ends if k < n])
    key = chronological_key(when, F.col(id_col))

    def cut(k: int) -> Column | None:
        if k not in cuts:
            return None
        at, tie = cuts[k]
        return F.struct(
            F.lit(at).cast(keys.schema["ts"].dataType).alias("ts"), F.lit(tie).alias("tie"))

    return df.withColumn(
        "split",
        F.when(_below(key, cut(ends[0])), "train")
        .when(_below(key, cut(ends[1])), "val").otherwise("test"),
    )


def largest_remainder(counts: DataFrame, total: int, whole: int, size: str, out: str) -> DataFrame:
    """Adds `out`: `total` shared among the rows in proportion to `size` (which sums up to `whole`).

    What the whole parts leave over goes to the largest remainders; ties go to the lower label.
    """
    if not whole:
        return counts.withColumn(out, F.lit(0).cast("bigint"))
    share = F.col(size).cast("decimal(20,0)") * F.lit(total).cast("decimal(18,0)")
    parts = counts.withColumn(out, F.expr(f"CAST({size} AS DECIMAL(20,0)) * {total} DIV {whole}")) \
        .withColumn("_rest", share % whole)
    left = total - parts.agg(F.sum(out)).first()[0]
    if not left:
        return parts.drop("_rest")
    ranked = running_totals(
        parts.withColumn("_less", -F.col("_rest")).withColumn("_one", F.lit(1)),
        ["_less", "label"], "_one")
    return ranked.withColumn(
        out, F.col(out) + (F.col("before") < left).cast("bigint")
    ).drop("_rest", "_less", "_one", "before")


def _class_cuts(keys: DataFrame, wanted: DataFrame) -> DataFrame:
    """(label, kind, h): the key at each wanted position inside its class.

    `wanted` has (label, kind, rank).  A histogram over the first digits of the key (a bounded number
    of cells per class) finds the cells that hold the positions; only the keys there are sorted.
    """
    cells = keys.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("label").orderBy("cell").rowsBetween(
        Window.unboundedPreceding, -1)
    spans = cells.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    spots = spans.join(wanted, "label").filter(
        "before <= rank AND rank < before + n").select(
        "label", "cell", "kind", (F.col("rank") - F.col("before")).alias("spot"))
    near = keys.join(spots.select("label", "cell").distinct(), ["label", "cell"], "left_semi")
    placed = near.withColumn("at", F.row_number().over(
        Window.partitionBy("label", "cell").orderBy("h")) - 1)
    return placed.join(spots, ["label", "cell"]).filter("at = spot").select("label", "kind", "h")


def split_stratified(
    df: DataFrame, label: str | None = "sentiment_label", id_col: str = "post_id",
    train: float = 0.70, val: float = 0.15, test: float = 0.15, seed: int = 42,
) -> DataFrame:
    """Random split keeping the class shares; a plain random one if any label is missing.

    Random means: in order of md5(seed | id) inside each class.  Sizes and cut keys are tables with
    one row per class, so there may be any number of classes.
    """
    _check_ratios(train, val, test)
    name = F.col(label) if label in df.columns else F.lit(None).cast("string")
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(name.isNull()).alias("missing")).first()
    if seen["missing"]:
        name = F.lit("all")
    n = seen["n"]
    n_train = exact_floor(n, train)
    n_val = exact_floor(n - n_train, val / (val + test))
    counts = df.groupBy(name.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    first = largest_remainder(counts, n_train, n, "n", "first").withColumn(
        "rest", F.col("n") - F.col("first"))
    sizes = stage(largest_remainder(first, n_val, n - n_train, "rest", "second"), "quotas")
    # a cut at the end of its class is no cut
    wanted = sizes.select("label", "n", F.explode(F.array(
        F.struct(F.lit("train").alias("kind"), F.col("first").cast("bigint").alias("rank")),
        F.struct(F.lit("val").alias("kind"),
                 (F.col("first") + F.col("second")).cast("bigint").alias("rank")),
    )).alias("c")).select("label", "n", "c.*").filter("rank < n").drop("n")
    h = tie_key(F.col(id_col), seed)
    keys = df.select(name.alias("label"), h.alias("h")).withColumn("cell", F.substring("h", 1, 4))
    cuts = stage(_class_cuts(keys, wanted), "cuts").groupBy(F.col("label").alias("_label")).agg(
        F.max(F.when(F.col("kind") == "train", F.col("h"))).alias("_train"),
        F.max(F.when(F.col("kind") == "val", F.col("h"))).alias("_val"))
    split = F.when(F.col("_train").isNull() | (h < F.col("_train")), "train").when(
        F.col("_val").isNull() | (h < F.col("_val")), "val").otherwise("test")
    # one short row per class: the planner broadcasts it unless there are very many
    return df.join(cuts, name == F.col("_label"), "left").select(
        *[df[c] for c in df.columns], split.alias("split"))


def create_splits(
    df: DataFrame, strategy: str = "stratified", ts: str = "timestamp",
    label: str = "sentiment_label", id_col: str = "post_id",
    train: float = 0.70, val: float = 0.15, test: float = 0.15, seed: int = 42,
) -> DataFrame:
    _check_ratios(train, val, test)
    if strategy == "chronological" and ts in df.columns:
        return split_chronological(df, ts, id_col, train, val)
    return split_stratified(df, label, id_col, train, val, test, seed)
