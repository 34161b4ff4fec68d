"""Classifier evaluation on long prediction tables.

Predictions fold to (group, truth, pred, n) first; that table has classes x classes rows per
group, and every score is arithmetic on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentivane.functions.labels import canonical
from sentivane.operators.ordering import running_totals
from sentivane.vocab import CLASSES, THETA_GRID


def prediction_counts(
    rows: DataFrame, by: Sequence[str] = (), truth: str = "truth", pred: str = "pred",
    extra: Sequence[Column] = (),
) -> DataFrame:
    """(by..., truth, pred, n): labels brought to the canonical spelling, then counted."""
    return rows.groupBy(
        *by, canonical(F.col(truth)).alias("truth"), canonical(F.col(pred)).alias("pred")
    ).agg(F.count(F.lit(1)).alias("n"), *extra)


def _grid(rows: DataFrame, by: Sequence[str], cells: Sequence[Column]) -> DataFrame:
    """Every cell for every group; without groups, every cell."""
    listed = F.explode(F.array(*cells)).alias("_cell")
    groups = rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()
    return groups.select(*by, listed).select(*by, "_cell.*")


def confusion_matrix(
    counts: DataFrame, labels: Sequence[str] = CLASSES, normalise: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """(by..., truth, pred, n) over the fixed class grid, 0 where nothing fell."""
    by = list(by)
    grid = _grid(counts, by, [F.struct(F.lit(t).alias("truth"), F.lit(p).alias("pred"))
                              for t in labels for p in labels])
    seen = counts.groupBy(*by, "truth", "pred").agg(F.sum("n").alias("n"))
    full = grid.join(seen, [*by, "truth", "pred"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0)).cast("bigint")
    )
    if normalise:
        rows = full.groupBy(*by, "truth").agg(F.sum("n").alias("_row"))
        full = full.join(rows, [*by, "truth"]).select(
            *by, "truth", "pred", "n", F.try_divide("n", "_row").alias("share")
        )
    return full


def metrics_from_counts(
    counts: DataFrame, by: Sequence[str] = (), labels: Sequence[str] = CLASSES, digits: int = 4,
    means: Sequence[str] = (),
) -> DataFrame:
    """Accuracy, balanced accuracy, macro / weighted P, R, F1 and per-class scores.

    Macro scores divide by the number of `labels`, also where a class does not occur; an empty
    class scores 0.  Balanced accuracy averages recall over all classes present in the truth.
    `means` are columns of sums over the counted rows; each gives a `mean_` column.
    """
    by = list(by)
    n, truth, pred = F.col("n"), F.col("truth"), F.col("pred")
    per_truth = counts.groupBy(*by, "truth").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(truth == pred, n).otherwise(0)).alias("hits"),
        *[F.sum(F.when(pred == c, n).otherwise(0)).alias(f"as_{c}") for c in labels],
        *[F.sum(m).alias(f"_sum_{m}") for m in means],
    )
    sums = [
        F.sum("rows").alias("total"), F.sum("hits").alias("_hits"),
        F.avg(F.col("hits") / F.col("rows")).alias("_balanced"),
        *[F.sum(f"_sum_{m}").alias(f"_sum_{m}") for m in means],
    ]
    for c in labels:
        sums += [
            F.sum(F.when(truth == c, F.col("hits")).otherwise(0)).alias(f"_tp_{c}"),
            F.sum(f"as_{c}").alias(f"_pred_{c}"),
            F.sum(F.when(truth == c, F.col("rows")).otherwise(0)).alias(f"_true_{c}"),
        ]
    g = per_truth.groupBy(*by).agg(*sums)

    def safe(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    def total(columns) -> Column:
        return sum(columns, F.lit(0.0))

    precision, recall, f1, support = {}, {}, {}, {}
    for c in labels:
        tp, p, t = F.col(f"_tp_{c}"), F.col(f"_pred_{c}"), F.col(f"_true_{c}")
        precision[c], recall[c], f1[c], support[c] = safe(tp, p), safe(tp, t), safe(2 * tp, p + t), t
    all_support = total(support.values())

    def macro(x) -> Column:
        return total(x.values()) / len(labels)

    def weighted(x) -> Column:
        return safe(total(x[c] * support[c] for c in labels), all_support)

    def r(c: Column, name: str) -> Column:
        return F.round(c, digits).alias(name)

    return g.select(
        *by,
        *[F.round(F.col(f"_sum_{m}") / F.col("total"), 6).alias(f"mean_{m}") for m in means],
        r(F.col("_hits") / F.col("total"), "accuracy"),
        r(F.col("_balanced"), "balanced_accuracy"),
        r(macro(f1), "macro_f1"), r(weighted(f1), "weighted_f1"),
        r(macro(precision), "macro_precision"), r(weighted(precision), "weighted_precision"),
        r(macro(recall), "macro_recall"), r(weighted(recall), "weighted_recall"),
        *[col for c in labels for col in (
            r(precision[c], f"{c.lower()}_precision"), r(recall[c], f"{c.lower()}_recall"),
            r(f1[c], f"{c.lower()}_f1"), support[c].alias(f"{c.lower()}_support"))],
        F.col("total").alias("total_samples"),
    )


def classification_metrics(
    rows: DataFrame, by: Sequence[str] = (), truth: str = "truth", pred: str = "pred",
    labels: Sequence[str] = CLASSES, digits: int = 4,
) -> DataFrame:
    return metrics_from_counts(prediction_counts(rows, by, truth, pred), by, labels, digits)


def leaderboard(predictions: DataFrame) -> DataFrame:
    """One row per model, best macro F1 first."""
    m = classification_metrics(predictions, ["model"])
    return m.select(
        "model", "accuracy", "macro_f1", "weighted_f1",
        F.col("macro_precision").alias("precision"), F.col("macro_recall").alias("recall"),
    ).orderBy(F.desc("macro_f1"), F.asc("model"))


def best_model(board: DataFrame) -> DataFrame:
    """Highest macro F1; of equals the first name."""
    return board.orderBy(F.desc("macro_f1"), F.asc("model")).limit(1).select("model", "macro_f1")


def bin_edges(bins: int) -> list[float]:
    """Edges of equal bins on [0, 1], each the product the float division gives."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def calibration_bins(rows: DataFrame, confidence: str = "confidence", correct: str = "correct",
                     bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Per group and bin: size, mean accuracy and confidence, rows of the group.

    A confidence of exactly 1 lands in no bin but counts in the total; an empty bin shows
    accuracy 0 and its midpoint.
    """
    by = list(by)
    edges = bin_edges(bins)
    c = F.col(confidence)
    index = sum(((c >= e).cast("int") for e in edges), F.lit(0)) - 1
    g = rows.groupBy(*by, index.alias("bin")).agg(
        F.count(F.lit(1)).alias("size"),
        F.avg(F.col(correct).cast("double")).alias("accuracy"),
        F.avg(c).alias("confidence"),
    )
    grid = _grid(g, by, [F.struct(F.lit(i).alias("bin"),
                                  F.lit((edges[i] + edges[i + 1]) / 2).alias("middle"))
                         for i in range(bins)])
    total = g.groupBy(*by).agg(F.sum("size").alias("total"))
    binned = grid.join(g, [*by, "bin"], "left")
    binned = binned.join(total, by) if by else binned.withColumn("total", total.scalar())
    return binned.select(
        *by, "bin",
        F.coalesce("size", F.lit(0)).cast("bigint").alias("size"),
        F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"),
        F.coalesce("confidence", "middle").alias("confidence"),
        F.coalesce("total", F.lit(0)).cast("bigint").alias("total"),
    )


def calibration_error(binned: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Expected and maximum calibration error of `calibration_bins`."""
    gap = F.when(F.col("size") > 0, F.abs(F.col("accuracy") - F.col("confidence"))).otherwise(0.0)
    return binned.groupBy(*by).agg(
        F.sum(gap * F.try_divide("size", "total")).alias("ece"),
        F.max(gap).alias("mce"),
        F.max("total").alias("total_samples"),
    )


def theta_scores(rows: DataFrame, grid: Sequence[float] = THETA_GRID, score: str = "score",
                 truth: str = "truth") -> DataFrame:
    """Macro F1 of the threshold labels for every theta.

    The thetas cut the score axis into a few intervals in which all of them agree; rows fold to
    (truth, interval) first and the grid meets that small table.
    """
    grid = sorted(grid)
    s = F.col(score)
    above = sum(((s > t).cast("int") for t in grid), F.lit(0))
    below = sum(((s < -t).cast("int") for t in grid), F.lit(0))
    folded = rows.groupBy(truth, (above - below).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    per_theta = F.explode(F.array(*[
        F.struct(
            F.lit(float(t)).alias("theta"),
            F.when(F.col("step") > i, "BULLISH").when(F.col("step") < -i, "BEARISH")
            .otherwise("NEUTRAL").alias("pred"),
        )
        for i, t in enumerate(grid)
    ])).alias("v")
    counts = (
        folded.select(canonical(F.col(truth)).alias("truth"), "n", per_theta)
        .groupBy("v.theta", "truth", "v.pred").agg(F.sum("n").alias("n"))
    )
    return metrics_from_counts(counts, ["theta"]).select("theta", "macro_f1")


def best_theta(scores: DataFrame) -> DataFrame:
    """Theta with the highest macro F1, the smallest of equals."""
    return scores.agg(
        F.max_by("theta", F.struct(F.col("macro_f1"), -F.col("theta"))).alias("theta"),
        F.max("macro_f1").alias("macro_f1"),
    )


def regression_errors(rows: DataFrame, pred: str = "pred", target: str = "target") -> DataFrame:
    gap = F.col(pred) - F.col(target)
    return rows.agg(
        F.avg(gap * gap).alias("mse"), F.avg(F.abs(gap)).alias("mae"),
        F.avg(pred).alias("mean_predicted"), F.stddev_pop(pred).alias("std_predicted"),
        F.stddev_samp(target).alias("std_target"), F.count(F.lit(1)).alias("n"),
    )


def binary_metrics(rows: DataFrame, truth: str = "truth", score: str = "score",
                   cut: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, F1 and ROC-AUC of a 0/1 truth and a score.

    AUC by ranks: per distinct score the negatives below it, half of those beside it.
    """
    by = list(by)
    y, s = F.col(truth), F.col(score)
    values = rows.groupBy(*by, s.alias("value")).agg(
        F.sum(y).cast("bigint").alias("pos"), F.sum(1 - y).cast("bigint").alias("n")
    )
    ranked = running_totals(values, [*by, "value"])  # n, before: negatives
    # of the groups before this one, too: taken off below
    wins = F.sum(F.col("pos") * (F.col("before") + F.col("n") / F.lit(2.0)))
    up = F.col("value") > cut
    sums = ranked.groupBy(*by).agg(
        wins.alias("wins"), F.min("before").alias("start"), F.sum("pos").alias("pos"),
        F.sum("n").alias("neg"), F.sum(F.when(up, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(up, F.col("n")).otherwise(0)).alias("fp"))
    tp, fp, pos, neg = F.col("tp"), F.col("fp"), F.col("pos"), F.col("neg")
    return sums.select(
        *by, ((tp + neg - fp) / (pos + neg)).alias("accuracy"),
        F.coalesce(F.try_divide(F.col("wins") - F.col("start") * pos,
                                (pos * neg).cast("double")), F.lit(0.5)).alias("auc_roc"),
        F.coalesce(F.try_divide(2 * tp, tp + fp + pos), F.lit(0.0)).alias("f1_score"),
        (pos + neg).alias("n"),
    )


def fiqa_benchmark(predictions: DataFrame) -> DataFrame:
    """(dataset, model, truth, pred) to one score row each; macro over three classes."""
    return classification_metrics(predictions, ["dataset", "model"]).select(
        "dataset", "model", "accuracy", "macro_f1",
        F.col("macro_precision").alias("precision"), F.col("macro_recall").alias("recall"),
        F.col("total_samples").alias("samples"),
    )


