"""Misclassified posts: per model, across models, and their categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentivane.functions.errors import error_category_4, error_category_5
from sentivane.functions.text import preview, trim_ws
from sentivane.session import stage
from sentivane.vocab import ERROR_DEFAULT_4, ERROR_GROUPS_4

CATEGORIES_4 = [*[name for name, _ in ERROR_GROUPS_4], ERROR_DEFAULT_4]


def error_rows(predictions: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    return predictions.filter(~F.col(truth).eqNullSafe(F.col(pred)))


def diagnose(predictions: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """Errors of all models with their text category (four-group taxonomy).

    Predictions that carry the `text` need no posts: no join, one pass.  Otherwise only the posts
    with an error are looked at, each once, not once per model; the (narrow) errors are written once
    for both joins.
    """
    wrong = error_rows(predictions)
    category = error_category_4(F.col("text")).alias("error_category")
    if posts is not None:
        wrong = stage(wrong, "errors")
    else:
        return wrong.select(*[c for c in wrong.columns if c != "text"], category)
    failed = posts.join(wrong.select("post_id"), "post_id", "left_semi")
    return wrong.join(failed.select("post_id", category), "post_id")


def error_breakdown(errors: DataFrame, categories: Sequence[str] = CATEGORIES_4) -> DataFrame:
    """Errors per model (rows) and category (columns)."""
    return errors.groupBy("model").agg(*[
        F.count_if(F.col("error_category") == c).alias(c.lower()) for c in categories
    ])


def _norm(c: Column) -> Column:
    return F.upper(trim_ws(c.cast("string")))


def model_disagreement(
    posts: DataFrame, predictions: DataFrame, models: Sequence[str]
) -> DataFrame:
    """Per post: category, shortened text, every model's label and error flag, failing models.

    One grouped pass over the long predictions (the same work as a pivot on known names).
    """
    m, p = F.col("model"), F.col("pred")
    wrong = _norm(p) != _norm(F.col("truth"))
    per_post = predictions.groupBy("post_id").agg(
        *[x for name in models for x in (
            F.max(F.when(m == name, p)).alias(f"{name}_pred"),
            F.coalesce(F.bool_or(F.when(m == name, wrong)), F.lit(False)).alias(f"{name}_error"),
        )],
        F.count_if(wrong).alias("total_models_failing"),
        F.max("truth").alias("actual_label"),
    )
    text = posts.select(
        "post_id", preview(F.col("text")).alias("text"),
        error_category_5(F.col("text")).alias("error_category"),
    )
    return text.join(per_post, "post_id")
