"""Lexicon sentiment: token valences with negation and boosters, normalised to [-1, 1]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentivane.functions.labels import threshold_label
from sentivane.session import small_table
from sentivane.vocab import (
    BOOST_DAMPING,
    BOOST_STEP,
    BOOSTERS_DOWN,
    BOOSTERS_UP,
    LEXICON,
    LEXICON_THETA,
    NEGATION_FACTOR,
    NEGATIONS,
    NORM_ALPHA,
)

TOKEN = r"[a-z0-9_]+"


def default_lexicon(spark) -> DataFrame:
    return small_table(spark, LEXICON, "word string, valence double")


def tokens(text: Column) -> Column:
    """Lower-case tokens; apostrophes vanish, so don't and dont are one token."""
    return F.regexp_extract_all(
        F.replace(F.lower(text), F.lit("'"), F.lit("")), F.lit(TOKEN), F.lit(0)
    )


def _boost(word: Column, valence: Column, damping: float) -> Column:
    step = F.signum(valence) * F.lit(BOOST_STEP * damping)
    return (
        F.when(word.isin(BOOSTERS_UP), step).when(word.isin(BOOSTERS_DOWN), -step).otherwise(0.0)
    )


def lexicon_score(posts: DataFrame, lexicon: DataFrame | None = None, text: str = "text",
                  id_col: str = "post_id", theta: float = LEXICON_THETA) -> DataFrame:
    """(id, hits, valence, compound, label) for every post.

    Tokens carry their three predecessors, are exploded and matched with the lexicon; the planner
    broadcasts a lexicon that is small enough.  Only hits go on; their sum per post folds on the map
    side, so one short row per post is shuffled.
    """
    words = default_lexicon(posts.sparkSession) if lexicon is None else lexicon
    arr = F.col("_tokens")
    listed = posts.select(F.col(id_col), tokens(F.col(text)).alias("_tokens"))
    each = listed.select(
        id_col,
        F.explode(F.transform(arr, lambda t, i: F.struct(
            t.alias("word"), F.get(arr, i - 1).alias("p1"), F.get(arr, i - 2).alias("p2"),
            F.get(arr, i - 3).alias("p3"),
        ))).alias("t"),
    ).select(id_col, "t.*")
    v = F.col("valence")
    before = [F.coalesce(F.col(p), F.lit("")) for p in ("p1", "p2", "p3")]
    boosted = v + sum(
        (_boost(p, v, d) for p, d in zip(before, BOOST_DAMPING)), F.lit(0.0)
    )
    negated = before[0].isin(NEGATIONS) | before[1].isin(NEGATIONS) | before[2].isin(NEGATIONS)
    final = F.when(negated, boosted * NEGATION_FACTOR).otherwise(boosted)
    sums = each.join(words, "word").groupBy(id_col).agg(
        F.count("valence").alias("hits"),
        F.coalesce(F.sum(final), F.lit(0.0)).alias("valence"),
    )
    # posts without a hit come back by their ids alone
    sums = posts.select(id_col).distinct().join(sums, id_col, "left").select(
        id_col, F.coalesce("hits", F.lit(0)).alias("hits"),
        F.coalesce("valence", F.lit(0.0)).alias("valence"))
    total = F.col("valence")
    compound = F.round(total / F.sqrt(total * total + NORM_ALPHA), 4)
    return sums.withColumn("compound", compound).withColumn(
        "label", threshold_label(F.col("compound"), theta)
    )
