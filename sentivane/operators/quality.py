"""Profiles and report tables of a posts table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentivane.functions.text import char_length, word_count
from sentivane.session import one_row


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def null_profile(df: DataFrame, required: Sequence[str] = ("text", "timestamp", "ticker")):
    """(column_name, present, null_count, null_pct): one pass over all columns."""
    aggs = [F.count_if(F.col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(df.columns)]
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.lit(True).alias("present"),
                 F.col(f"n_{i}").alias("null_count"))
        for i, c in enumerate(df.columns)
    ] + [
        F.struct(F.lit(c).alias("column_name"), F.lit(False).alias("present"),
                 F.lit(None).cast("bigint").alias("null_count"))
        for c in required if c not in df.columns
    ]
    return wide.select("rows", F.explode(F.array(*rows)).alias("v")).select(
        "v.*", F.round(F.try_divide(F.col("v.null_count") * 100.0, F.col("rows")), 2)
        .alias("null_pct")
    )


def text_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """(measure, min, max, mean, median, std) of characters and words, one decimal.

    Lengths fold to (measure, length, n) first, so the exact median works on distinct lengths.
    """
    pairs = F.explode(F.array(
        F.struct(F.lit("char_count").alias("measure"), char_length(F.col(text)).alias("v")),
        F.struct(F.lit("word_count").alias("measure"), word_count(F.col(text)).alias("v")),
    )).alias("p")
    folded = df.select(pairs).select("p.*").groupBy("measure", "v").agg(
        F.count("v").alias("n")
    )
    v, n = F.col("v").cast("double"), F.col("n")
    total, s1, s2 = F.sum("n"), F.sum(v * n), F.sum(v * v * n)
    variance = F.try_divide(s2 - s1 * F.try_divide(s1, total), total - 1)
    return folded.groupBy("measure").agg(
        F.min("v").cast("bigint").alias("min"), F.max("v").cast("bigint").alias("max"),
        F.round(F.try_divide(s1, total), 1).alias("mean"),
        F.round(F.percentile("v", F.lit(0.5), n), 1).alias("median"),
        F.round(F.sqrt(F.greatest(variance, F.lit(0.0))), 1).alias("std"),
    )


def value_counts(df: DataFrame, column: str, count: str = "n") -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias(count)
    )


def label_distribution(df: DataFrame, label: str = "sentiment_label") -> DataFrame:
    """(label, n, share) among the labelled rows."""
    counts = value_counts(df, label)
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.round(F.col("n") / total, 4))


def ticker_coverage(df: DataFrame) -> DataFrame:
    """One row: posts with a ticker, their percentage, distinct tickers."""
    folded = df.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    with_ticker = F.coalesce(F.sum(F.when(F.col("ticker").isNotNull(), F.col("n"))), F.lit(0))
    return folded.agg(
        with_ticker.alias("posts_with_ticker"),
        F.round(with_ticker * 100.0 / F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1)), 2)
        .alias("coverage_pct"),
        F.count("ticker").alias("unique_tickers"),
    )


def top_values(df: DataFrame, column: str = "ticker", n: int = 15) -> DataFrame:
    """The n most frequent values; equals in name order."""
    return value_counts(df, column).orderBy(F.desc("n"), F.asc(column)).limit(n)


def temporal_coverage(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """First and last timestamp and whole days (24 hours) between them."""
    seconds = F.unix_seconds(F.max(ts).cast("timestamp")) - F.unix_seconds(
        F.min(ts).cast("timestamp"))
    return df.agg(
        F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"),
        F.floor(seconds / 86400).cast("bigint").alias("days_span"),
    )


def daily_trend(df: DataFrame, ts: str = "timestamp", label: str = "sentiment_label"):
    """Per calendar day: labelled posts, class counts and net share."""
    c = F.col(label)
    return df.groupBy(F.to_date(ts).alias("date")).agg(
        F.count(c).alias("volume"),
        F.count_if(c == "BULLISH").alias("bullish"),
        F.count_if(c == "BEARISH").alias("bearish"),
        F.count_if(c == "NEUTRAL").alias("neutral"),
    ).withColumn(
        "net_sentiment", F.try_divide(F.col("bullish") - F.col("bearish"), F.col("volume"))
    )


def overview(df: DataFrame, label: str = "sentiment_label") -> DataFrame:
    """One row: posts, distinct tickers, share of bullish and bearish posts in percent.

    Folds by ticker first, so the distinct count never gathers raw rows.
    """
    c = F.col(label)
    folded = df.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(c == "BULLISH").alias("bull"), F.count_if(c == "BEARISH").alias("bear"),
    )
    posts = F.sum("n")
    return folded.agg(
        F.coalesce(posts, F.lit(0)).alias("posts"), F.count("ticker").alias("tickers"),
        F.coalesce(F.try_divide(F.sum("bull") * 100.0, posts), F.lit(0.0)).alias("bullish_pct"),
        F.coalesce(F.try_divide(F.sum("bear") * 100.0, posts), F.lit(0.0)).alias("bearish_pct"),
    )


def histogram(df: DataFrame, value: Column, bins: int = 50) -> DataFrame:
    """(bin, low, high, n) of equal bins from min to max; the last bin keeps its right edge."""
    rows = df.select(value.cast("double").alias("v")).filter(F.col("v").isNotNull())
    folded = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    span = folded.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    both = folded.withColumn("span", one_row(span)).select("v", "n", "span.*")
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    at = F.coalesce(F.try_divide(F.col("v") - F.col("lo"), width), F.lit(0.0))
    return (
        both.withColumn("bin", F.least(F.floor(at), F.lit(bins - 1)).cast("int"))
        .groupBy("bin").agg(
            F.min(F.col("lo") + F.col("bin") * width).alias("low"),
            F.min(F.col("lo") + (F.col("bin") + 1) * width).alias("high"),
            F.sum("n").alias("n"))
    )


def post_filter(
    df: DataFrame, ticker: str = "ALL", communities: Sequence[str] = (),
    classes: Sequence[str] = (),
) -> DataFrame:
    """Optional ticker, community and class conditions; an empty one does not filter."""
    if ticker != "ALL":
        df = df.filter(F.col("ticker") == ticker)
    if communities:
        df = df.filter(F.col("subreddit").isin(list(communities)))
    if classes:
        df = df.filter(F.col("sentiment_label").isin(list(classes)))
    return df
