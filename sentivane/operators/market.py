"""Posts to trading days, daily signals per ticker, price returns and their join."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentivane.functions.labels import any_label_to_score
from sentivane.functions.text import engagement_weight
from sentivane.vocab import HORIZONS, UNIVERSE

MARKET_ZONE = "America/New_York"
CLOSE_HOUR = 16


def next_open_day(calendar: DataFrame, date: str = "trading_date") -> DataFrame:
    """(day, trading_date): every day from the first to the last trading day and the trading day
    it counts for.

    A day per row, so its size is bounded by the date type itself (3.65 million days in all
    of it, a few thousand in any real calendar): safe to gather and to broadcast.
    """
    days = calendar.agg(F.array_sort(F.collect_set(date)).alias("days"))
    spans = days.select(F.explode(F.transform(
        "days",
        lambda d, i: F.struct(
            F.coalesce(F.date_add(F.get(F.col("days"), i - 1), 1), d).alias("from"),
            d.alias("to"),
        ),
    )).alias("s"))
    return spans.select(
        F.explode(F.sequence("s.from", "s.to")).alias("day"), F.col("s.to").alias("trading_date")
    )


def effective_day(ts: str, kind: T.DataType, close_hour: int = CLOSE_HOUR) -> Column:
    """Calendar day in the market's zone, one later from the closing hour on."""
    zone = F.lit(MARKET_ZONE)
    if isinstance(kind, T.TimestampNTZType):  # wall-clock values are UTC
        local = F.convert_timezone(F.lit("UTC"), zone, F.col(ts))
    else:
        local = F.convert_timezone(None, zone, F.col(ts))
    late = (F.hour(local) >= close_hour).cast("int")
    return F.date_add(F.to_date(local), late)


def align_trading_day(
    posts: DataFrame, calendar: DataFrame, ts: str = "timestamp", date: str = "trading_date",
    close_hour: int = CLOSE_HOUR, keep_unaligned: bool = False,
) -> DataFrame:
    """Forward as-of join: adds the first trading day on or after a post's effective day.

    The calendar is filled to one row per day, which turns the as-of join into an equi join with
    a small table; posts are not shuffled.  Posts before the first trading day count for it, posts
    after the last one are dropped (or kept with null).
    """
    filled = next_open_day(calendar, date)
    first = calendar.agg(F.min(date).alias("d")).scalar()
    day = F.greatest(effective_day(ts, posts.schema[ts].dataType, close_hour), first)
    return (
        posts.withColumn("_day", day)
        .join(F.broadcast(filled.withColumnRenamed("day", "_day")), "_day",
              "left" if keep_unaligned else "inner")
        .drop("_day")
    )


def daily_sentiment(posts: DataFrame, min_posts: int = 1) -> DataFrame:
    """One row per ticker and trading day, with day-over-day and rolling columns.

    Two steps: first by (ticker, day, score value), then by (ticker, day).  The first folds on
    the map side and leaves at most one row per distinct score value, so neither the exact median
    nor a ticker with a third of all posts gathers raw rows in one task.  Rows without a ticker
    drop out.  Weights of posts without a score stay in the divisor.
    """
    if "sentiment_score" not in posts.columns:
        posts = posts.withColumn("sentiment_score", any_label_to_score(F.col("sentiment_label")))
    has_score = "score" in posts.columns
    votes = F.col("score") if has_score else F.lit(1)
    comments = F.col("num_comments") if "num_comments" in posts.columns else F.lit(0)
    s = F.col("sentiment_score")
    rows = posts.filter(F.col("ticker").isNotNull()).select(
        "ticker", "trading_date", s,
        votes.cast("double").alias("votes"),
        engagement_weight(votes, comments).alias("weight"),
    )
    by_value = rows.groupBy("ticker", "trading_date", "sentiment_score").agg(
        F.count("sentiment_score").alias("n"),
        F.count("votes").alias("n_votes"),
        F.sum("votes").alias("votes"),
        F.sum("weight").alias("weight"),
    )
    n = F.col("n")
    sums = by_value.groupBy("ticker", "trading_date").agg(
        F.sum("n").alias("volume_of_posts"),
        F.sum("n_votes").alias("n_votes"),
        F.sum("votes").alias("votes"),
        F.sum(s * n).alias("s1"),
        F.sum(s * s * n).alias("s2"),
        F.percentile(s, F.lit(0.5), n).alias("median_sentiment"),
        F.sum(s * F.col("weight")).alias("weighted"),
        F.sum("weight").alias("weights"),
        F.sum(F.when(s > 0, n).otherwise(0)).alias("bullish_count"),
        F.sum(F.when(s < 0, n).otherwise(0)).alias("bearish_count"),
        F.sum(F.when(s == 0, n).otherwise(0)).alias("neutral_count"),
    )
    volume = F.col("volume_of_posts")
    mean = F.try_divide(F.col("s1"), volume)
    variance = F.try_divide(
        F.greatest(F.col("s2") - F.col("s1") * mean, F.lit(0.0)), volume - 1
    )
    daily = sums.filter(volume >= min_posts).select(
        "ticker", "trading_date", "volume_of_posts",
        (F.try_divide(F.col("votes"), F.col("n_votes")) if has_score else F.lit(1.0))
        .alias("average_post_score"),
        mean.alias("mean_sentiment"),
        "median_sentiment",
        F.coalesce(F.sqrt(variance), F.lit(0.0)).alias("std_sentiment"),
        "bullish_count", "bearish_count", "neutral_count",
        volume.alias("post_count"),
        F.try_divide(F.col("bullish_count"), volume).alias("positive_ratio"),
        F.try_divide(F.col("bearish_count"), volume).alias("negative_ratio"),
        F.try_divide(F.col("neutral_count"), volume).alias("neutral_ratio"),
        (F.coalesce(F.col("weighted"), F.lit(0.0))
         / F.greatest(F.coalesce(F.col("weights"), F.lit(0.0)), F.lit(1e-6)))
        .alias("weighted_sentiment"),
    )
    net = F.col("positive_ratio") - F.col("negative_ratio")
    return add_rolling(
        daily.withColumn("net_sentiment", net).withColumn("bull_bear_ratio", net)
    )


def add_rolling(daily: DataFrame, windows: Sequence[int] = (1, 3, 7)) -> DataFrame:
    """Day-over-day change and row-based rolling means of net sentiment, per ticker.

    Runs on the daily table: a ticker has at most one row per trading day.
    """
    order = Window.partitionBy("ticker").orderBy("trading_date")
    net = F.col("net_sentiment")
    out = daily.withColumn(
        "sentiment_change", F.coalesce(net - F.lag(net, 1).over(order), F.lit(0.0))
    )
    for k in windows:
        frame = order.rowsBetween(-(k - 1), 0)
        out = out.withColumn(
            f"rolling_sentiment_{k}d", net if k == 1 else F.avg(net).over(frame)
        )
    return out


def forward_returns(
    bars: DataFrame, horizons: Sequence[int] = HORIZONS, unknown_direction: int | None = None,
    fill_prices: bool = False,
) -> DataFrame:
    """Past 1-day return, future returns and their direction, per ticker over trading rows.

    The direction of an unknown future return is null; `unknown_direction=0` gives 0 instead.
    `fill_prices` carries the last known price over gaps.
    """
    order = Window.partitionBy("ticker").orderBy("date")
    price = F.col("adj_close")
    if fill_prices:
        seen = order.rowsBetween(Window.unboundedPreceding, 0)
        bars = bars.withColumn("_price", F.last(price, ignorenulls=True).over(seen))
    else:
        bars = bars.withColumn("_price", price)
    p = F.col("_price")
    out = bars.withColumn("lag_return_1d", F.try_divide(p, F.lag(p, 1).over(order)) - 1)
    for h in horizons:
        r = F.try_divide(F.lead(p, h).over(order), p) - 1
        out = out.withColumn(f"fwd_return_{h}d", r)
        up = (F.col(f"fwd_return_{h}d") > 0).cast("int")
        if unknown_direction is not None:
            up = F.coalesce(up, F.lit(unknown_direction))
        out = out.withColumn(f"fwd_direction_{h}d", up)
    return out.drop("_price")


def sentiment_returns(daily: DataFrame, bars: DataFrame) -> DataFrame:
    """Inner join of daily signals and bars on ticker and day; clashing bar columns get _price."""
    clash = [c for c in bars.columns if c in daily.columns and c != "ticker"]
    for c in clash:
        bars = bars.withColumnRenamed(c, f"{c}_price")
    bars = bars.withColumn("trading_date", F.to_date("date")).drop("date")
    left = daily.withColumn("trading_date", F.to_date("trading_date"))
    return left.join(bars, ["ticker", "trading_date"])


def universe(posts: DataFrame, wanted: Sequence[str] = UNIVERSE, top: int = 10) -> DataFrame:
    """The tickers to study: the wanted ones that occur, else the `top` most mentioned."""
    counts = posts.filter(F.col("ticker").isNotNull()).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.col("ticker").isin(list(wanted)).cast("int")).alias("wanted"),
    )
    any_wanted = counts.agg(F.coalesce(F.max("wanted"), F.lit(0))).scalar()
    most = counts.orderBy(F.desc("n"), F.asc("ticker")).limit(top)
    return (
        counts.filter(F.col("wanted") == 1)
        .unionByName(most.filter(any_wanted == 0)).select("ticker")
    )


def universe_filter(posts: DataFrame, wanted: Sequence[str] = UNIVERSE, top: int = 10):
    """Posts of the study's tickers; the list has at most `top` or len(wanted) rows."""
    return posts.join(F.broadcast(universe(posts, wanted, top)), "ticker", "left_semi")


def study_period(
    posts: DataFrame, ts: str = "timestamp",
    earliest: dt.date = dt.date(2020, 1, 1), latest: dt.date = dt.date(2025, 7, 20),
) -> DataFrame:
    """One row (start_date, end_date): the posts' range with a margin, held within two dates."""
    low, high = F.min(ts), F.max(ts)
    return posts.agg(
        F.greatest(F.lit(earliest), F.to_date(low - F.expr("INTERVAL 5 DAYS")))
        .alias("start_date"),
        F.least(F.lit(latest), F.to_date(high + F.expr("INTERVAL 15 DAYS"))).alias("end_date"),
    )


def price_overlay(joint: DataFrame, ticker: str = "NVDA") -> DataFrame:
    return (
        joint.filter(F.col("ticker") == ticker)
        .select("trading_date", "adj_close", "mean_sentiment").orderBy("trading_date")
    )
