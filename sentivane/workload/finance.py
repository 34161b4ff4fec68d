"""Queries: alignment, daily signals, returns, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentivane.functions.text import engagement_weight
from sentivane.operators import market, stats
from sentivane.operators.ordering import average_ranks
from sentivane.sources.prices import shape_bars
from sentivane.workload import inputs as I
from sentivane.workload.inputs import ctes
from sentivane.workload.recurrences import with_p
from sentivane.workload.registry import query, r, rounded

COUNTS = "bullish_count, bearish_count, neutral_count"
DAILY_COLS = ("average_post_score mean_sentiment median_sentiment std_sentiment positive_ratio "
              "negative_ratio neutral_ratio net_sentiment bull_bear_ratio weighted_sentiment "
              "sentiment_change rolling_sentiment_1d rolling_sentiment_3d rolling_sentiment_7d")
RETURN_COLS = "lag_return_1d fwd_return_1d fwd_return_3d fwd_return_5d"
DIRS = "fwd_direction_1d, fwd_direction_3d, fwd_direction_5d"


@query("scan_prices", ctes("bars") + "SELECT ticker, date, adj_close, volume FROM bars "
       "WHERE date >= DATE '1996-01-01' AND date < DATE '1999-01-01'")
def scan_prices(spark, sf):
    named = I.bars(spark, sf).toDF("Ticker", "Date", "Adj Close", "Volume")
    bars = shape_bars(named)
    day = F.col("date")
    return bars.filter((day >= "1996-01-01") & (day < "1999-01-01"))


@query("engagement_weight", ctes("posts") +
       "SELECT post_id, round(CASE WHEN w = 0 THEN 1 ELSE w END, 6) AS weight, "
       "round(sentiment_score * CASE WHEN w = 0 THEN 1 ELSE w END, 6) AS weighted FROM "
       "(SELECT *, ln(1 + greatest(0, score) + greatest(0, num_comments)) AS w FROM posts)")
def engagement(spark, sf):
    w = engagement_weight(F.col("score"), F.col("num_comments"))
    return rounded(I.posts(spark, sf).select(
        "post_id", w.alias("weight"), (F.col("sentiment_score") * w).alias("weighted")))


@query("next_open_day", ctes("calendar") + "SELECT d::DATE AS day, "
       "min(c.trading_date) AS trading_date FROM (SELECT unnest(generate_series("
       "min(trading_date), max(trading_date), INTERVAL 1 DAY)) AS d FROM calendar) g "
       "ASOF JOIN calendar c ON g.d::DATE <= c.trading_date GROUP BY 1")
def next_open_day(spark, sf):
    return market.next_open_day(I.calendar(spark, sf))


@query("align_trading_day", ctes("aligned") + "SELECT post_id, ticker, trading_date FROM aligned")
def align(spark, sf):
    return I.aligned(spark, sf).select("post_id", "ticker", "trading_date")


@query("drop_unaligned", ctes("posts", "aligned") + "SELECT (SELECT count(*) FROM posts) AS posts, "
       "(SELECT count(*) FROM aligned) AS kept, (SELECT count(*) FROM posts) - "
       "(SELECT count(*) FROM aligned) AS dropped")
def drop_unaligned(spark, sf):
    kept = market.align_trading_day(
        I.posts(spark, sf), I.calendar(spark, sf), keep_unaligned=True)
    n, k = F.count(F.lit(1)), F.count("trading_date")
    return kept.agg(n.alias("posts"), k.alias("kept"), (n - k).alias("dropped"))


@query("daily_sentiment", ctes("daily") +
       f"SELECT ticker, trading_date, volume_of_posts, post_count, {COUNTS}, {r(DAILY_COLS)} "
       "FROM daily")
def daily(spark, sf):
    return rounded(I.daily(spark, sf))


@query("min_posts", ctes("aligned") + "SELECT ticker, trading_date, post_count, "
       "round(coalesce(net - lag(net) OVER (PARTITION BY ticker ORDER BY trading_date), 0), 6) "
       "AS sentiment_change FROM (SELECT ticker, trading_date, count(*) AS post_count, "
       "avg(sign(sentiment_score)) AS net FROM aligned GROUP BY 1, 2 HAVING count(*) >= 3)")
def min_posts(spark, sf):
    return rounded(I.daily(spark, sf, 3).select(
        "ticker", "trading_date", "post_count", "sentiment_change"))


@query("sentiment_change", ctes("daily") +
       f"SELECT ticker, trading_date, {r('net_sentiment sentiment_change')} FROM daily")
def sentiment_change(spark, sf):
    return rounded(I.daily(spark, sf).select(
        "ticker", "trading_date", "net_sentiment", "sentiment_change"))


@query("rolling_sentiment", ctes("daily") + "SELECT ticker, trading_date, " +
       r("rolling_sentiment_1d rolling_sentiment_3d rolling_sentiment_7d") + " FROM daily")
def rolling(spark, sf):
    return rounded(I.daily(spark, sf).select(
        "ticker", "trading_date", "rolling_sentiment_1d", "rolling_sentiment_3d",
        "rolling_sentiment_7d"))


@query("null_ticker_drop", ctes("posts") + "SELECT ticker, count(*) AS n FROM "
       "(SELECT CASE WHEN score > 0 THEN ticker END AS ticker FROM posts) "
       "WHERE ticker IS NOT NULL GROUP BY 1")
def null_ticker_drop(spark, sf):
    p = I.posts(spark, sf).withColumn("ticker", F.when(F.col("score") > 0, F.col("ticker")))
    return p.filter(F.col("ticker").isNotNull()).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"))


@query("lag_return", ctes("rets") + f"SELECT ticker, date, {r('adj_close lag_return_1d')} FROM rets")
def lag_return(spark, sf):
    return rounded(I.returns(spark, sf).select("ticker", "date", "adj_close", "lag_return_1d"))


@query("forward_returns", ctes("rets") + "SELECT ticker, date, volume, " +
       r("adj_close " + RETURN_COLS) + f", {DIRS} FROM rets")
def forward_returns(spark, sf):
    return rounded(I.returns(spark, sf))


@query("forward_direction", ctes("rets") + "SELECT ticker, date, " + ", ".join(
    f"coalesce(fwd_direction_{h}d, 0) AS fwd_direction_{h}d" for h in (1, 3, 5)) + " FROM rets")
def forward_direction(spark, sf):
    return I.returns(spark, sf, unknown_direction=0).select(
        "ticker", "date", "fwd_direction_1d", "fwd_direction_3d", "fwd_direction_5d")


@query("sentiment_returns", ctes("joint") +
       f"SELECT ticker, trading_date, volume_of_posts, post_count, {COUNTS}, volume, {DIRS}, " +
       r(DAILY_COLS + " adj_close " + RETURN_COLS) + " FROM joint")
def sentiment_returns(spark, sf):
    return rounded(I.joint(spark, sf))


@query("price_overlay", ctes("joint") + f"SELECT trading_date, {r('adj_close mean_sentiment')} "
       "FROM joint WHERE ticker = '1-URGENT' ORDER BY 1")
def price_overlay(spark, sf):
    return rounded(market.price_overlay(I.joint(spark, sf), "1-URGENT"))


@query("complete_cases", ctes("cases") + "SELECT ticker, trading_date, " +
       r("mean_sentiment fwd_return_1d fwd_return_3d fwd_return_5d") + " FROM cases")
def complete_cases(spark, sf):
    return rounded(stats.complete_cases(I.joint(spark, sf)).select(
        "ticker", "trading_date", "mean_sentiment", "fwd_return_1d", "fwd_return_3d",
        "fwd_return_5d"))


# Spark's F: the preferred symbols do not occur among order priorities, so the ten most
# mentioned are taken; with preferred symbols that occur, only those stay.
@query("universe_filter", ctes("posts") + "SELECT ticker, count(*) AS n FROM posts WHERE ticker "
       "IN ('1-URGENT', '5-LOW') GROUP BY 1")
def universe_filter(spark, sf):
    kept = market.universe_filter(I.posts(spark, sf), ["1-URGENT", "5-LOW", "NVDA"])
    return kept.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query("universe_fallback", ctes("posts") + "SELECT ticker, count(*) AS n FROM posts GROUP BY 1 "
       "ORDER BY n DESC, ticker LIMIT 3")
def universe_fallback(spark, sf):
    kept = market.universe_filter(I.posts(spark, sf), top=3)
    return kept.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query("market_years", ctes("posts") + "SELECT greatest(DATE '1996-01-01', "
       "(min(timestamp) - INTERVAL 5 DAY)::DATE) AS start_date, least(DATE '2025-07-20', "
       "(max(timestamp) + INTERVAL 15 DAY)::DATE) AS end_date FROM posts")
def market_years(spark, sf):
    import datetime as dt

    return market.study_period(I.posts(spark, sf), earliest=dt.date(1996, 1, 1))



def per_horizon(columns: str, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{h}d' AS horizon, {columns.replace('#', str(h))} FROM {source}"
        for h in (1, 3, 5))


@query("pearson", ctes("cases") + per_horizon(
    "round(corr(mean_sentiment, fwd_return_#d), 6) AS pearson_r, count(*) AS n_samples", "cases"))
def pearson(spark, sf):
    return rounded(stats.pearson(I.joint(spark, sf)))


@query("pearson_weighted", ctes("cases") + per_horizon(
    "round(corr(weighted_sentiment, fwd_return_#d), 6) AS pearson_r, count(*) AS n_samples",
    "cases"))
def pearson_weighted(spark, sf):
    return rounded(stats.pearson(I.joint(spark, sf), "weighted_sentiment"))


_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0 AS {1}"
RANKED = "ranked AS (SELECT " + ", ".join([
    _RANK.format("mean_sentiment", "x"),
    *[_RANK.format(f"fwd_return_{h}d", f"y{h}") for h in (1, 3, 5)]]) + " FROM cases)"


@query("spearman", ctes("cases", extra=RANKED) + per_horizon(
    "round(corr(x, y#), 6) AS spearman_rho, count(*) AS n_samples", "ranked"))
def spearman(spark, sf):
    return rounded(stats.spearman(I.joint(spark, sf)))


@query("average_rank", ctes("cases") + "SELECT DISTINCT round(mean_sentiment, 6) AS value, "
       + _RANK.format("mean_sentiment", "rank").replace(" AS rank", "") + " AS rank FROM cases")
def average_rank(spark, sf):
    return rounded(average_ranks(
        stats.complete_cases(I.joint(spark, sf)), ["mean_sentiment"]).drop("column_name"))


@query("ols", ctes("cases") + per_horizon(
    "round(regr_slope(fwd_return_#d, mean_sentiment), 6) AS beta_1, "
    "round(regr_intercept(fwd_return_#d, mean_sentiment), 6) AS intercept, "
    "round(regr_r2(fwd_return_#d, mean_sentiment), 6) AS r_squared, "
    "round(sqrt((1 - regr_r2(fwd_return_#d, mean_sentiment)) * regr_syy(fwd_return_#d, "
    "mean_sentiment) / regr_sxx(fwd_return_#d, mean_sentiment) / (count(*) - 2)), 6) AS std_error, "
    "count(*) AS n_samples", "cases"))
def ols(spark, sf):
    return rounded(stats.ols(I.joint(spark, sf)))


CORRELATED = "correlated AS (" + per_horizon(
    "corr(mean_sentiment, fwd_return_#d) AS pearson_r, count(*) AS n_samples", "cases") + ")"


@query("p_values", ctes("cases", extra=CORRELATED + ", " + with_p("correlated", "pearson_r")) +
       "SELECT horizon, round(pearson_r, 6) AS pearson_r, n_samples, round(p_value, 6) AS p_value "
       "FROM withp")
def p_values(spark, sf):
    """Pearson r with its p value."""
    return rounded(stats.pearson(I.joint(spark, sf), p_values=True))


EVENTS = """ev AS (
  SELECT * FROM joint WHERE mean_sentiment IS NOT NULL AND fwd_return_1d IS NOT NULL
    AND fwd_return_3d IS NOT NULL),
lim AS (SELECT quantile_cont(mean_sentiment, 0.85) AS hi, quantile_cont(mean_sentiment, 0.15) AS lo
  FROM ev),
res AS (SELECT count(*) FILTER (mean_sentiment >= hi) AS bullish_count,
  avg(fwd_return_1d) FILTER (mean_sentiment >= hi) AS bullish_fwd_1d,
  avg(fwd_return_3d) FILTER (mean_sentiment >= hi) AS bullish_fwd_3d,
  count(*) FILTER (mean_sentiment <= lo) AS bearish_count,
  avg(fwd_return_1d) FILTER (mean_sentiment <= lo) AS bearish_fwd_1d,
  avg(fwd_return_3d) FILTER (mean_sentiment <= lo) AS bearish_fwd_3d FROM ev, lim)"""


@query("event_study", ctes("joint", extra=EVENTS) +
       "SELECT bullish_count, bearish_count, " +
       r("bullish_fwd_1d bullish_fwd_3d bearish_fwd_1d bearish_fwd_3d") +
       ", round(bullish_fwd_1d - bearish_fwd_1d, 6) AS spread_1d, "
       "round(bullish_fwd_3d - bearish_fwd_3d, 6) AS spread_3d FROM res")
def event_study(spark, sf):
    return rounded(stats.event_study(I.joint(spark, sf)))


LAGS = "lagged AS (" + " UNION ALL ".join(
    f"SELECT ticker, trading_date, {k} AS lag_days, net_sentiment AS s, "
    f"{'lead' if k >= 0 else 'lag'}(fwd_return_1d, {abs(k)}) OVER w AS r, "
    "count(*) OVER (PARTITION BY ticker) AS n_rows FROM joint "
    "WINDOW w AS (PARTITION BY ticker ORDER BY trading_date)" for k in range(-3, 4)) + "), " \
    "pairs AS (SELECT * FROM lagged WHERE s IS NOT NULL AND r IS NOT NULL AND n_rows >= 9)"


@query("lag_pairs", ctes("joint", extra=LAGS) +
       "SELECT ticker, trading_date, lag_days, round(s, 6) AS s, round(r, 6) AS r FROM pairs")
def lag_pairs(spark, sf):
    return rounded(stats.lag_pairs(I.joint(spark, sf)))


@query("lag_correlation", ctes("joint", extra=LAGS) + "SELECT ticker, lag_days, "
       "round(corr(s, r), 6) AS pearson_r, count(*) AS n_samples FROM pairs GROUP BY 1, 2 "
       "HAVING count(*) >= 10")
def lag_correlation(spark, sf):
    return rounded(stats.lag_correlation(I.joint(spark, sf)))


@query("scatter_trend", ctes("joint", extra="pts AS (SELECT ticker, trading_date, mean_sentiment "
       "AS x, fwd_return_1d * 100 AS y FROM joint WHERE mean_sentiment IS NOT NULL AND "
       "fwd_return_1d IS NOT NULL)") + "SELECT ticker, trading_date, round(x, 6) AS x, "
       "round(y, 6) AS y, round((SELECT regr_slope(y, x) FROM pts), 6) AS slope, "
       "round((SELECT regr_intercept(y, x) FROM pts), 6) AS intercept FROM pts")
def scatter_trend(spark, sf):
    return rounded(stats.scatter_trend(I.joint(spark, sf)))
