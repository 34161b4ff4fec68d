"""Statistics of daily sentiment against forward returns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentivane.functions.let import let
from sentivane.operators.ordering import carried_ranks, exact_quantiles
from sentivane.session import one_row, stage
from sentivane.vocab import HORIZONS


def complete_cases(df: DataFrame, sentiment: str = "mean_sentiment",
                   horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Rows with a sentiment and every horizon's return, so that all horizons share their n."""
    return df.dropna(subset=[sentiment, *[f"fwd_return_{h}d" for h in horizons]])


# Steps of the continued fraction; those after it has converged change nothing.
FRACTION_STEPS = 500


def log_gamma_ratio(a: Column) -> Column:
    """ln(gamma(a) / gamma(a + 1/2)) for a > 0: Stirling's series ten places up, and back down."""
    def series(x: Column) -> Column:
        z = 1 / (x * x)
        return (x - 0.5) * F.log(x) - x + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (
            1 / 1680 - z / 1188)))) / x

    down = sum((F.log((a + i + 0.5) / (a + i)) for i in range(10)), F.lit(0.0))
    return series(a + 10) - series(a + 10.5) + down


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, two links a step (modified Lentz)."""
    far = lambda v: F.when(F.abs(v) > 1e-300, v).otherwise(1e-300)

    def link(s: Column, number: Column) -> Column:
        return let(F.struct(
            (1 / far(1 + number * s["d"])).alias("d"), far(1 + number / s["c"]).alias("c"),
            s["h"].alias("h")), lambda t: F.struct(
                t["d"].alias("d"), t["c"].alias("c"), (t["h"] * t["c"] * t["d"]).alias("h")))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return let(link(s, even), lambda t: link(t, odd))

    first = 1 / far(1 - (a + b) * x / (a + 1))
    start = F.struct(first.alias("d"), F.lit(1.0).alias("c"), first.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(FRACTION_STEPS)), start,
                       lambda s, m: step(s, m.cast("double")), lambda s: s["h"])


def two_sided_p(r: Column, n: Column) -> Column:
    """p value of a correlation r from n pairs: t distribution with n - 2 degrees of freedom.

    The regularised incomplete beta function of 1 - r^2 at ((n - 2) / 2, 1/2), as an expression.
    Null without a correlation or with fewer than three pairs.
    """
    def value(v: Column) -> Column:
        a, x, one = v["a"], v["x"], F.lit(1.0)
        half = F.lit(0.5)
        # ln of gamma(a + 1/2) / (gamma(a) gamma(1/2)) x^a (1 - x)^(1/2)
        front = F.exp(-log_gamma_ratio(a) - 0.5 * math.log(math.pi)
                      + a * F.log(x) + 0.5 * F.log1p(-x))
        return F.when(x >= 1.0, one).when(x <= 0.0, 0.0).when(
            x < (a + 1) / (a + 2.5), front * _fraction(a, half, x) / a).otherwise(
            1 - front * _fraction(half, a, 1 - x) * 2)

    known = r.isNotNull() & ~F.isnan(r) & (n >= 3)
    numbers = F.struct(((n.cast("double") - 2) / 2).alias("a"),
                       F.greatest(F.lit(0.0), 1 - r * r).alias("x"))
    return F.when(known, let(numbers, value))


def _per_horizon(df: DataFrame, sentiment: str, horizons: Sequence[int], build) -> DataFrame:
    """One global aggregate with the columns of every horizon, turned into a row per horizon."""
    aggs, rows = [], []
    for h in horizons:
        cols = build(F.col(sentiment), F.col(f"fwd_return_{h}d"))
        aggs += [c.alias(f"{name}_{h}") for name, c in cols.items()]
        rows.append(F.struct(F.lit(f"{h}d").alias("horizon"),
                             *[F.col(f"{name}_{h}").alias(name) for name in cols]))
    wide = complete_cases(df, sentiment, horizons).agg(*aggs)
    return wide.select(F.explode(F.array(*rows)).alias("v")).select("v.*")


def pearson(df: DataFrame, sentiment: str = "mean_sentiment",
            horizons: Sequence[int] = HORIZONS, p_values: bool = False) -> DataFrame:
    """(horizon, pearson_r, n_samples[, p_value]) from one pass."""
    out = _per_horizon(df, sentiment, horizons, lambda x, y: {
        "pearson_r": F.corr(x, y), "n_samples": F.count(F.lit(1))})
    if p_values:
        out = out.withColumn("p_value", two_sided_p(F.col("pearson_r"), F.col("n_samples")))
    return out


def spearman(df: DataFrame, sentiment: str = "mean_sentiment",
             horizons: Sequence[int] = HORIZONS, p_values: bool = False) -> DataFrame:
    """(horizon, spearman_rho, n_samples[, p_value]): correlation of tie-averaged ranks."""
    columns = {sentiment: "_x", **{f"fwd_return_{h}d": f"_{h}" for h in horizons}}
    # written, so that a row keeps its number if its task runs again
    rows = stage(complete_cases(df, sentiment, horizons).select(*columns), "spearman")
    ranks = carried_ranks(
        rows.withColumn("_row", F.monotonically_increasing_id()), "_row", list(columns))
    ranked = ranks.groupBy("row").agg(*[
        F.max(F.when(F.col("column_name") == c, F.col("rank"))).alias(name)
        for c, name in columns.items()])
    aggs = [F.corr("_x", f"_{h}").alias(f"r{h}") for h in horizons]
    wide = ranked.agg(*aggs, F.count(F.lit(1)).alias("n"))
    out = wide.select(F.explode(F.array(*[
        F.struct(F.lit(f"{h}d").alias("horizon"), F.col(f"r{h}").alias("spearman_rho"),
                 F.col("n").alias("n_samples"))
        for h in horizons
    ])).alias("v")).select("v.*")
    if p_values:
        out = out.withColumn("p_value", two_sided_p(F.col("spearman_rho"), F.col("n_samples")))
    return out


def ols(df: DataFrame, sentiment: str = "mean_sentiment",
        horizons: Sequence[int] = HORIZONS, p_values: bool = False) -> DataFrame:
    """(horizon, beta_1, intercept, r_squared, std_error, n_samples[, p_value]) of
    return = b0 + b1 * sentiment."""
    out = _per_horizon(df, sentiment, horizons, lambda x, y: {
        "beta_1": F.regr_slope(y, x), "intercept": F.regr_intercept(y, x),
        "r": F.corr(x, y), "sxx": F.regr_sxx(y, x), "syy": F.regr_syy(y, x),
        "n_samples": F.count(F.lit(1))})
    r2 = F.col("r") * F.col("r")
    error = F.sqrt(F.try_divide((1 - r2) * F.col("syy"), F.col("sxx") * (F.col("n_samples") - 2)))
    cols = ["horizon", "beta_1", "intercept", r2.alias("r_squared"), error.alias("std_error"),
            "n_samples"]
    if p_values:
        cols.append(two_sided_p(F.col("r"), F.col("n_samples")).alias("p_value"))
    return out.select(*cols)


def event_study(df: DataFrame, sentiment: str = "mean_sentiment", percentile: float = 85.0):
    """Mean forward returns on days at or above the percentile and at or below its mirror.

    One row; a day may count on both sides when the two limits coincide.
    """
    rows = stage(
        df.dropna(subset=[sentiment, "fwd_return_1d", "fwd_return_3d"])
        .select(sentiment, "fwd_return_1d", "fwd_return_3d"), "events")  # read twice below
    limits = exact_quantiles(rows, sentiment, [percentile / 100, (100 - percentile) / 100])
    both = rows.withColumn("q", one_row(limits))
    bull, bear = F.col(sentiment) >= F.col("q.q0"), F.col(sentiment) <= F.col("q.q1")
    aggs = []
    for side, hit in (("bullish", bull), ("bearish", bear)):
        aggs.append(F.count_if(hit).alias(f"{side}_count"))
        for h in (1, 3):
            aggs.append(F.avg(F.when(hit, F.col(f"fwd_return_{h}d"))).alias(f"{side}_fwd_{h}d"))
    return both.agg(*aggs).select(
        "*",
        (F.col("bullish_fwd_1d") - F.col("bearish_fwd_1d")).alias("spread_1d"),
        (F.col("bullish_fwd_3d") - F.col("bearish_fwd_3d")).alias("spread_3d"),
    )


def lag_pairs(df: DataFrame, sentiment: str = "net_sentiment", returns: str = "fwd_return_1d",
              max_lags: int = 3) -> DataFrame:
    """(ticker, trading_date, lag_days, s, r): each day's sentiment beside the return `lag` rows
    later (negative: earlier).  Tickers with fewer than 3 * max_lags rows are left out."""
    order = Window.partitionBy("ticker").orderBy("trading_date")
    lags = list(range(-max_lags, max_lags + 1))
    rows = df.filter(F.col("ticker").isNotNull()).select(
        "ticker", "trading_date", F.col(sentiment).alias("s"),
        F.count(F.lit(1)).over(Window.partitionBy("ticker")).alias("_rows"),
        F.row_number().over(order).alias("_i"),
        *[F.lead(returns, k).over(order).alias(f"r{k}") if k >= 0
          else F.lag(returns, -k).over(order).alias(f"r{k}") for k in lags],
    ).filter(F.col("_rows") >= 3 * max_lags)
    pair = F.explode(F.array(*[
        F.struct(F.lit(k).alias("lag_days"), F.col(f"r{k}").alias("r")) for k in lags
    ])).alias("v")
    return rows.select("ticker", "trading_date", "s", pair).select(
        "ticker", "trading_date", "v.lag_days", "s", "v.r"
    ).dropna(subset=["s", "r"])


def lag_correlation(df: DataFrame, sentiment: str = "net_sentiment",
                    returns: str = "fwd_return_1d", max_lags: int = 3, min_pairs: int = 10,
                    p_values: bool = False) -> DataFrame:
    out = lag_pairs(df, sentiment, returns, max_lags).groupBy("ticker", "lag_days").agg(
        F.corr("s", "r").alias("pearson_r"), F.count(F.lit(1)).alias("n_samples")
    ).filter(F.col("n_samples") >= min_pairs)
    if p_values:
        out = out.withColumn("p_value", two_sided_p(F.col("pearson_r"), F.col("n_samples")))
    return out


def scatter_trend(df: DataFrame, sentiment: str = "mean_sentiment") -> DataFrame:
    """(ticker, trading_date, x, y, slope, intercept): points in percent and their trend line."""
    rows = df.dropna(subset=[sentiment, "fwd_return_1d"]).select(
        "ticker", "trading_date", F.col(sentiment).alias("x"),
        (F.col("fwd_return_1d") * 100).alias("y"),
    )
    line = rows.agg(F.regr_slope("y", "x").alias("slope"),
                    F.regr_intercept("y", "x").alias("intercept"))
    return rows.withColumn("line", one_row(line)).select("ticker", "trading_date", "x", "y", "line.*")
