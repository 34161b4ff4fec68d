"""Alignment, daily signals, returns and statistics."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from sentivane.operators import market, ordering, stats
from sentivane.operators.ordering import average_ranks, exact_quantiles, running_totals


def days(spark, *dates):
    return spark.createDataFrame([(dt.date.fromisoformat(d),) for d in dates], "trading_date date")


def test_friday_evening_goes_to_monday(spark):
    posts = spark.createDataFrame(
        [(1, "2023-01-06 22:00:00"), (2, "2023-01-06 20:59:59"), (3, "2023-01-01 12:00:00"),
         (4, "2023-01-09 21:00:00")], "post_id int, t string"
    ).withColumn("timestamp", F.to_timestamp("t"))
    cal = days(spark, "2023-01-06", "2023-01-09")
    got = {r["post_id"]: str(r["trading_date"])
           for r in market.align_trading_day(posts, cal).collect()}
    assert got == {1: "2023-01-09", 2: "2023-01-06", 3: "2023-01-06"}
    kept = market.align_trading_day(posts, cal, keep_unaligned=True)
    assert kept.filter("trading_date IS NULL").count() == 1
    wall = posts.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    assert {r["post_id"]: str(r["trading_date"])
            for r in market.align_trading_day(wall, cal).collect()} == got


def test_next_open_day(spark):
    got = [(str(r[0]), str(r[1])) for r in
           market.next_open_day(days(spark, "2023-01-06", "2023-01-09")).orderBy("day").collect()]
    assert got == [("2023-01-06", "2023-01-06"), ("2023-01-07", "2023-01-09"),
                   ("2023-01-08", "2023-01-09"), ("2023-01-09", "2023-01-09")]


def test_daily_sentiment_math(spark):
    rows = spark.createDataFrame([
        ("NVDA", "2023-01-09", 1.0, "BULLISH", 10, 2), ("NVDA", "2023-01-09", -1.0, "BEARISH", 5, 1),
        ("NVDA", "2023-01-10", 1.0, "BULLISH", 0, 0), (None, "2023-01-10", 1.0, "BULLISH", 0, 0),
    ], "ticker string, d string, sentiment_score double, sentiment_label string, score long, "
       "num_comments long").withColumn("trading_date", F.to_date("d"))
    a, b = market.daily_sentiment(rows).orderBy("trading_date").collect()
    assert (a["post_count"], a["mean_sentiment"], a["median_sentiment"]) == (2, 0.0, 0.0)
    assert (a["bullish_count"], a["bearish_count"], a["neutral_count"]) == (1, 1, 0)
    w1, w2 = math.log1p(12), math.log1p(6)
    assert a["weighted_sentiment"] == pytest.approx((w1 - w2) / (w1 + w2))
    assert a["std_sentiment"] == pytest.approx(math.sqrt(2))
    assert (b["std_sentiment"], b["weighted_sentiment"], b["sentiment_change"]) == (0.0, 1.0, 1.0)
    assert b["rolling_sentiment_3d"] == 0.5
    only = market.daily_sentiment(rows, min_posts=2).collect()
    assert len(only) == 1 and only[0]["sentiment_change"] == 0.0


def test_daily_sentiment_from_labels_and_null_scores(spark):
    rows = spark.createDataFrame(
        [("A", "positive"), ("A", "odd")], "ticker string, sentiment_label string"
    ).withColumn("trading_date", F.lit(dt.date(2023, 1, 9)))
    r = market.daily_sentiment(rows).first()
    assert (r["mean_sentiment"], r["average_post_score"]) == (0.5, 1.0)
    nulls = rows.withColumn("sentiment_score", F.when(F.col("sentiment_label") == "odd", 1.0))
    r = market.daily_sentiment(nulls).first()
    # the unscored post keeps its weight in the divisor
    assert r["volume_of_posts"] == 1 and r["weighted_sentiment"] == pytest.approx(0.5)


def bars(spark, prices, ticker="A"):
    start = dt.date(2023, 1, 2)
    return spark.createDataFrame(
        [(ticker, start + dt.timedelta(days=i), p, 100) for i, p in enumerate(prices)],
        "ticker string, date date, adj_close double, volume long")


def test_forward_returns(spark):
    df = bars(spark, [10.0, 11.0, 9.9, 12.0]).unionByName(bars(spark, [1.0, 2.0], "B"))
    got = market.forward_returns(df).filter("ticker = 'A'").orderBy("date").collect()
    assert got[0]["lag_return_1d"] is None
    assert [r["fwd_return_1d"] for r in got] == [
        pytest.approx(0.1), pytest.approx(-0.1), pytest.approx(12 / 9.9 - 1), None]
    assert [r["fwd_direction_1d"] for r in got] == [1, 0, 1, None]
    assert got[0]["fwd_return_3d"] == pytest.approx(0.2)
    zero = market.forward_returns(df, unknown_direction=0).filter("ticker = 'A'").orderBy("date")
    assert [r["fwd_direction_1d"] for r in zero.collect()] == [1, 0, 1, 0]
    gap = market.forward_returns(bars(spark, [10.0, None, 12.0]), [1], fill_prices=True)
    assert [r["fwd_return_1d"] for r in gap.orderBy("date").collect()] == [
        pytest.approx(0.0), pytest.approx(0.2), None]


def test_universe(spark):
    posts = spark.createDataFrame(
        [("AAPL",), ("ZZZ",), ("ZZZ",), ("YYY",), (None,)], "ticker string")
    assert [r[0] for r in market.universe_filter(posts).distinct().collect()] == ["AAPL"]
    none = posts.filter("ticker <> 'AAPL'")
    assert [r[0] for r in market.universe(none, top=1).collect()] == ["ZZZ"]


def test_study_period(spark):
    posts = spark.createDataFrame([("2019-06-01",), ("2021-03-01",)], "t string").select(
        F.to_timestamp("t").alias("timestamp"))
    r = market.study_period(posts).first()
    assert (str(r[0]), str(r[1])) == ("2020-01-01", "2021-03-16")


def joint(spark, n=60, seed=3):
    rnd = random.Random(seed)
    rows = [("A" if i % 2 else "B", dt.date(2023, 1, 1) + dt.timedelta(days=i),
             rnd.choice([-1.0, -0.5, 0.0, 0.5, 1.0]), *[rnd.gauss(0, 1) for _ in range(4)],
             i % 4 + 1) for i in range(n)]
    df = spark.createDataFrame(
        rows, "ticker string, trading_date date, mean_sentiment double, fwd_return_1d double, "
        "fwd_return_3d double, fwd_return_5d double, lag_return_1d double, post_count int")
    return df.withColumn("net_sentiment", F.col("mean_sentiment")).withColumn(
        "fwd_direction_1d", (F.col("fwd_return_1d") > 0).cast("int")), rows


def pearson(x, y):
    mx, my = sum(x) / len(x), sum(y) / len(y)
    num = sum((a - mx) * (b - my) for a, b in zip(x, y))
    return num / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))


def ranks(values):
    s = sorted(values)
    return [s.index(v) + (s.count(v) + 1) / 2 for v in values]


def test_correlations_against_brute_force(spark):
    df, rows = joint(spark)
    x = [r[2] for r in rows]
    got = {r["horizon"]: r for r in stats.pearson(df, p_values=True).collect()}
    rho = {r["horizon"]: r for r in stats.spearman(df).collect()}
    fit = {r["horizon"]: r for r in stats.ols(df, p_values=True).collect()}
    for h, k in (("1d", 3), ("3d", 4), ("5d", 5)):
        y = [r[k] for r in rows]
        r = pearson(x, y)
        assert got[h]["pearson_r"] == pytest.approx(r) and got[h]["n_samples"] == len(rows)
        assert rho[h]["spearman_rho"] == pytest.approx(pearson(ranks(x), ranks(y)))
        slope = r * math.sqrt(sum((b - sum(y) / 60) ** 2 for b in y)
                              / sum((a - sum(x) / 60) ** 2 for a in x))
        assert fit[h]["beta_1"] == pytest.approx(slope)
        t = slope / fit[h]["std_error"]
        assert t == pytest.approx(r * math.sqrt(58 / (1 - r * r)))
        assert fit[h]["p_value"] == pytest.approx(got[h]["p_value"])


def test_p_values_of_known_cases(spark):
    # t = 2.228 at 10 degrees is the 5 % point; published r = 0.0074, n = 3083 gives 0.68
    t = 2.2281388519649385
    r10 = t / math.sqrt(10 + t * t)
    df = spark.createDataFrame([(r10, 12), (0.0074, 3083), (0.0, 50), (1.0, 9)], "r double, n int")
    got = [r[0] for r in df.select(stats.two_sided_p(F.col("r"), F.col("n"))).collect()]
    assert got[0] == pytest.approx(0.05, abs=1e-9)
    assert got[1] == pytest.approx(0.6813, abs=1e-3)
    assert got[2] == pytest.approx(1.0) and got[3] == 0.0


def test_quantiles_and_event_study(spark):
    df, rows = joint(spark)
    x = sorted(r[2] for r in rows)

    def q(p):
        k = (len(x) - 1) * p
        return x[math.floor(k)] * (1 - k % 1) + x[math.ceil(k)] * (k % 1)

    got = exact_quantiles(df, "mean_sentiment", [0.85, 0.15, 0.5, 0.0, 1.0]).first()
    assert list(got) == [pytest.approx(q(p)) for p in (0.85, 0.15, 0.5, 0.0, 1.0)]
    ev = stats.event_study(df).first()
    bull = [r for r in rows if r[2] >= q(0.85)]
    bear = [r for r in rows if r[2] <= q(0.15)]
    assert (ev["bullish_count"], ev["bearish_count"]) == (len(bull), len(bear))
    mean = [sum(r[3] for r in side) / len(side) for side in (bull, bear)]
    assert ev["spread_1d"] == pytest.approx(mean[0] - mean[1])


def test_event_sides_overlap_when_limits_coincide(spark):
    df = joint(spark)[0].withColumn("mean_sentiment", F.lit(0.5))
    ev = stats.event_study(df).first()
    assert ev["bullish_count"] == ev["bearish_count"] == 60 and ev["spread_1d"] == 0.0


def test_lag_correlation(spark):
    df, rows = joint(spark)
    got = {(r["ticker"], r["lag_days"]): r for r in stats.lag_correlation(df).collect()}
    a = [r for r in rows if r[0] == "A"]
    s, ret = [r[2] for r in a], [r[3] for r in a]
    assert got[("A", 2)]["pearson_r"] == pytest.approx(pearson(s[:-2], ret[2:]))
    assert got[("A", -1)]["pearson_r"] == pytest.approx(pearson(s[1:], ret[:-1]))
    assert got[("A", 0)]["n_samples"] == len(a)
    assert stats.lag_correlation(df.limit(8)).count() == 0


def test_running_totals_with_a_hot_value(spark):
    rnd = random.Random(1)
    values = [0.25] * 400 + [rnd.random() for _ in range(600)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
    counts = df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    for r in running_totals(counts, ["v"]).collect():
        assert r["before"] == sum(v < r["v"] for v in values)
    ranked = {r["value"]: r["rank"] for r in average_ranks(df, ["v"]).collect()}
    assert ranked[0.25] == ranks(values)[0]


def test_scatter_trend(spark):
    df, rows = joint(spark)
    r = stats.scatter_trend(df).collect()
    assert len(r) == 60 and len({(x["slope"], x["intercept"]) for x in r}) == 1


def test_carried_ranks_with_hot_values_and_nulls(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([0.0, 0.0, 0.0, 1.0, -1.0, rnd.random()]),
             None if i % 9 == 0 else float(rnd.randint(0, 40)), 7.0) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, a double, b double, value double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")  # runs that span several partitions
    try:
        got = ordering.carried_ranks(df, "id", ["a", "b", "value"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for k, name in ((1, "a"), (2, "b"), (3, "value")):
        kept = [r for r in rows if r[k] is not None]
        want = dict(zip([r[0] for r in kept], ranks([r[k] for r in kept])))
        assert {r["row"]: r["rank"] for r in got if r["column_name"] == name} == want
    assert ordering.carried_ranks(df.limit(0), "id", ["a", "b"]).count() == 0
