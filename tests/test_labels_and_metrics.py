"""Votes, filters, ablations, metrics, calibration, splits and duplicates."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sentivane.operators import dedup, quality, splits
from sentivane.operators import errors as EO
from sentivane.operators import lexicon
from sentivane.operators import metrics as M
from sentivane.operators import weak as K

PATHS = "post_id string, path_id int, label string, confidence double, reasoning_summary string"


def paths(spark, *posts):
    rows = []
    for pid, labels in posts:
        for i, (label, conf) in enumerate(labels):
            rows.append((pid, i + 1, label, conf, f"because reason {i}" if i else "short"))
    return spark.createDataFrame(rows, PATHS)


def test_majority_vote(spark):
    p = paths(spark, ("p1", [("positive", 0.9)] * 6 + [("neutral", 0.7)] * 2))
    r = K.vote(p).first()
    assert (r["positive_count"], r["neutral_count"], r["negative_count"]) == (6, 2, 0)
    assert (r["dominant_label"], r["agreement_score"], r["teacher_soft_score"]) == (
        "positive", 0.75, 0.75)
    assert r["reasoning_sample"] == "because reason 1" and not r["is_tie"]


@pytest.mark.parametrize("rule, want", [
    ("neutral_default", "neutral"), ("highest_confidence", "negative"), ("first", "positive")])
def test_tie_rules(spark, rule, want):
    p = paths(spark, ("p", [("positive", 0.6), ("negative", 0.9), ("positive", 0.7),
                            ("negative", 0.8)]))
    r = K.vote(p, rule).first()
    assert r["is_tie"] and r["dominant_label"] == want


def test_unknown_tie_rule(spark):
    with pytest.raises(ValueError):
        K.vote(paths(spark, ("p", [("positive", 1.0)])), "coin")


def test_consistency_and_retention(spark):
    weak = spark.createDataFrame(
        [("p1", 8, "positive", 1.0), ("p2", 6, "negative", 0.75), ("p3", 4, "neutral", 0.5)],
        "post_id string, dominant_count long, dominant_label string, agreement_score double")
    assert K.keep_consistent(weak).count() == 2
    r = K.retention_stats(weak).first()
    assert (r["initial_count"], r["retained_count"], r["retention_pct"]) == (3, 2, 66.67)
    assert r["mean_agreement"] == 0.875 and r["positive_share"] == 0.5 and r["rule"] == "5/8"
    grid = {x["threshold"]: x["retained_count"]
            for x in K.retention_stats(weak, [5, 8, 9]).collect()}
    assert grid == {5: 2, 8: 1, 9: 0}


def test_path_ablation(spark):
    p = paths(spark, ("1", [("positive", 1.0), ("negative", 1.0), ("negative", 1.0)]),
              ("2", [("neutral", 1.0)] * 3))
    truth = spark.createDataFrame([("1", "BEARISH"), ("2", "NEUTRAL")],
                                  "post_id string, truth string")
    got = {r["num_paths"]: r for r in K.path_ablation(p, truth, [1, 2, 3]).collect()}
    assert [got[k]["accuracy"] for k in (1, 2, 3)] == [0.5, 0.5, 1.0]
    assert got[2]["mean_agreement"] == pytest.approx(0.75)


def test_cache_join(spark):
    req = spark.createDataFrame([("a",), ("b",), ("a",)], "prompt_key string")
    cache = spark.createDataFrame([("a", "yes")], "prompt_key string, response string")
    assert K.answered(req, cache).filter("response = 'yes'").count() == 2
    assert [r[0] for r in K.pending(req, cache).collect()] == ["b"]


def test_usage_cost(spark):
    u = spark.createDataFrame([("openai", 1000, 100), ("mock", 5, 5)],
                              "provider string, prompt_tokens long, completion_tokens long")
    got = {r["provider"]: r["cost_usd"] for r in K.usage_cost(u).collect()}
    assert got["openai"] == pytest.approx(0.00021) and got["mock"] == 0.0


def pairs(spark, truth, pred):
    return spark.createDataFrame(list(zip(truth, pred)), "truth string, pred string")


def brute(truth, pred, labels=("BULLISH", "NEUTRAL", "BEARISH")):
    f1s, recalls = [], []
    for c in labels:
        tp = sum(t == p == c for t, p in zip(truth, pred))
        den = sum(t == c for t in truth) + sum(p == c for p in pred)
        f1s.append(2 * tp / den if den else 0.0)
    for c in set(truth):
        recalls.append(sum(t == p == c for t, p in zip(truth, pred)) / truth.count(c))
    return sum(f1s) / len(labels), sum(recalls) / len(recalls)


def test_metrics_reference_case(spark):
    m = M.classification_metrics(pairs(
        spark, ["BULLISH", "BEARISH", "NEUTRAL", "BULLISH"],
        ["BULLISH", "NEUTRAL", "NEUTRAL", "BULLISH"])).first()
    assert m["accuracy"] == 0.75 and m["bullish_recall"] == 1.0 and m["bullish_support"] == 2
    assert m["total_samples"] == 4


def test_metrics_against_brute_force(spark):
    rnd = random.Random(5)
    names = ["BULLISH", "NEUTRAL", "BEARISH", "OTHER"]
    truth = [rnd.choice(names) for _ in range(200)]
    pred = [rnd.choice(names) for _ in range(200)]
    m = M.classification_metrics(pairs(spark, truth, pred), digits=10).first()
    macro, balanced = brute(truth, pred)
    assert m["macro_f1"] == pytest.approx(macro) and m["balanced_accuracy"] == pytest.approx(balanced)


def test_binary_labels_keep_three_classes_in_macro(spark):
    m = M.classification_metrics(pairs(
        spark, ["positive", "negative"], ["Bullish ", "BEARISH"])).first()
    assert m["accuracy"] == 1.0 and m["macro_f1"] == 0.6667
    two = M.classification_metrics(pairs(spark, ["positive", "negative"], ["BULLISH", "BEARISH"]),
                                   labels=["BULLISH", "BEARISH"]).first()
    assert two["macro_f1"] == 1.0


def test_confusion_matrix(spark):
    c = M.confusion_matrix(M.prediction_counts(pairs(
        spark, ["positive", "BULLISH", "X"], ["BULLISH", "NEUTRAL", "BULLISH"])))
    got = {(r["truth"], r["pred"]): r["n"] for r in c.collect()}
    assert len(got) == 9 and got[("BULLISH", "BULLISH")] == 1 and sum(got.values()) == 2


def test_calibration(spark):
    conf = [0.3, 0.05, 1.0, 0.95, 0.999, 0.7]
    df = spark.createDataFrame([(c, i % 2) for i, c in enumerate(conf)],
                               "confidence double, correct int")
    binned = M.calibration_bins(df)
    sizes = {r["bin"]: r["size"] for r in binned.collect()}
    edges = M.bin_edges(10)
    want = {i: sum(edges[i] <= c < edges[i + 1] for c in conf) for i in range(10)}
    assert sizes == want and sum(sizes.values()) + conf.count(1.0) == len(conf)
    assert sizes[2] == 1  # 0.3 lies below the float edge 0.30000000000000004
    empty = binned.filter("bin = 4").first()
    assert (empty["accuracy"], empty["confidence"]) == (0.0, pytest.approx(0.45))
    e = M.calibration_error(binned).first()
    assert 0 < e["ece"] <= e["mce"] and e["total_samples"] == 6


def test_theta_tuning(spark):
    rows = spark.createDataFrame(
        [("BULLISH", 0.32), ("BULLISH", 0.5), ("NEUTRAL", 0.25), ("BEARISH", -0.6),
         ("NEUTRAL", -0.1)], "truth string, score double")
    scores = {r["theta"]: r["macro_f1"] for r in M.theta_scores(rows).collect()}
    assert set(scores) == {0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40}
    best = M.best_theta(M.theta_scores(rows)).first()
    assert best["theta"] == 0.25 and best["macro_f1"] == 1.0


def test_binary_metrics_against_brute_force(spark):
    rnd = random.Random(9)
    data = [(rnd.randint(0, 1), rnd.choice([0.1, 0.4, 0.6, 0.9])) for _ in range(80)]
    m = M.binary_metrics(spark.createDataFrame(data, "truth int, score double")).first()
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert m["auc_roc"] == pytest.approx(wins / len(pos) / len(neg))
    assert m["accuracy"] == pytest.approx(sum((s > 0.5) == bool(y) for y, s in data) / 80)


def test_leaderboard_order(spark):
    df = spark.createDataFrame(
        [("b", "BULLISH", "BULLISH"), ("a", "BULLISH", "BEARISH"), ("c", "BULLISH", "BULLISH")],
        "model string, truth string, pred string")
    board = M.leaderboard(df)
    assert [r["model"] for r in board.collect()] == ["b", "c", "a"]
    assert M.best_model(board).first()["model"] == "b"


def labelled(spark, n=100):
    return spark.createDataFrame(
        [(f"p_{i}", f"Unique financial post content number {i}",
          ["BULLISH", "BEARISH", "NEUTRAL", "BULLISH"][i % 4]) for i in range(n)],
        "post_id string, text string, sentiment_label string"
    ).withColumn("timestamp", F.timestamp_seconds(F.hash("post_id") % 1000000))


@pytest.mark.parametrize("strategy", ["stratified", "chronological"])
def test_split_sizes_and_leakage(spark, strategy):
    s = splits.create_splits(labelled(spark), strategy).persist()
    n = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert n == {"train": 70, "val": 15, "test": 15}
    assert all(r["shared"] == 0 for r in dedup.split_overlap(s, F.col("text")).collect())


def test_stratified_keeps_shares(spark):
    s = splits.split_stratified(labelled(spark, 400))
    n = {(r[0], r[1]): r[2] for r in s.groupBy("split", "sentiment_label").count().collect()}
    assert n[("train", "BULLISH")] == 140 and n[("train", "NEUTRAL")] == 70


def test_stratified_falls_back_without_all_labels(spark):
    df = labelled(spark).withColumn(
        "sentiment_label", F.when(F.col("post_id") != "p_1", F.col("sentiment_label")))
    n = {r["split"]: r["count"] for r in splits.split_stratified(df).groupBy("split").count()
         .collect()}
    assert n == {"train": 70, "val": 15, "test": 15}


def test_chronological_with_one_hot_timestamp_and_nulls(spark):
    df = labelled(spark, 300).withColumn(
        "timestamp", F.when(F.col("post_id") == "p_0", None).when(
            F.col("sentiment_label") == "BULLISH", F.to_timestamp(F.lit("1970-01-05")))
        .otherwise(F.col("timestamp")))
    s = splits.split_chronological(df).persist()
    n = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert n == {"train": 210, "val": 45, "test": 45}
    assert s.filter("timestamp IS NULL").first()["split"] == "train"
    t = {r["split"]: (r["lo"], r["hi"]) for r in s.groupBy("split").agg(
        F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")).collect()}
    assert t["train"][1] <= t["val"][0] and t["val"][1] <= t["test"][0]


def test_ratios_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        splits.create_splits(labelled(spark), train=0.8)


def test_first_per_text(spark):
    df = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, "b", None)],
                               "post_id int, text string, note string")
    got = {(r["post_id"], r["text"], r["note"]) for r in
           dedup.first_per_text(df, "text", "post_id").collect()}
    assert got == {(1, "a", "y"), (2, "b", None)}


def test_first_per_text_for_any_size_of_the_filter(spark):
    texts = [None, "", *[f"text {i % 70}" for i in range(150)], *["hot"] * 80, None, ""]
    df = spark.createDataFrame([(len(texts) - i, t, i) for i, t in enumerate(texts)],
                               "seen int, text string, digest int")
    lowest = {}
    for i, t in enumerate(texts):
        lowest[t] = min(lowest.get(t, 1000), len(texts) - i)
    for bitmaps in (1, 4096):
        got = dedup.first_per_text(df, "text", "seen", bitmaps)
        assert got.columns == df.columns
        rows = got.collect()
        assert len(rows) == len(lowest) and {r["text"]: r["seen"] for r in rows} == lowest
    assert dedup.first_per_text(df.limit(0), "text", "seen").count() == 0


def test_filter_holds_every_key(spark):
    keys = spark.range(500).select(F.col("id").cast("string").alias("k"))
    bits = dedup.seen_filter(keys, "k", 2)
    assert bits.count() <= 2
    assert dedup.seen_in(keys, bits, "k", 2).filter("NOT seen").count() == 0
    others = spark.range(1000, 3000).select(F.col("id").cast("string").alias("k"))
    assert dedup.seen_in(others, bits, "k", 2).filter("seen").count() < 60


def test_unique_texts_are_not_exchanged(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "post_id int, text string")
        plan = dedup.first_per_text(df, "text", "post_id")._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    alone = plan.toString().split("SortMergeJoin")[0]
    assert "Exchange hashpartitioning(digest" not in alone


def test_model_disagreement(spark):
    posts = spark.createDataFrame([("1", "iv crush " * 50), ("2", "meh")],
                                  "post_id string, text string")
    preds = spark.createDataFrame(
        [("1", "m1", "BULLISH", "bullish "), ("1", "m2", "BULLISH", "BEARISH"),
         ("2", "m1", "NEUTRAL", "NEUTRAL")],
        "post_id string, model string, truth string, pred string")
    got = {r["post_id"]: r for r in
           EO.model_disagreement(posts, preds, ["m1", "m2"]).collect()}
    assert got["1"]["total_models_failing"] == 1 and got["1"]["m2_error"]
    assert not got["1"]["m1_error"] and len(got["1"]["text"]) == 303
    assert got["2"]["m2_pred"] is None and got["2"]["error_category"] == "SUBTLE_IMPLICIT_SENTIMENT"


def test_lexicon_cases(spark):
    posts = spark.createDataFrame([
        (1, "Massive revenue beat! NVDA to the moon buying calls"),
        (2, "Company is drilling down, massive dilution and bankruptcy risk. Puts are printing."),
        (3, "What time is the 10-Q filing scheduled tomorrow?"), (4, "not good"), (5, "very good"),
        (6, "good"), (7, "")], "post_id int, text string")
    got = {r["post_id"]: r for r in lexicon.lexicon_score(posts).collect()}
    assert len(got) == 7
    assert got[1]["label"] == "BULLISH" and got[2]["label"] == "BEARISH"
    assert got[3]["label"] == "NEUTRAL" and got[7]["compound"] == 0.0
    assert got[4]["valence"] == pytest.approx(1.9 * -0.74)
    assert got[5]["valence"] == pytest.approx(1.9 + 0.293)
    assert got[6]["compound"] == pytest.approx(round(1.9 / math.sqrt(1.9 ** 2 + 15), 4))
    own = spark.createDataFrame([("time", -3.0)], "word string, valence double")
    assert lexicon.lexicon_score(posts, own).filter("post_id = 3").first()["label"] == "BEARISH"


def test_quality_parts(spark):
    df = spark.createDataFrame(
        [("a b c", "X", "2023-01-01 10:00:00"), ("dd", None, "2023-01-03 09:59:59")],
        "text string, ticker string, t string").withColumn("timestamp", F.to_timestamp("t"))
    nulls = {r["column_name"]: r for r in quality.null_profile(df, ["text", "label"]).collect()}
    assert nulls["ticker"]["null_count"] == 1 and nulls["ticker"]["null_pct"] == 50.0
    assert not nulls["label"]["present"]
    st = {r["measure"]: r for r in quality.text_stats(df).collect()}
    assert (st["char_count"]["min"], st["char_count"]["max"], st["word_count"]["median"]) == (2, 5, 2.0)
    assert quality.temporal_coverage(df).first()["days_span"] == 1
    cov = quality.ticker_coverage(df).first()
    assert (cov["posts_with_ticker"], cov["coverage_pct"], cov["unique_tickers"]) == (1, 50.0, 1)
    h = quality.histogram(spark.range(101).toDF("v"), F.col("v"), 50).collect()
    assert len(h) == 50 and {r["bin"]: r["n"] for r in h}[49] == 3
    one = quality.histogram(spark.range(1).toDF("v"), F.col("v"), 50).collect()
    assert one[0]["n"] == 1


def test_stratified_split_of_many_classes(spark):
    rows = [(i, f"c{i % 1500:04d}") for i in range(6000)]
    got = split_counts(splits.split_stratified(
        spark.createDataFrame(rows, "post_id long, sentiment_label string")))
    assert got == {"train": 4200, "val": 900, "test": 900}
    lacking = spark.createDataFrame([*rows, (9000, None)], "post_id long, sentiment_label string")
    got = split_counts(splits.split_stratified(lacking))
    assert sum(got.values()) == 6001 and got["train"] == 4200


def split_counts(df):
    return {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}


def test_quotas_by_largest_remainder(spark):
    counts = spark.createDataFrame([("a", 3), ("b", 3), ("c", 4)], "label string, n long")
    got = splits.largest_remainder(counts, 7, 10, "n", "q").collect()
    assert {r["label"]: r["q"] for r in got} == {"a": 2, "b": 2, "c": 3}


def test_cut_in_a_doubled_hour(spark):
    """The cut passes the driver as a number: a driver in a summer-time zone must not move it."""
    import os
    import time

    rows = [(i, f"2024-10-27 00:{i:02d}:00") for i in range(60)] + \
        [(60 + i, f"2024-10-27 01:{i:02d}:00") for i in range(60)]
    df = spark.createDataFrame(rows, "post_id long, t string").selectExpr(
        "post_id", "CAST(t AS TIMESTAMP) AS timestamp")
    before = os.environ.get("TZ")
    try:
        os.environ["TZ"] = "Europe/Berlin"
        time.tzset()
        got = splits.split_chronological(df, train=0.7, val=0.15)
        assert {r["post_id"] for r in got.filter("split = 'train'").collect()} == set(range(84))
    finally:
        os.environ.pop("TZ")
        if before is not None:
            os.environ["TZ"] = before
        time.tzset()


def test_metrics_by_group_equal_metrics_of_each(spark):
    rows = [(m, (i * 7 + len(m)) % 2, ((i * 5) % 11) / 10) for m in ("a", "bb") for i in range(40)]
    df = spark.createDataFrame(rows, "model string, truth int, score double")
    both = {r["model"]: tuple(r)[1:] for r in M.binary_metrics(df, by=["model"]).collect()}
    for m in ("a", "bb"):
        assert both[m] == pytest.approx(tuple(M.binary_metrics(df.filter(f"model = '{m}'")).first()))


def test_tie_rules_in_one_pass_equal_single_votes(spark):
    paths = spark.createDataFrame(
        [(1, 1, "positive", 0.9), (1, 2, "negative", 0.4), (2, 1, "negative", 0.2),
         (2, 2, "neutral", 0.7), (3, 1, "positive", 0.5), (3, 2, "positive", 0.1),
         (4, 1, None, 0.3)],
        "post_id long, path_id int, label string, confidence double")
    both = {r["post_id"]: r.asDict() for r in K.tie_rules(paths).collect()}
    assert len(both) == 4
    for rule in K.TIE_RULES:
        for r in K.vote(paths, rule).collect():
            assert both[r["post_id"]][rule] == r["dominant_label"]
            assert both[r["post_id"]]["is_tie"] == r["is_tie"]


def test_errors_with_and_without_posts(spark):
    rows = spark.createDataFrame(
        [(1, "a", "BULLISH", "BEARISH", "yolo to the moon"), (1, "b", "BULLISH", "BULLISH", "yolo"),
         (2, "a", "NEUTRAL", None, "earnings call"), (3, "b", "BEARISH", "BULLISH", None)],
        "post_id long, model string, truth string, pred string, text string")
    posts = spark.createDataFrame(
        [(1, "yolo to the moon"), (2, "earnings call"), (3, None)], "post_id long, text string")
    carried = EO.diagnose(rows)
    joined = EO.diagnose(rows.drop("text"), posts)
    assert sorted(map(str, carried.select(joined.columns).collect())) == sorted(
        map(str, joined.collect()))
    assert carried.count() == 3
