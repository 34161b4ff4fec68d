"""The end-to-end compositions.  Each takes tables and gives tables; tables that several
branches read are written in between."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentivane.functions import text as X
from sentivane.functions.labels import threshold_label
from sentivane.functions.prompts import PromptSpec, prompt_key
from sentivane.functions.tickers import DEFAULT_STOP, detect_tickers
from sentivane.operators import dedup, errors, lexicon, market, metrics, models, quality
from sentivane.operators import splits, stats, weak
from sentivane.session import one_row, stage
from sentivane.sources import sinks
from sentivane.sources.posts import assert_real, label_carry, tag_provenance
from sentivane.vocab import HORIZONS

MIN_LENGTH = 15


def preprocess(raw: DataFrame, min_length: int = MIN_LENGTH, order: str = "post_id",
               stop_words: Sequence[str] = DEFAULT_STOP) -> DataFrame:
    """Raw posts to processed posts: clean, drop short ones, first of equal texts, tag tickers.

    The posts are scanned and cleaned once; only possible duplicates are exchanged.  `order`
    decides which copy is the first.
    """
    df = tag_provenance(raw)
    title = F.col("title") if "title" in df.columns else F.lit("")
    body = F.col("body") if "body" in df.columns else F.lit("")
    text = X.combine_clean(X.clean_text(title), X.clean_text(body))
    df = X.keep_long(df, text, min_length)
    df = dedup.first_per_text(df, "text", order)
    found = detect_tickers(F.col("text"), stop_words)
    df = label_carry(df.select("*", F.inline(F.array(found))))
    renamed = {"confidence": "ticker_confidence", "method": "detection_method"}
    return df.select(
        *[F.col(c).alias(renamed.get(c, c)) for c in df.columns if c != "_sentiment"],
        X.char_length(F.col("text")).alias("char_length"),
        X.clean_word_count(F.col("text")).alias("word_count"),
    )


def preprocess_and_split(raw: DataFrame, strategy: str = "stratified", **kw) -> DataFrame:
    """Processed posts with their split.  The processed table is written once and split from
    there, because the split reads it several times."""
    return splits.create_splits(stage(preprocess(raw, **kw), "processed"), strategy)


def inference_requests(posts: DataFrame, examples: DataFrame, model: str, temperature: str,
                       paths: int = 8, spec: PromptSpec = PromptSpec()) -> DataFrame:
    """(post_id, path_id, prompt, prompt_key) for an external batch inference run."""
    prompts = weak.render_prompts(posts, examples, spec, paths=paths)
    return prompts.select(
        "post_id", "path_id", "prompt",
        prompt_key(F.lit(model), F.lit(temperature), F.lit(spec.system_prompt),
                   F.col("prompt")).alias("prompt_key"))


def weak_labels(responses: DataFrame, posts: DataFrame | None = None, threshold: int = 5,
                tie_rule: str = "neutral_default") -> DataFrame:
    """Responses (post_id, path_id, response) to consistency-filtered weak labels."""
    paths = weak.parse_responses(responses.select("post_id", "path_id", "response"))
    kept = weak.keep_consistent(weak.vote(paths, tie_rule), threshold)
    return kept if posts is None else weak.with_posts(kept, posts)


def weak_label_run(requests: DataFrame, cache: DataFrame, posts: DataFrame, val: DataFrame,
                   test: DataFrame, threshold: int = 5, **kw) -> DataFrame:
    """Requests (post_id, path_id, prompt_key) met with stored responses (prompt_key, response),
    voted, filtered, distilled into a student and scored on `test`.

    Requests without a response yet are left out of the vote; `weak.pending` lists them.
    """
    answers = weak.answered(requests, cache).filter(F.col("response").isNotNull())
    return distil(stage(weak_labels(answers, posts, threshold), "weak"), val, test, **kw)


def distil(weak_train: DataFrame, val: DataFrame, test: DataFrame, **kw) -> DataFrame:
    """Train the score regressor on weak labels, tune theta on `val`, score `test`."""
    student = models.StudentRegressor(**kw).fit(weak_train)
    tuned = metrics.best_theta(metrics.theta_scores(
        student.transform(val).select(F.col("sentiment_label").alias("truth"), "score")
    )).first()
    theta = tuned["theta"] if tuned["theta"] is not None else 0.20
    scored = student.transform(test).select(
        F.col("sentiment_label").alias("truth"), "score",
        threshold_label(F.col("score"), theta).alias("pred"))
    spread = scored.agg(F.avg("score").alias("mean_predicted_score"),
                        F.stddev_pop("score").alias("std_predicted_score"))
    return metrics.classification_metrics(scored).withColumn(
        "optimal_theta", F.lit(theta)).withColumn("spread", one_row(spread)).select(
        "*", "spread.*").drop("spread")


def market_signals(posts: DataFrame, bars: DataFrame, min_posts: int = 1,
                   horizons: Sequence[int] = HORIZONS, ts: str = "timestamp",
                   wanted: Sequence[str] | None = None,
                   earliest: dt.date = dt.date(2020, 1, 1),
                   latest: dt.date = dt.date(2025, 7, 20)) -> DataFrame:
    """Posts and bars to the joint table of daily sentiment and forward returns.

    Posts without any score are scored with the lexicon, on their whole text.
    """
    assert_real(posts)
    kw = {} if wanted is None else {"wanted": wanted}
    posts = market.universe_filter(posts, **kw)
    if "sentiment_score" not in posts.columns or not posts.filter(
            F.col("sentiment_score").isNotNull()).limit(1).count():
        scores = lexicon.lexicon_score(posts).select(
            "post_id", F.col("compound").alias("sentiment_score"),
            F.col("label").alias("sentiment_label"))
        posts = posts.drop("sentiment_score", "sentiment_label").join(scores, "post_id")
    # one row: the period is known before the bars are read, so it reaches their scan
    period = market.study_period(posts, ts, earliest, latest).first()
    bars = bars.filter(F.col("date").between(
        F.lit(period["start_date"]), F.date_sub(F.lit(period["end_date"]), 1)))
    priced = market.forward_returns(bars, horizons)
    calendar = bars.select(F.col("date").alias("trading_date")).distinct()
    daily = market.daily_sentiment(market.align_trading_day(posts, calendar, ts), min_posts)
    return market.sentiment_returns(daily, priced)


def _measures(df: DataFrame, key: str | None) -> DataFrame:
    """(item, measure, value): every column but the key as a number in a row of its own."""
    item = F.col(key).cast("string") if key else F.lit(None).cast("string")
    return df.select(F.inline(F.array(*[
        F.struct(item.alias("item"), F.lit(c).alias("measure"),
                 F.col(c).cast("double").alias("value")) for c in df.columns if c != key])))


def market_summary(joint: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """All statistics of the joint table as (analysis, name, value) rows.

    The joint table is written once and read from there.
    """
    joint = stage(joint, "joint")
    parts = []

    def add(analysis: str, df: DataFrame, key: str | None) -> None:
        df = df.drop("features")
        name = F.concat_ws(".", "item", "measure")
        parts.append(_measures(df, key).select(
            F.lit(analysis).alias("analysis"), name.alias("name"), "value"))

    add("pearson", stats.pearson(joint, horizons=horizons, p_values=True), "horizon")
    add("pearson_weighted",
        stats.pearson(joint, "weighted_sentiment", horizons, p_values=True), "horizon")
    add("spearman", stats.spearman(joint, horizons=horizons, p_values=True), "horizon")
    add("ols", stats.ols(joint, horizons=horizons, p_values=True), "horizon")
    add("events", stats.event_study(joint), None)
    add("direction", models.direction_models(joint), "model")
    add("total", joint.groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("joint_observations"), F.count(F.lit(1)).alias("tickers")), None)
    return reduce(DataFrame.unionByName, parts)


def market_run(joint: DataFrame, folder: str, experiment_id: str) -> DataFrame:
    """The statistics of a joint table, written as a report and into the experiment log.

    Returns the log's rows of this experiment; a rerun replaces them.
    """
    summary = stage(market_summary(joint), "summary").select(
        F.lit(experiment_id).alias("experiment_id"), "analysis", "name", "value")
    sinks.write_report(summary, f"{folder}/report")
    sinks.append_log(summary, f"{folder}/log")
    return sinks.read_log(joint.sparkSession, f"{folder}/log").filter(
        F.col("experiment_id") == experiment_id)


def benchmark(train: DataFrame, test: DataFrame, votes: DataFrame | None = None,
              kinds: Sequence[str] = ("logreg", "svm", "nb"), **kw) -> DataFrame:
    """Leaderboard of the lexicon, the TF-IDF classifiers and (given votes) the teacher."""
    assert_real(train)
    assert_real(test)
    truth = test.select("post_id", F.col("sentiment_label").alias("truth"))
    rows = lexicon.lexicon_score(test).select("post_id", F.col("label").alias("pred")).join(
        truth, "post_id").select(F.lit("lexicon").alias("model"), "truth", "pred")
    # one vocabulary and one set of vectors for all classifiers
    tfidf = models.TfIdf(kw.get("size", models.MAX_FEATURES)).fit(train)
    seen = stage(tfidf.transform(train.filter(F.col("sentiment_label").isNotNull())).select(
        "text", "sentiment_label", "features"), "seen")
    held = stage(tfidf.transform(test).select("sentiment_label", "features"), "held")
    for kind in kinds:
        model = models.TextClassifier(kind, **kw).fit_features(tfidf, seen)
        rows = rows.unionByName(model.score(held).select(
            F.lit(f"tfidf_{kind}").alias("model"), F.col("sentiment_label").alias("truth"),
            "pred"))
    if votes is not None:
        rows = rows.unionByName(votes.join(truth, "post_id").select(
            F.lit("teacher_vote").alias("model"), "truth",
            F.col("dominant_label").alias("pred")))
    return metrics.leaderboard(rows)


def error_report(predictions: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """Errors per model and category; predictions may carry the text themselves."""
    return errors.error_breakdown(errors.diagnose(predictions, posts))


def quality_report(df: DataFrame, name: str = "full") -> DataFrame:
    """The whole profile of a processed table as rows (split, part, item, measure, value).

    The parts stay tables, so a part may have any number of items; times are seconds since 1970.
    The columns that several parts need are written once in between.
    """
    cols = [c for c in ("text", "timestamp", "ticker", "sentiment_label", "subreddit")
            if c in df.columns]
    slim = stage(df.select(*cols), "quality")
    total = slim.agg(F.count(F.lit(1)).alias("total_rows")).withColumn(
        "total_columns", F.lit(len(df.columns)))
    parts = [("totals", total, None),
             ("schema_validation", quality.null_profile(df), "column_name")]
    if "text" in cols:
        parts.append(("text_statistics", quality.text_stats(slim), "measure"))
    if "sentiment_label" in cols:
        parts.append(
            ("sentiment_distribution", quality.label_distribution(slim), "sentiment_label"))
    if "ticker" in cols:
        parts.append(("ticker_coverage", quality.ticker_coverage(slim), None))
        parts.append(("top_tickers", quality.top_values(slim), "ticker"))
    if "subreddit" in cols:
        parts.append(
            ("subreddit_distribution", quality.value_counts(slim, "subreddit"), "subreddit"))
    if "timestamp" in cols:
        times = quality.temporal_coverage(
            slim.withColumn("timestamp", F.col("timestamp").cast("timestamp")))
        parts.append(("temporal_coverage", times, None))
    rows = [_measures(table, key).select(
        F.lit(name).alias("split"), F.lit(part).alias("part"), "*") for part, table, key in parts]
    return reduce(DataFrame.unionByName, rows)
