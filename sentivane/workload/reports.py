"""Queries: sources and sinks, quality profiles, models, end-to-end compositions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sentivane.functions import text as X
from sentivane.functions.labels import threshold_label
from sentivane.functions.prompts import cue_counts
from sentivane.operators import lexicon, models, quality
from sentivane.operators import metrics as M
from sentivane.operators import weak as K
from sentivane.operators.splits import split_stratified
from sentivane.plans import flows
from sentivane.session import new_path, stage
from sentivane.sources import posts as S
from sentivane.sources import sinks
from sentivane.sources.prices import read_bars, write_bars
from sentivane.workload import inputs as I
from sentivane.workload import finance, text
from sentivane.workload.inputs import ctes
from sentivane.workload.recurrences import (
    COEFFICIENTS, DIRECTION, DIRECTION_SCORES, NAIVE_BAYES, with_p,
)
from sentivane.workload.registry import ORACLE, query, r, rounded
from sentivane.workload.text import DETECTED, LEXSQL, STRAT
from sentivane.workload.weak import metrics_sql


# ------------------------------------------------------------------ sources
def _dump(spark, sf):
    """Documents under the column names of a public dump."""
    return I.table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
        (F.lit(1_600_000_000) + F.col("doc_id") * 3600).cast("double").alias("created_utc"),
        "text", F.col("n_chars").alias("ups"), F.col("lang").alias("subreddit"),
        F.when(F.length("text") % 4 == 0, "Synthetic_v1").otherwise(F.col("source"))
        .alias("origin"))


@query("scan_posts", "SELECT source, data_source, count(*) AS n, sum(length(body))::BIGINT AS "
       "chars FROM (SELECT source, 'REAL' AS data_source, text AS body FROM documents) "
       "GROUP BY 1, 2")
def scan_posts(spark, sf):
    """Written in the standard schema, read back with the provenance guard on."""
    d = I.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("post_id"),
        F.timestamp_seconds(F.col("doc_id")).alias("timestamp"),
        F.col("lang").alias("subreddit"), F.lit("").alias("title"), F.col("text").alias("body"),
        F.col("n_chars").alias("score"), F.lit(0).cast("bigint").alias("num_comments"), "source")
    path = new_path(spark, "posts")
    d.write.parquet(path)
    return S.read_posts(spark, path).groupBy("source", "data_source").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("body")).alias("chars"))


@query("standardise_posts", "SELECT 'd' || doc_id AS post_id, strftime(make_timestamp((1600000000 "
       "+ doc_id * 3600) * 1000000), '%Y-%m-%d %H:%M:%S') AS ts, lang AS subreddit, '' AS title, "
       "text AS body, n_chars AS score, 0::BIGINT AS num_comments, 'dump' AS source, "
       "'REAL' AS data_source FROM documents")
def standardise_posts(spark, sf):
    out = S.standardise(_dump(spark, sf).drop("origin"), "dump")
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"),
                             F.col("timestamp").cast("timestamp_ntz"))
    return out.withColumn("ts", F.date_format(utc, "yyyy-MM-dd HH:mm:ss")).drop("timestamp")


@query("to_utc", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events")
def to_utc(spark, sf):
    """Event times written as text and read again."""
    e = I.table(spark, sf, "events")
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    back = S.to_utc(text, text_type())
    return e.select("event_id", F.date_format(back, "yyyy-MM-dd HH:mm:ss").alias("ts"))


def text_type():
    from pyspark.sql.types import StringType

    return StringType()


_ORIGIN = ("o AS (SELECT doc_id, CASE WHEN length(text) % 4 = 0 THEN 'Synthetic_v1' ELSE source "
           "END AS source FROM documents), t AS (SELECT *, CASE WHEN lower(source) LIKE "
           "'%synthetic%' THEN 'SYNTHETIC' ELSE 'REAL' END AS data_source FROM o)")


def _tagged(spark, sf):
    d = _dump(spark, sf).select("id", F.col("origin").alias("source"))
    return S.tag_provenance(d)


@query("tag_provenance", ctes(extra=_ORIGIN) +
       "SELECT 'd' || doc_id AS id, source, data_source FROM t")
def tag_provenance(spark, sf):
    return _tagged(spark, sf)


@query("provenance_audit", ctes(extra=_ORIGIN) + "SELECT data_source, source, count(*) AS rows, "
       "data_source = 'SYNTHETIC' AS synthetic FROM t GROUP BY 1, 2")
def provenance_audit(spark, sf):
    return S.provenance_audit(_tagged(spark, sf))


FIQA = """fiqa AS (SELECT *, CASE WHEN sentiment_score > 0 THEN 'BULLISH' ELSE 'BEARISH' END AS
  sentiment_label FROM fiqa_like WHERE sentiment_score <> 0
  AND NOT regexp_matches(target, '[,;/]'))"""


@query("fiqa_protocol", ctes("fiqa_like", extra=FIQA) + "SELECT doc_id, text, format, target, "
       "sentiment_score, sentiment_label, sentiment_score AS continuous_score, 'REAL' AS "
       "data_source FROM fiqa WHERE format = 'headline'")
def fiqa_protocol(spark, sf):
    return S.fiqa_protocol(I.fiqa_like(spark, sf), "news")


@query("fiqa_benchmark", ctes("fiqa_like", extra=FIQA + ", fp AS (SELECT 'FiQA-' || CASE format "
       "WHEN 'headline' THEN 'News' ELSE 'Post' END AS dataset, m AS model, sentiment_label AS "
       "truth, CASE WHEN m = 'parity' THEN CASE WHEN length(text) % 2 = 0 THEN 'BULLISH' ELSE "
       "'BEARISH' END ELSE 'BULLISH' END AS pred FROM fiqa, (VALUES ('parity'), ('majority')) "
       "g(m))") + metrics_sql("dataset, model", "fp", "dataset model accuracy macro_f1 precision "
                              "recall samples"))
def fiqa_benchmark(spark, sf):
    rows = S.fiqa_protocol(I.fiqa_like(spark, sf))
    parity = F.when(F.length("text") % 2 == 0, "BULLISH").otherwise("BEARISH")
    long = rows.select(
        F.concat(F.lit("FiQA-"), F.when(F.col("format") == "headline", "News")
                 .otherwise("Post")).alias("dataset"),
        F.col("sentiment_label").alias("truth"),
        F.explode(F.array(
            F.struct(F.lit("parity").alias("model"), parity.alias("pred")),
            F.struct(F.lit("majority").alias("model"), F.lit("BULLISH").alias("pred")),
        )).alias("v")).select("dataset", "truth", "v.*")
    return M.fiqa_benchmark(long)


@query("label_carry", ctes("posts") + "SELECT post_id, sentiment_label, sentiment_score FROM posts")
def label_carry(spark, sf):
    hidden = I.posts(spark, sf).select(
        "post_id", F.col("sentiment_label").alias("_sentiment"))
    return S.label_carry(hidden).select("post_id", "sentiment_label", "sentiment_score")


# ------------------------------------------------------------------ sinks
@query("write_bars", ctes("bars") + "SELECT ticker, date, adj_close, volume FROM bars WHERE "
       "ticker IN ('1-URGENT', '5-LOW') AND date >= DATE '1997-01-01' AND date < "
       "DATE '1998-01-01'")
def bars_round_trip(spark, sf):
    path = new_path(spark, "bars")
    write_bars(I.bars(spark, sf), path)
    return read_bars(spark, path, ["1-URGENT", "5-LOW"], dt.date(1997, 1, 1),
                     dt.date(1998, 1, 1)).select("ticker", "date", "adj_close", "volume")


@query("write_splits", ctes("posts", extra=STRAT) + "SELECT split, count(*) AS n FROM splits "
       "GROUP BY 1")
def write_splits(spark, sf):
    path = new_path(spark, "splits")
    sinks.write_splits(split_stratified(I.posts(spark, sf)), path)
    return spark.read.parquet(path).groupBy(F.col("split").cast("string").alias("split")).agg(
        F.count(F.lit(1)).alias("n"))


@query("write_weak_labels", ctes("votes") + "SELECT dominant_label, dominant_count::BIGINT AS "
       "dominant_count, count(*) AS n FROM votes GROUP BY 1, 2")
def write_weak_labels(spark, sf):
    path = new_path(spark, "weak")
    sinks.write_table(K.vote(I.paths(spark, sf)), path)
    back = spark.read.option("header", True).schema(
        "post_id string, positive_count long, neutral_count long, negative_count long, "
        "total_paths long, dominant_label string, dominant_count long, is_tie boolean, "
        "agreement_score double, teacher_soft_score double, reasoning_sample string").csv(path)
    return back.groupBy("dominant_label", "dominant_count").agg(F.count(F.lit(1)).alias("n"))


METRIC_FILES = [("model_0", "lexicon_metrics.json", "Phase 2"),
                ("model_1", "logreg_metrics.json", "Phase 2"),
                ("model_2", "svm_metrics.json", "Phase 2")]


def _metric_files(spark, sf):
    folder = new_path(spark, "metrics")
    p = I.predictions(spark, sf)
    for model, file, _ in METRIC_FILES:
        m = M.classification_metrics(p.filter(F.col("model") == model))
        sinks.write_report(sinks.nest_metrics(m), f"{folder}/{file}")
    return folder


_BOARD = ("phase model accuracy balanced_acc macro_f1 weighted_f1 bullish_f1 bearish_f1 "
          "neutral_f1")
_NAMED = "named AS (SELECT model, truth, pred FROM predictions)"


@query("benchmark_table", ctes("predictions", extra=_NAMED) +
       "SELECT 'Phase 2' AS phase, * RENAME (balanced_accuracy AS balanced_acc) FROM (" +
       metrics_sql("model", "named", "model accuracy balanced_accuracy macro_f1 weighted_f1 "
                   "bullish_f1 bearish_f1 neutral_f1") + ")")
def benchmark_table(spark, sf):
    return sinks.benchmark_table(spark, _metric_files(spark, sf), METRIC_FILES).select(*_BOARD.split())


@query("write_report", ctes("predictions") + "SELECT count(*) AS reports, round(max(a), 4) AS "
       "best_accuracy FROM (SELECT avg((truth = pred)::INT) AS a FROM predictions "
       "GROUP BY model)")
def write_report(spark, sf):
    raw = spark.read.option("recursiveFileLookup", True).schema("accuracy double").json(
        _metric_files(spark, sf))
    return raw.agg(F.count(F.lit(1)).alias("reports"), F.max("accuracy").alias("best_accuracy"))


_LOG = ("SELECT 'F1' AS experiment_id, ticker, count(*) AS posts, NULL::DOUBLE AS mean_score "
        "FROM posts GROUP BY ticker UNION ALL SELECT 'F2', ticker, NULL, "
        "round(avg(sentiment_score), 6) FROM posts GROUP BY ticker")


def _log_parts(spark, sf):
    p = I.posts(spark, sf)
    one = p.groupBy("ticker").agg(F.count(F.lit(1)).alias("posts")).withColumn(
        "experiment_id", F.lit("F1"))
    two = p.groupBy("ticker").agg(F.round(F.avg("sentiment_score"), 6).alias("mean_score")
                                  ).withColumn("experiment_id", F.lit("F2"))
    return one, two


@query("experiment_log", ctes("posts") + _LOG)
def experiment_log(spark, sf):
    path = new_path(spark, "log")
    for part in _log_parts(spark, sf):
        sinks.append_log(part, path)
    return sinks.read_log(spark, path).select("experiment_id", "ticker", "posts", "mean_score")


@query("union_log", ctes("posts") + _LOG)
def union_log(spark, sf):
    return sinks.union_log(*_log_parts(spark, sf))


# ------------------------------------------------------------------ quality
_PROFILE = ("p AS (SELECT post_id, CASE WHEN score > 0 THEN ticker END AS ticker, CASE WHEN "
            "num_comments > 5 THEN sentiment_label END AS sentiment_label FROM posts)")


def _holed(spark, sf):
    p = I.posts(spark, sf)
    return p.select("post_id", F.when(F.col("score") > 0, F.col("ticker")).alias("ticker"),
                    F.when(F.col("num_comments") > 5, F.col("sentiment_label"))
                    .alias("sentiment_label"))


@query("null_profile", ctes("posts", extra=_PROFILE) + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, true AS present, count(*) FILTER ({c} IS NULL) AS null_count, "
    f"round(count(*) FILTER ({c} IS NULL) * 100.0::DOUBLE / count(*), 2) AS null_pct FROM p"
    for c in ("post_id", "ticker", "sentiment_label")) +
    " UNION ALL SELECT 'text', false, NULL, NULL")
def null_profile(spark, sf):
    return quality.null_profile(_holed(spark, sf), ["text", "ticker"])


_LEN = f"len(regexp_extract_all(text, '[^{X.SPACE}]+'))"


@query("text_stats", " UNION ALL ".join(
    f"SELECT '{name}' AS measure, min(v)::BIGINT AS min, max(v)::BIGINT AS max, round(avg(v), 1) "
    "AS mean, round(quantile_cont(v, 0.5), 1)::DOUBLE AS median, round(stddev_samp(v), 1) AS std "
    f"FROM (SELECT {e} AS v FROM documents)"
    for name, e in (("char_count", "length(text)"), ("word_count", _LEN))))
def text_stats(spark, sf):
    return quality.text_stats(I.table(spark, sf, "documents"))


@query("label_distribution", ctes("posts", extra=_PROFILE) + "SELECT sentiment_label, count(*) AS "
       "n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM p WHERE sentiment_label IS NOT "
       "NULL GROUP BY 1")
def label_distribution(spark, sf):
    return quality.label_distribution(_holed(spark, sf))


@query("ticker_coverage", ctes("posts", extra=_PROFILE) + "SELECT count(ticker) AS "
       "posts_with_ticker, round(count(ticker) * 100.0::DOUBLE / count(*), 2) AS coverage_pct, "
       "count(DISTINCT ticker) AS unique_tickers FROM p")
def ticker_coverage(spark, sf):
    return quality.ticker_coverage(_holed(spark, sf))


@query("subreddit_counts", "SELECT lang AS subreddit, count(*) AS n FROM documents GROUP BY 1")
def subreddit_counts(spark, sf):
    d = I.table(spark, sf, "documents").select(F.col("lang").alias("subreddit"))
    return quality.value_counts(d, "subreddit")


@query("temporal_coverage", ctes("activity") + "SELECT strftime(min(timestamp), '%Y-%m-%d "
       "%H:%M:%S') AS min_ts, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS max_ts, "
       "(floor((epoch_us(max(timestamp)) // 1000000 - epoch_us(min(timestamp)) // 1000000) / 86400))::BIGINT AS days_span "
       "FROM activity")
def temporal_coverage(spark, sf):
    t = quality.temporal_coverage(I.activity(spark, sf))
    return t.select(F.date_format("min_ts", "yyyy-MM-dd HH:mm:ss").alias("min_ts"),
                    F.date_format("max_ts", "yyyy-MM-dd HH:mm:ss").alias("max_ts"), "days_span")


@query("daily_trend", ctes("activity") + "SELECT timestamp::DATE AS date, count(*) AS volume, "
       "count(*) FILTER (sentiment_label = 'BULLISH') AS bullish, count(*) FILTER (sentiment_label "
       "= 'BEARISH') AS bearish, count(*) FILTER (sentiment_label = 'NEUTRAL') AS neutral, "
       "round((count(*) FILTER (sentiment_label = 'BULLISH') - count(*) FILTER (sentiment_label = "
       "'BEARISH')) / count(*), 6) AS net_sentiment FROM activity GROUP BY 1")
def daily_trend(spark, sf):
    return rounded(quality.daily_trend(I.activity(spark, sf)))


@query("overview_kpis", ctes("activity") + "SELECT count(*) AS posts, count(DISTINCT ticker) AS "
       "tickers, round(count(*) FILTER (sentiment_label = 'BULLISH') * 100 / count(*), 6) AS "
       "bullish_pct, round(count(*) FILTER (sentiment_label = 'BEARISH') * 100 / count(*), 6) AS "
       "bearish_pct FROM activity")
def overview_kpis(spark, sf):
    return rounded(quality.overview(I.activity(spark, sf)))


@query("length_histogram", "WITH l AS (SELECT length(text)::DOUBLE AS v FROM documents), s AS "
       "(SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 50 AS w FROM l) SELECT "
       "least(floor((v - lo) / w), 49)::INT AS bin, round(min(lo + least(floor((v - lo) / w), 49) "
       "* w), 6) AS low, round(min(lo + (least(floor((v - lo) / w), 49) + 1) * w), 6) AS high, "
       "count(*) AS n FROM l, s GROUP BY 1")
def length_histogram(spark, sf):
    return rounded(quality.histogram(I.table(spark, sf, "documents"), F.length("text")))


@query("top_tickers", ctes("activity") + "SELECT ticker, count(*) AS n FROM activity GROUP BY 1 "
       "ORDER BY n DESC, ticker LIMIT 15")
def top_tickers(spark, sf):
    return quality.top_values(I.activity(spark, sf), "ticker", 15)


@query("sample_head", ctes("activity") + "SELECT post_id, ticker, sentiment_label FROM activity "
       "ORDER BY post_id LIMIT 100")
def sample_head(spark, sf):
    return I.activity(spark, sf).select("post_id", "ticker", "sentiment_label").orderBy(
        "post_id").limit(100)


@query("sort_posts", ctes("activity") + "SELECT post_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') "
       "AS ts FROM activity ORDER BY timestamp, post_id")
def sort_posts(spark, sf):
    return I.activity(spark, sf).orderBy("timestamp", "post_id").select(
        "post_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("post_filter", ctes("activity") + "SELECT post_id, ticker, sentiment_label FROM activity "
       "WHERE ticker = 'click' AND sentiment_label IN ('BULLISH', 'NEUTRAL')")
def post_filter(spark, sf):
    return quality.post_filter(I.activity(spark, sf), "click", classes=["BULLISH", "NEUTRAL"]
                               ).select("post_id", "ticker", "sentiment_label")


@query("distinct_dates", ctes("calendar") + "SELECT trading_date FROM calendar")
def distinct_dates(spark, sf):
    return I.calendar(spark, sf)


PROFILED = "post_id timestamp ticker sentiment_label sentiment_score score num_comments text".split()


def _long_sql(part: str, item: str, source: str, **measures: str) -> str:
    names = ", ".join(f"'{m}'" for m in measures)
    values = ", ".join(f"({v})::DOUBLE" for v in measures.values())
    return (f"SELECT 'full' AS split, '{part}' AS part, {item} AS item, unnest([{names}]) AS measure, "
            f"unnest([{values}]) AS value FROM {source}")


QUALITY = " UNION ALL ".join([
    _long_sql("totals", "NULL::VARCHAR", "(SELECT count(*) AS n FROM p)", total_rows="n",
              total_columns=str(len(PROFILED))),
    _long_sql("schema_validation", "c", "(SELECT unnest([" + ", ".join(
        f"'{c}'" for c in PROFILED) + "]) AS c, unnest([" + ", ".join(
        f"count(*) FILTER ({c} IS NULL)" for c in PROFILED) + "]) AS nulls, count(*) AS n FROM p)",
        present="1", null_count="nulls", null_pct="round(nulls * 100.0 / n, 2)"),
    _long_sql("text_statistics", "m", "(SELECT m, min(v) AS lo, max(v) AS hi, avg(v) AS mean, "
              "median(v) AS mid, stddev_samp(v) AS sd FROM (SELECT 'char_count' AS m, length(text) "
              f"AS v FROM p UNION ALL SELECT 'word_count', {_LEN} FROM p) GROUP BY 1)",
              min="lo", max="hi", mean="round(mean, 1)", median="round(mid, 1)",
              std="round(sd, 1)"),
    _long_sql("sentiment_distribution", "sentiment_label", "(SELECT sentiment_label, count(*) AS n, "
              "sum(count(*)) OVER () AS total FROM p WHERE sentiment_label IS NOT NULL GROUP BY 1)",
              n="n", share="round(n / total, 4)"),
    _long_sql("ticker_coverage", "NULL::VARCHAR", "(SELECT count(*) AS n, count(ticker) AS k, "
              "count(DISTINCT ticker) AS u FROM p)", posts_with_ticker="k",
              coverage_pct="round(k * 100.0 / n, 2)", unique_tickers="u"),
    _long_sql("top_tickers", "ticker", "(SELECT ticker, count(*) AS n FROM p WHERE ticker IS NOT "
              "NULL GROUP BY 1 ORDER BY n DESC, ticker LIMIT 15)", n="n"),
    _long_sql("temporal_coverage", "NULL::VARCHAR", "(SELECT epoch(min(timestamp)) AS lo, "
              "epoch(max(timestamp)) AS hi FROM p)", min_ts="lo", max_ts="hi",
              days_span="floor((hi - lo) / 86400)"),
])


@query("quality_report", ctes("posts", extra="p AS (SELECT *, 'order ' || post_id || ' for ' || "
       "ticker AS text FROM posts)") + QUALITY)
def quality_report(spark, sf):
    p = I.posts(spark, sf).withColumn("text", F.concat(
        F.lit("order "), F.col("post_id").cast("string"), F.lit(" for "), F.col("ticker")))
    return flows.quality_report(p)


@query("first_existing", "SELECT o_orderkey, o_orderpriority FROM orders")
def first_existing(spark, sf):
    """The first of several places that has the table, as a view."""
    S.first_existing(
        spark, [f"{sf}/none.parquet", f"{sf}/orders.parquet", f"{sf}/events.parquet"], "found")
    return spark.table("found").select("o_orderkey", "o_orderpriority")


# ------------------------------------------------------------------ models (rows only)
def _labelled(spark, sf):
    """Cleaned documents with a label and a split, written once."""
    rows = I.clean_posts(spark, sf, labelled=True).select("post_id", "text", "sentiment_label")
    return split_stratified(stage(rows, "labelled"))


def _parts(spark, sf):
    rows = _labelled(spark, sf)
    return [rows.filter(F.col("split") == s) for s in ("train", "val", "test")]


# the strata and texts of the labelled documents, split as above
LABELLED = STRAT.replace("FROM posts", "FROM lposts").replace(
    "base AS (", "lposts AS (SELECT post_id, text, sentiment_label FROM clean_posts "
    "JOIN text_truth USING (post_id)),\nbase AS (", 1) + """,
labelled AS (SELECT post_id, text, label, split FROM splits JOIN lposts USING (post_id))"""
_TWINS = {"nb": ctes("clean_posts", "text_truth", extra=LABELLED + ",\n" + NAIVE_BAYES) +
          "SELECT post_id, label AS sentiment_label, pred FROM nbp"}


def _register_classifier(kind: str) -> None:
    @query(f"tfidf_{kind}", _TWINS.get(kind))
    def run(spark, sf):
        train, _, test = _parts(spark, sf)
        model = models.TextClassifier(kind).fit(train)
        return model.transform(test).select("post_id", "sentiment_label", "pred")


for _kind in ("logreg", "svm", "nb"):
    _register_classifier(_kind)


@query("grid_search")
def grid_search(spark, sf):
    train, val, _ = _parts(spark, sf)
    return models.grid_search(train, val)


@query("top_features")
def top_features(spark, sf):
    train, _, _ = _parts(spark, sf)
    return models.top_features(models.TextClassifier("logreg").fit(train), spark)


def _teacher(rows):
    """Weak labels from the lexicon in place of a teacher's paths."""
    scores = lexicon.lexicon_score(rows).select("post_id", "compound", "label")
    names = {"BULLISH": "positive", "BEARISH": "negative"}
    low = F.when(F.col("label") == "BULLISH", names["BULLISH"]).when(
        F.col("label") == "BEARISH", names["BEARISH"]).otherwise("neutral")
    return rows.join(scores, "post_id").select(
        "post_id", "text", "sentiment_label", F.col("compound").alias("teacher_soft_score"),
        low.alias("dominant_label"))


def _label_paths(rows):
    """Eight label paths per post, none of which sees the label: cue words that lead by more and
    more, the lexicon under rising thresholds."""
    scores = lexicon.lexicon_score(rows).select("post_id", "compound")
    bull, bear = cue_counts(F.col("text"))

    def path(value, limit):
        return F.when(value > limit, "positive").when(value < -limit, "negative").otherwise("neutral")

    counted = rows.join(scores, "post_id").select(
        "post_id", "compound", (bull - bear).alias("lead"))
    labels = F.array(*[path(F.col("lead"), m) for m in (0, 1, 2, 3)],
                     *[path(F.col("compound"), t) for t in (0.05, 0.1, 0.2, 0.35)])
    return counted.select("post_id", F.posexplode(labels).alias("path_id", "label")).withColumn(
        "confidence", F.lit(0.85))


@query("student_regression")
def student_regression(spark, sf):
    train, val, test = _parts(spark, sf)
    return flows.distil(stage(_teacher(train), "teacher"), val, test)


@query("student_classifier")
def student_classifier(spark, sf):
    train, _, test = _parts(spark, sf)
    model = models.StudentClassifier().fit(stage(_teacher(train), "teacher"))
    return model.transform(test).select("post_id", "sentiment_label", "pred")


@query("direction_models", ctes("joint", extra=DIRECTION_SCORES) + "SELECT model, " +
       r("accuracy auc_roc f1_score") + ", train_size, test_size FROM dm")
def direction_models(spark, sf):
    return rounded(models.direction_models(I.joint(spark, sf)))


@query("direction_coefficients", ctes("joint", extra=DIRECTION) + COEFFICIENTS)
def direction_coefficients(spark, sf):
    return rounded(models.direction_coefficients(I.joint(spark, sf)))


# ------------------------------------------------------------------ end to end
@query("e2e_preprocess", ctes("clean_posts", extra=DETECTED + """, kept AS (
  SELECT post_id, source, text FROM clean_posts WHERE length(text) >= 15
  QUALIFY row_number() OVER (PARTITION BY text ORDER BY post_id) = 1)""") +
       "SELECT post_id, text, ticker, company, all_tickers, confidence AS ticker_confidence, "
       "method AS detection_method, CASE WHEN lower(source) LIKE '%synthetic%' THEN 'SYNTHETIC' "
       "ELSE 'REAL' END AS data_source, length(text)::INT AS char_length, "
       f"{_LEN}::INT AS word_count FROM kept JOIN detected USING (post_id)")
def e2e_preprocess(spark, sf):
    out = flows.preprocess(I.text_posts(spark, sf).drop("raw"))
    return out.select(
        "post_id", "text", "ticker", "company",
        F.array_join("all_tickers", " ").alias("all_tickers"), "ticker_confidence",
        "detection_method", "data_source", "char_length", "word_count")


@query("e2e_weak_labels", ctes("votes", "posts") + "SELECT post_id::VARCHAR AS post_id, "
       "dominant_label, dominant_count, teacher_soft_score, ticker FROM votes JOIN posts USING "
       "(post_id) WHERE dominant_count >= 5")
def e2e_weak_labels(spark, sf):
    """Paths written as JSON answers, parsed, voted and filtered again."""
    answers = I.paths(spark, sf).select(
        "post_id", "path_id", F.to_json(F.struct(
            "reasoning_summary", F.col("label").alias("sentiment"))).alias("response"))
    return flows.weak_labels(answers, I.posts(spark, sf)).select(
        "post_id", "dominant_label", "dominant_count", "teacher_soft_score", "ticker")


# In the flow the trading days are the days of the bars.
TRADED = ",\n".join([
    "traded AS (SELECT DISTINCT date AS trading_date FROM bars)",
    I.CTES["aligned"][1].replace("ASOF JOIN calendar c", "ASOF JOIN traded c"),
    I.CTES["daily"][1], I.CTES["rets"][1], I.CTES["joint"][1]])


@query("e2e_market", ctes("posts", "bars", extra=TRADED) + "SELECT ticker, trading_date, post_count, " +
       r("mean_sentiment weighted_sentiment fwd_return_1d fwd_return_5d") + " FROM joint")
def e2e_market(spark, sf):
    p = I.posts(spark, sf).withColumn("source", F.lit("orders"))
    out = flows.market_signals(p, I.bars(spark, sf), earliest=dt.date(1990, 1, 1))
    return rounded(out.select("ticker", "trading_date", "post_count", "mean_sentiment",
                              "weighted_sentiment", "fwd_return_1d", "fwd_return_5d"))


def _measured(analysis: str, source: str, columns: str, item: str | None = None) -> str:
    name = f"{item} || '.' || " if item else ""
    return " UNION ALL ".join(
        f"SELECT '{analysis}' AS analysis, {name}'{c}' AS name, round({c}::DOUBLE, 6) AS value "
        f"FROM {source}" for c in columns.split())


_OLS = ("corr(mean_sentiment, fwd_return_#d) AS r, regr_slope(fwd_return_#d, mean_sentiment) AS "
        "beta_1, regr_intercept(fwd_return_#d, mean_sentiment) AS intercept, regr_r2(fwd_return_#d, "
        "mean_sentiment) AS r_squared, sqrt((1 - regr_r2(fwd_return_#d, mean_sentiment)) * "
        "regr_syy(fwd_return_#d, mean_sentiment) / regr_sxx(fwd_return_#d, mean_sentiment) / "
        "(count(*) - 2)) AS std_error, count(*) AS n_samples")
_WEIGHTED = "corr(weighted_sentiment, fwd_return_#d) AS pearson_r, count(*) AS n_samples"
_SUMMARY_PARTS = ",\n".join([
    finance.CORRELATED, with_p("correlated", "pearson_r"),
    "cw AS (" + finance.per_horizon(_WEIGHTED, "cases") + ")", with_p("cw", "pearson_r", "pw"),
    finance.RANKED, "cs AS (" + finance.per_horizon(
        "corr(x, y#) AS spearman_rho, count(*) AS n_samples", "ranked") + ")",
    with_p("cs", "spearman_rho", "ps"),
    "co AS (" + finance.per_horizon(_OLS, "cases") + ")", with_p("co", "r", "po"),
    finance.EVENTS, "re AS (SELECT *, bullish_fwd_1d - bearish_fwd_1d AS spread_1d, "
    "bullish_fwd_3d - bearish_fwd_3d AS spread_3d FROM res)", DIRECTION_SCORES,
    "jt AS (SELECT count(*) AS joint_observations, count(DISTINCT ticker) + "
    "(count(*) > count(ticker))::INT AS tickers FROM joint)"])
_SUMMARY_ROWS = " UNION ALL ".join([
        _measured("pearson", "withp", "pearson_r n_samples p_value", "horizon"),
        _measured("pearson_weighted", "pw", "pearson_r n_samples p_value", "horizon"),
        _measured("spearman", "ps", "spearman_rho n_samples p_value", "horizon"),
        _measured("ols", "po", "beta_1 intercept r_squared std_error n_samples p_value", "horizon"),
        _measured("events", "re", "bullish_count bullish_fwd_1d bullish_fwd_3d bearish_count "
                  "bearish_fwd_1d bearish_fwd_3d spread_1d spread_3d"),
        _measured("direction", "dm", "accuracy auc_roc f1_score train_size test_size", "model"),
        _measured("total", "jt", "joint_observations tickers")])


@query("analysis_summary", ctes("cases", extra=_SUMMARY_PARTS) + _SUMMARY_ROWS)
def analysis_summary(spark, sf):
    return rounded(flows.market_summary(I.joint(spark, sf)))


@query("e2e_finance", ctes("posts", "bars", extra=",\n".join([
    TRADED, I.CTES["cases"][1], _SUMMARY_PARTS])) + _SUMMARY_ROWS)
def e2e_finance(spark, sf):
    """Posts and bars to the statistics, their report and the experiment log, read back from it."""
    p = I.posts(spark, sf).withColumn("source", F.lit("orders"))
    joint = flows.market_signals(p, I.bars(spark, sf), earliest=dt.date(1990, 1, 1))
    log = flows.market_run(joint, new_path(spark, "finance"), "F-run")
    return rounded(log.select("analysis", "name", "value"))


@query("lexicon_label_counts", ctes("clean_posts", extra=LEXSQL) + "SELECT label, count(*) AS n, "
       "round(avg(compound), 6) AS mean_compound FROM (SELECT *, CASE WHEN compound > 0.05 THEN "
       "'BULLISH' WHEN compound < -0.05 THEN 'BEARISH' ELSE 'NEUTRAL' END AS label FROM lex) "
       "GROUP BY 1")
def lexicon_label_counts(spark, sf):
    s = lexicon.lexicon_score(I.clean_posts(spark, sf))
    return rounded(s.groupBy(threshold_label(F.col("compound"), 0.05).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("compound").alias("mean_compound")))


# Documents as posts of the order with their number; the study period follows from them.
LEX_POSTS = ",\n".join([LEXSQL, """posts AS (
  SELECT o_orderkey AS post_id, o_orderdate + to_hours(o_orderkey % 24) AS timestamp,
    o_orderpriority AS ticker, compound AS sentiment_score,
    floor(o_totalprice / 1000)::BIGINT - 50 AS score, o_custkey % 50 AS num_comments
  FROM lex JOIN orders ON post_id = o_orderkey),
period AS (SELECT (min(timestamp) - INTERVAL 5 DAY)::DATE AS start_date,
  (max(timestamp) + INTERVAL 15 DAY)::DATE AS end_date FROM posts)""",
    I.CTES["bars"][1].replace("bars AS (", "all_bars AS (", 1),
    "bars AS (SELECT all_bars.* FROM all_bars, period WHERE date >= start_date "
    "AND date < end_date)", TRADED])


@query("e2e_lexicon_market", ctes("clean_posts", "calendar", extra=LEX_POSTS) +
       "SELECT ticker, trading_date, post_count, " +
       r("mean_sentiment weighted_sentiment fwd_return_1d fwd_return_5d") + " FROM joint")
def e2e_lexicon_market(spark, sf):
    """Posts without scores: lexicon, trading days, daily signals, returns."""
    about = I.posts(spark, sf).drop("sentiment_label", "sentiment_score")
    p = I.clean_posts(spark, sf).select("post_id", "text").join(about, "post_id").withColumn(
        "source", F.lit("orders"))
    out = flows.market_signals(p, I.bars(spark, sf), earliest=dt.date(1990, 1, 1))
    return rounded(out.select("ticker", "trading_date", "post_count", "mean_sentiment",
                              "weighted_sentiment", "fwd_return_1d", "fwd_return_5d"))


@query("e2e_preprocess_split", ctes("clean_posts", extra="""kept AS (
  SELECT post_id, text FROM clean_posts WHERE length(text) >= 15
  QUALIFY row_number() OVER (PARTITION BY text ORDER BY post_id) = 1),
placed AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || post_id)) - 1 AS place, count(*) OVER ()
  AS n, count(*) OVER () * 7 // 10 AS n_train FROM kept)""") +
       f"SELECT post_id, length(text)::INT AS char_length, {_LEN}::INT AS word_count, CASE WHEN "
       "place < n_train THEN 'train' WHEN place < n_train + (n - n_train) // 2 THEN 'val' ELSE 'test' "
       "END AS split FROM placed")
def e2e_preprocess_split(spark, sf):
    """Raw posts cleaned, deduplicated, tagged, split, written and read back."""
    out = flows.preprocess_and_split(I.text_posts(spark, sf).drop("raw"))
    path = new_path(spark, "splits")
    sinks.write_splits(out, path)
    return spark.read.parquet(path).select("post_id", "char_length", "word_count", "split")


@query("e2e_errors", ORACLE["error_breakdown"])
def e2e_errors(spark, sf):
    """Predictions and posts to the error report."""
    return flows.error_report(text._text_predictions(spark, sf), I.clean_posts(spark, sf))


@query("e2e_weak_student")
def e2e_weak_student(spark, sf):
    """Prompts, keys, stored answers, votes, filter, student, threshold, metrics.

    The stored answers come from the lexicon, never from the label: its verdict on the first six
    paths, neutral on the others.
    """
    train, val, test = _parts(spark, sf)
    posts = train.withColumn("ticker", F.lit(None).cast("string"))
    requests = stage(flows.inference_requests(
        posts, text._examples(spark, sf), "teacher", "0.7"), "requests")
    answer = F.to_json(F.struct(
        F.lit("the words of the post").alias("reasoning_summary"),
        F.when(F.col("path_id") <= 6, F.col("dominant_label")).otherwise("neutral")
        .alias("sentiment")))
    cache = requests.join(
        _teacher(train).select("post_id", "dominant_label"), "post_id").groupBy(
        "prompt_key").agg(F.min(answer).alias("response"))
    return flows.weak_label_run(requests, cache, train, val, test)


@query("e2e_benchmark")
def e2e_benchmark(spark, sf):
    train, _, test = _parts(spark, sf)
    votes = K.vote(_label_paths(test), with_reasoning=False).select("post_id", "dominant_label")
    return flows.benchmark(train, test, votes)
