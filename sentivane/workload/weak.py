"""Queries: label paths, votes, ablations, classifier evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentivane.functions import labels as L
from sentivane.operators.models import teacher_guard as teacher_column
from sentivane.operators import metrics as M
from sentivane.operators import weak as K
from sentivane.vocab import PATH_GRID, RETENTION_GRID, THETA_GRID
from sentivane.workload import inputs as I
from sentivane.workload.inputs import ctes
from sentivane.workload.registry import query, r, rounded

VOTE_COLS = ("post_id, positive_count, neutral_count, negative_count, total_paths, "
             "dominant_label, dominant_count, is_tie, agreement_score, teacher_soft_score")
CLASSES = ["BULLISH", "NEUTRAL", "BEARISH"]


def metrics_sql(by: str, source: str, columns: str, digits: int = 4) -> str:
    """SQL twin of the metrics over rows (by..., truth, pred) of `source`."""
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    per = ", ".join(
        f"count(*) FILTER (truth = '{c}' AND pred = '{c}')::DOUBLE AS tp_{c}, "
        f"count(*) FILTER (pred = '{c}')::DOUBLE AS p_{c}, "
        f"count(*) FILTER (truth = '{c}')::DOUBLE AS t_{c}" for c in CLASSES)
    scores = ", ".join(
        f"coalesce(tp_{c} / nullif(p_{c}, 0), 0) AS pr_{c}, "
        f"coalesce(tp_{c} / nullif(t_{c}, 0), 0) AS re_{c}, "
        f"coalesce(2 * tp_{c} / nullif(p_{c} + t_{c}, 0), 0) AS f1_{c}" for c in CLASSES)

    def macro(x):
        return "(" + " + ".join(f"{x}_{c}" for c in CLASSES) + ") / 3"

    def weighted(x):
        return ("(" + " + ".join(f"{x}_{c} * t_{c}" for c in CLASSES) + ") / ("
                + " + ".join(f"t_{c}" for c in CLASSES) + ")")

    out = {
        "accuracy": "hits / total", "macro_f1": macro("f1"), "weighted_f1": weighted("f1"),
        "macro_precision": macro("pr"), "weighted_precision": weighted("pr"),
        "macro_recall": macro("re"), "weighted_recall": weighted("re"),
        "precision": macro("pr"), "recall": macro("re"), "balanced_accuracy": "balanced",
    }
    for c in CLASSES:
        low = c.lower()
        out |= {f"{low}_precision": f"pr_{c}", f"{low}_recall": f"re_{c}", f"{low}_f1": f"f1_{c}"}
    cols = []
    for name in columns.split():
        if name in out:
            cols.append(f"round({out[name]}, {digits}) AS {name}")
        elif name.endswith("_support"):
            cols.append(f"t_{name.split('_')[0].upper()}::BIGINT AS {name}")
        elif name in ("total_samples", "samples"):
            cols.append(f"total AS {name}")
        else:
            cols.append(name)
    join = (f"JOIN bal USING ({by})" if by else "CROSS JOIN bal")
    return (f"SELECT {', '.join(cols)} FROM (SELECT *, {scores} FROM (SELECT {lead}count(*) AS "
            f"total, count(*) FILTER (truth = pred) AS hits, {per} FROM {source} {group}) "
            f"{join})").replace(
        "FROM (SELECT *, ", f"FROM (WITH bal AS (SELECT {lead}avg(re) AS balanced FROM (SELECT "
        f"{lead}avg((truth = pred)::INT) AS re FROM {source} GROUP BY {lead}truth) {group}) "
        "SELECT *, ", 1)


ALL_METRICS = ("accuracy balanced_accuracy macro_f1 weighted_f1 macro_precision "
               "weighted_precision macro_recall weighted_recall "
               + " ".join(f"{c.lower()}_{m}" for c in CLASSES
                          for m in ("precision", "recall", "f1", "support")) + " total_samples")


@query("paths_fanout", ctes("posts") + "SELECT post_id, ticker, unnest(generate_series(1, 8))::INT "
       "AS path_id FROM posts")
def paths_fanout(spark, sf):
    return K.fan_out(I.posts(spark, sf).select("post_id", "ticker"), 8)


@query("majority_vote", ctes("votes") + f"SELECT {VOTE_COLS} FROM votes")
def majority_vote(spark, sf):
    return K.vote(I.paths(spark, sf), with_reasoning=False)


_CONF = {"positive": "pos_conf", "neutral": "neu_conf", "negative": "neg_conf"}
_TOP = "greatest(" + ", ".join(
    f"CASE WHEN {n}_count = dominant_count THEN {c} END" for n, c in _CONF.items()) + ")"


@query("tie_break", ctes("votes") + "SELECT post_id, is_tie, dominant_label AS neutral_default, "
       "CASE " + " ".join(f"WHEN {n}_count = dominant_count AND {c} = {_TOP} THEN '{n}'"
                          for n, c in _CONF.items()) + " END AS highest_confidence, "
       "first_label AS first FROM votes")
def tie_break(spark, sf):
    """All three tie rules beside each other."""
    return K.tie_rules(I.paths(spark, sf))


@query("teacher_guard", ctes("votes") + "SELECT post_id, dominant_label AS target FROM votes")
def teacher_guard(spark, sf):
    """The column a student may learn from, taken from the weak labels."""
    weak = K.vote(I.paths(spark, sf), with_reasoning=False)
    return weak.select("post_id", F.col(teacher_column(weak, "classification")).alias("target"))


@query("reasoning_sample", ctes("paths") + "SELECT post_id, coalesce(arg_min(trim("
       "reasoning_summary), path_id) FILTER (length(trim(reasoning_summary)) > 10), '') "
       "AS reasoning_sample FROM paths GROUP BY 1")
def reasoning_sample(spark, sf):
    return K.vote(I.paths(spark, sf)).select("post_id", "reasoning_sample")


@query("weak_labels_posts", ctes("votes", "posts") + "SELECT v.post_id::VARCHAR AS post_id, "
       "dominant_label, dominant_count, agreement_score, teacher_soft_score, ticker, "
       "sentiment_label, num_comments FROM votes v LEFT JOIN posts p ON v.post_id = p.post_id")
def weak_labels_posts(spark, sf):
    return K.with_posts(K.vote(I.paths(spark, sf), with_reasoning=False),
                        I.posts(spark, sf)).select(
        "post_id", "dominant_label", "dominant_count", "agreement_score", "teacher_soft_score",
        "ticker", "sentiment_label", "num_comments")


@query("consistency_filter", ctes("votes") +
       f"SELECT {VOTE_COLS} FROM votes WHERE dominant_count >= 5")
def consistency_filter(spark, sf):
    return K.keep_consistent(K.vote(I.paths(spark, sf), with_reasoning=False), 5)


def _grid(values) -> str:
    return "(VALUES " + ", ".join(f"({v})" for v in values) + ")"


_SHARES = ", ".join(
    f"round(coalesce(count(*) FILTER (dominant_label = '{c}') / nullif(count(v.post_id), 0), 0), 6)"
    f" AS {c}_share" for c in ("positive", "neutral", "negative"))


@query("retention_stats", ctes("votes") + "SELECT m::INT AS threshold, m || '/8' AS rule, "
       "(SELECT count(*) FROM votes) AS initial_count, count(v.post_id) AS retained_count, "
       "round(count(v.post_id) / (SELECT count(*) FROM votes), 4) AS retention_ratio, "
       "round(count(v.post_id) * 100 / (SELECT count(*) FROM votes), 2) AS retention_pct, "
       f"round(coalesce(avg(agreement_score), 0), 4) AS mean_agreement, {_SHARES} FROM {_grid([5])}"
       " g(m) LEFT JOIN votes v ON v.dominant_count >= m GROUP BY m")
def retention_stats(spark, sf):
    return rounded(K.retention_stats(K.vote(I.paths(spark, sf), with_reasoning=False)))


@query("retention_ablation", ctes("votes") + "SELECT m::INT AS threshold, count(v.post_id) AS "
       "retained_count, round(count(v.post_id) * 100 / (SELECT count(*) FROM votes), 2) AS "
       "retention_pct, round(coalesce(avg(agreement_score), 0), 4) AS mean_agreement FROM "
       f"{_grid(RETENTION_GRID)} g(m) LEFT JOIN votes v ON v.dominant_count >= m GROUP BY m")
def retention_ablation(spark, sf):
    return K.retention_ablation(K.vote(I.paths(spark, sf), with_reasoning=False))


@query("path_prefix", ctes("paths") + "SELECT post_id, path_id, label FROM paths "
       "WHERE path_id <= 3")
def path_prefix(spark, sf):
    return I.paths(spark, sf).filter(F.col("path_id") <= 3).select("post_id", "path_id", "label")


K_VOTES = f"""kcounts AS (SELECT k AS num_paths, post_id,
  count(*) FILTER (label = 'positive') AS p, count(*) FILTER (label = 'neutral') AS u,
  count(*) FILTER (label = 'negative') AS n
  FROM paths JOIN {_grid(PATH_GRID)} g(k) ON path_id <= k GROUP BY 1, 2),
kvotes AS (SELECT num_paths, t.sentiment_label AS truth,
  CASE WHEN (p = m)::INT + (u = m)::INT + (n = m)::INT > 1 THEN 'NEUTRAL'
    WHEN p = m THEN 'BULLISH' WHEN u = m THEN 'NEUTRAL' ELSE 'BEARISH' END AS pred,
  round(m / (p + u + n), 4) AS agreement
  FROM (SELECT *, greatest(p, u, n) AS m FROM kcounts) v JOIN posts t USING (post_id))"""


@query("k_ablation", ctes("paths", "posts", extra=K_VOTES) + "SELECT * FROM (" +
       metrics_sql("num_paths", "kvotes", "num_paths accuracy macro_f1 weighted_f1") +
       ") JOIN (SELECT num_paths, round(avg(agreement), 6) AS mean_agreement FROM kvotes "
       "GROUP BY 1) USING (num_paths)")
def k_ablation(spark, sf):
    return K.path_ablation(I.paths(spark, sf), I.truth(spark, sf))


ORDER_ROWS = """seeded AS (SELECT CASE model WHEN 'model_0' THEN 42 WHEN 'model_1' THEN 101
  ELSE 2024 END AS shuffle_seed, truth, pred FROM predictions)"""


def _seeded(spark, sf):
    m = F.col("model")
    seed = F.when(m == "model_0", 42).when(m == "model_1", 101).otherwise(2024)
    return I.predictions(spark, sf).select(seed.alias("shuffle_seed"), "truth", "pred")


@query("order_ablation", ctes("predictions", extra=ORDER_ROWS) +
       metrics_sql("shuffle_seed", "seeded", "shuffle_seed accuracy macro_f1"))
def order_ablation(spark, sf):
    return K.order_ablation(_seeded(spark, sf))


@query("order_ablation_summary", ctes("predictions", extra=ORDER_ROWS) +
       "SELECT count(*) AS seeds, round(avg(a), 6) AS mean_accuracy, "
       "round(stddev_samp(a), 6) AS std_accuracy FROM (SELECT round(avg((truth = pred)::INT), 4) "
       "AS a FROM seeded GROUP BY shuffle_seed)")
def order_ablation_summary(spark, sf):
    return rounded(K.order_ablation_summary(K.order_ablation(_seeded(spark, sf))))


# ------------------------------------------------------------------ labels
@query("label_to_score", ctes("posts") + "SELECT sentiment_label, CASE sentiment_label WHEN "
       "'BULLISH' THEN 1.0 WHEN 'BEARISH' THEN -1.0 WHEN 'NEUTRAL' THEN 0.0 END::DOUBLE AS score, "
       "count(*) AS n FROM posts GROUP BY 1, 2")
def label_to_score(spark, sf):
    return I.posts(spark, sf).groupBy(
        "sentiment_label", L.label_to_score(F.col("sentiment_label")).alias("score")
    ).agg(F.count(F.lit(1)).alias("n"))


_RAW_WORD = {"A": " Bullish ", "N": "HOLD", "R": "downside"}


@query("normalise_label", "SELECT l_orderkey, l_linenumber, l_partkey, word, CASE WHEN "
       "l_linestatus = 'O' AND word = 'HOLD' THEN NULL ELSE CASE word WHEN ' Bullish ' THEN "
       "'positive' WHEN 'HOLD' THEN 'neutral' ELSE 'negative' END END AS label FROM (SELECT *, "
       "CASE l_returnflag WHEN 'A' THEN ' Bullish ' WHEN 'N' THEN 'HOLD' ELSE 'downside' END AS "
       "word FROM lineitem)")
def normalise_label(spark, sf):
    flag = F.col("l_returnflag")
    li = I.table(spark, sf, "lineitem").withColumn(
        "word", F.when(flag == "A", " Bullish ").when(flag == "N", "HOLD").otherwise("downside"))
    raw = F.when((F.col("l_linestatus") == "O") & (F.col("word") == "HOLD"), "laser_eyes"
                 ).otherwise(F.col("word"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "word",
                     L.normalise_label(raw).alias("label"))


@query("display_label", ctes("paths") + "SELECT post_id, path_id, CASE label WHEN 'positive' THEN "
       "'BULLISH' WHEN 'neutral' THEN 'NEUTRAL' ELSE 'BEARISH' END AS display_label FROM paths")
def display_label(spark, sf):
    return I.paths(spark, sf).select(
        "post_id", "path_id", L.display_label(F.col("label")).alias("display_label"))


@query("label_id", ctes("posts", "paths") + "SELECT path_id, post_id, CASE label WHEN 'positive' "
       "THEN 2 WHEN 'neutral' THEN 1 ELSE 0 END AS id FROM paths UNION ALL SELECT 0, post_id, "
       "CASE sentiment_label WHEN 'BULLISH' THEN 2 WHEN 'BEARISH' THEN 0 ELSE 1 END FROM posts")
def label_id(spark, sf):
    a = I.paths(spark, sf).select("path_id", "post_id", F.col("label"))
    b = I.posts(spark, sf).select(F.lit(0).alias("path_id"), "post_id",
                                  F.col("sentiment_label").alias("label"))
    return a.unionByName(b).select("path_id", "post_id", L.label_id(F.col("label")).alias("id"))


@query("threshold_label", ctes("votes") + "SELECT post_id, teacher_soft_score, CASE WHEN "
       "teacher_soft_score > 0.2 THEN 'BULLISH' WHEN teacher_soft_score < -0.2 THEN 'BEARISH' "
       "ELSE 'NEUTRAL' END AS label FROM votes")
def threshold_label(spark, sf):
    return K.vote(I.paths(spark, sf), with_reasoning=False).select(
        "post_id", "teacher_soft_score",
        L.threshold_label(F.col("teacher_soft_score"), 0.2).alias("label"))


@query("forced_binary", ctes("votes") + "SELECT post_id, CASE WHEN positive_count >= "
       "negative_count THEN 'BULLISH' ELSE 'BEARISH' END AS label FROM votes")
def forced_binary(spark, sf):
    v = K.vote(I.paths(spark, sf), with_reasoning=False)
    total = F.col("total_paths")
    return v.select("post_id", L.forced_binary(
        F.col("positive_count") / total, F.col("negative_count") / total).alias("label"))


@query("collapse_neutral", ctes("predictions") + "SELECT model, CASE WHEN pred = 'BULLISH' THEN "
       "pred ELSE 'BEARISH' END AS label, count(*) AS n FROM predictions GROUP BY 1, 2")
def collapse_neutral(spark, sf):
    return I.predictions(spark, sf).groupBy(
        "model", L.collapse_neutral(F.col("pred")).alias("label")
    ).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ evaluation
_GRID9 = ("(VALUES ('BULLISH'), ('NEUTRAL'), ('BEARISH')) a(truth), "
          "(VALUES ('BULLISH'), ('NEUTRAL'), ('BEARISH')) b(pred)")


@query("confusion_matrix", ctes("predictions") + "SELECT model, truth, pred, count(p.c) AS n, "
       "round(count(p.c) / sum(count(p.c)) OVER (PARTITION BY model, truth), 6) AS share FROM "
       f"(SELECT * FROM (SELECT DISTINCT model FROM predictions), {_GRID9}) LEFT JOIN "
       "(SELECT *, 1 AS c FROM predictions) p USING (model, truth, pred) GROUP BY model, truth, pred")
def confusion_matrix(spark, sf):
    counts = M.prediction_counts(I.predictions(spark, sf), ["model"])
    return rounded(M.confusion_matrix(counts, normalise=True, by=["model"]))


@query("classification_metrics", ctes("predictions") +
       metrics_sql("model", "predictions", "model " + ALL_METRICS))
def classification_metrics(spark, sf):
    return M.classification_metrics(I.predictions(spark, sf), ["model"])


@query("metrics_overall", ctes("predictions") + metrics_sql("", "predictions", ALL_METRICS))
def metrics_overall(spark, sf):
    return M.classification_metrics(I.predictions(spark, sf))


@query("leaderboard", ctes("predictions") + metrics_sql(
    "model", "predictions", "model accuracy macro_f1 weighted_f1 precision recall") +
    " ORDER BY macro_f1 DESC, model")
def leaderboard(spark, sf):
    return M.leaderboard(I.predictions(spark, sf))


@query("best_model", ctes("predictions") + "SELECT model, macro_f1 FROM (" + metrics_sql(
    "model", "predictions", "model macro_f1") + ") ORDER BY macro_f1 DESC, model LIMIT 1")
def best_model(spark, sf):
    return M.best_model(M.leaderboard(I.predictions(spark, sf)))


_EDGES = ", ".join(f"{repr(e)}::DOUBLE" for e in M.bin_edges(10))
_INDEX = " + ".join(f"(confidence >= {e!r}::DOUBLE)::INT" for e in M.bin_edges(10))
BINS = f"""binned AS (SELECT model, {_INDEX} - 1 AS bin, confidence,
  (truth = pred)::INT AS correct FROM predictions),
totals AS (SELECT model, count(*) AS total FROM binned GROUP BY 1),
bins AS (SELECT t.model, i::INT AS bin, count(b.bin) AS size, coalesce(avg(correct), 0) AS accuracy,
  coalesce(avg(confidence), ([{_EDGES}][i + 1] + [{_EDGES}][i + 2]) / 2) AS confidence,
  any_value(total) AS total
  FROM (SELECT * FROM totals, generate_series(0, 9) g(i)) t
  LEFT JOIN binned b ON b.bin = i AND b.model = t.model GROUP BY t.model, i)"""


def _calibration(spark, sf):
    return M.calibration_bins(I.predictions(spark, sf).select(
        "model", "confidence", (F.col("truth") == F.col("pred")).cast("int").alias("correct")),
        by=["model"])


@query("calibration", ctes("predictions", extra=BINS) + "SELECT model, bin, size, total, "
       + r("accuracy confidence") + " FROM bins")
def calibration(spark, sf):
    return rounded(_calibration(spark, sf))


@query("calibration_error", ctes("predictions", extra=BINS) + "SELECT model, round(sum(CASE WHEN "
       "size > 0 THEN abs(accuracy - confidence) * size / total ELSE 0 END), 6) AS ece, "
       "round(max(CASE WHEN size > 0 THEN abs(accuracy - confidence) ELSE 0 END), 6) AS mce, "
       "max(total) AS total_samples FROM bins GROUP BY 1")
def calibration_error(spark, sf):
    return rounded(M.calibration_error(_calibration(spark, sf), ["model"]))


THETA = f"""scored AS (SELECT theta, sentiment_label AS truth, CASE WHEN teacher_soft_score > theta
  THEN 'BULLISH' WHEN teacher_soft_score < -theta THEN 'BEARISH' ELSE 'NEUTRAL' END AS pred
  FROM votes JOIN posts USING (post_id), {_grid([f'{t!r}::DOUBLE' for t in THETA_GRID])} g(theta))"""


def _theta(spark, sf):
    weak = K.vote(I.paths(spark, sf), with_reasoning=False)
    rows = weak.join(I.truth(spark, sf), "post_id").select(
        "truth", F.col("teacher_soft_score").alias("score"))
    return M.theta_scores(rows)


@query("theta_scores", ctes("votes", "posts", extra=THETA) +
       metrics_sql("theta", "scored", "theta macro_f1"))
def theta_scores(spark, sf):
    return _theta(spark, sf)


@query("theta_tuning", ctes("votes", "posts", extra=THETA) + "SELECT theta, macro_f1 FROM (" +
       metrics_sql("theta", "scored", "theta macro_f1") + ") ORDER BY macro_f1 DESC, theta LIMIT 1")
def theta_tuning(spark, sf):
    return M.best_theta(_theta(spark, sf))


@query("regression_errors", ctes("votes", "posts") + "SELECT round(avg((s - t) ^ 2), 6) AS mse, "
       "round(avg(abs(s - t)), 6) AS mae, round(avg(s), 6) AS mean_predicted, "
       "round(stddev_pop(s), 6) AS std_predicted, round(stddev_samp(t), 6) AS std_target, "
       "count(*) AS n FROM (SELECT teacher_soft_score AS s, sentiment_score AS t FROM votes JOIN "
       "posts USING (post_id))")
def regression_errors(spark, sf):
    weak = K.vote(I.paths(spark, sf), with_reasoning=False)
    rows = weak.join(I.posts(spark, sf), "post_id").select(
        F.col("teacher_soft_score").alias("pred"), F.col("sentiment_score").alias("target"))
    return rounded(M.regression_errors(rows))


AUC = """b AS (SELECT model, (truth = 'BULLISH')::INT AS y, round(confidence, 2) AS s
  FROM predictions),
k AS (SELECT model, y, s, rank() OVER (PARTITION BY model ORDER BY s)
  + (count(*) OVER (PARTITION BY model, s) - 1) / 2.0 AS rk FROM b),
c AS (SELECT model, count(*) AS n, sum(y) AS pos, count(*) FILTER (s > 0.5 AND y = 1) AS tp,
  count(*) FILTER (s > 0.5 AND y = 0) AS fp, count(*) FILTER ((s > 0.5)::INT = y) AS hits,
  sum(rk) FILTER (y = 1) AS ranks FROM k GROUP BY 1)"""


@query("binary_metrics", ctes("predictions", extra=AUC) + "SELECT model, round(hits / n, 6) AS "
       "accuracy, round((ranks - pos * (pos + 1) / 2) / (pos * (n - pos)), 6) AS auc_roc, "
       "round(2 * tp / (tp + fp + pos), 6) AS f1_score, n FROM c")
def binary_metrics(spark, sf):
    rows = I.predictions(spark, sf).select(
        "model", (F.col("truth") == "BULLISH").cast("int").alias("truth"),
        F.round("confidence", 2).alias("score"))
    return rounded(M.binary_metrics(rows, by=["model"]))
