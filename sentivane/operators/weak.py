"""Label paths to weak labels: fan-out, cached answers, votes, filters and the path ablations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentivane.functions import prompts as P
from sentivane.functions.labels import canonical
from sentivane.operators.metrics import metrics_from_counts, prediction_counts
from sentivane.session import new_path, small_table
from sentivane.vocab import PATH_GRID, PATH_LABELS, RETENTION_GRID, TOKEN_RATES

TIE_RULES = ("neutral_default", "highest_confidence", "first")


def fan_out(posts: DataFrame, paths: int = 8) -> DataFrame:
    """Each row once per path id 1..paths."""
    return posts.withColumn("path_id", F.explode(F.sequence(F.lit(1), F.lit(paths))))


def render_prompts(
    posts: DataFrame, examples: DataFrame, spec: P.PromptSpec = P.PromptSpec(),
    with_reasoning: bool = True, shuffle_seed: int | None = None, paths: int | None = None,
    text: str = "text", ticker: str = "ticker",
) -> DataFrame:
    """Prompt per post (and per path): the input table of a batch inference run."""
    demos = P.demonstrations(examples, with_reasoning, shuffle_seed).scalar()
    out = posts.withColumn(
        "prompt",
        P.fill_template(spec, demos, F.coalesce(F.col(ticker), F.lit("stock")), F.col(text)),
    )
    if paths:
        out = fan_out(out, paths).withColumn(
            "prompt", P.path_prompt(F.col("prompt"), F.col("path_id"), paths)
        )
    return out


def parse_responses(df: DataFrame, response: str = "response") -> DataFrame:
    """Replaces the response column by status, label, display_label, reasoning_summary and
    confidence.  The generator evaluates the parser once per row, whatever reads the columns."""
    others = [c for c in df.columns if c != response]
    return df.select(*others, F.inline(F.array(P.parse_response(F.col(response)))))


def store_responses(responses: DataFrame, key: str = "prompt_key",
                    buckets: int | None = None) -> DataFrame:
    """Responses written as a table in buckets of their key (as many as shuffles have tasks), one
    sorted file each, so that no later join with it moves or sorts them again.

    The files lie in the shared folder; the table's name is known to this session's catalog.
    """
    spark = responses.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, "responses")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    (responses.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(name))
    return spark.table(name)


def answered(requests: DataFrame, cache: DataFrame, key: str = "prompt_key") -> DataFrame:
    """Requests with the cached response and `pending`: no response is stored for their key.

    A stored response may be null: its request isn't pending.
    """
    stored = cache.select(key, "response", F.lit(True).alias("_stored"))
    return requests.join(stored, key, "left").withColumn(
        "pending", F.col("_stored").isNull()).drop("_stored")


def pending(requests: DataFrame, cache: DataFrame, key: str = "prompt_key") -> DataFrame:
    """Requests whose key has no stored response."""
    return requests.join(cache.select(key), key, "left_anti")


def usage_cost(usage: DataFrame) -> DataFrame:
    """USD per provider from its token counts; unknown providers keep null rates."""
    spark = usage.sparkSession
    rates = small_table(
        spark,
        TOKEN_RATES, "provider string, prompt_rate double, completion_rate double"
    )
    per = usage.groupBy("provider").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
    )
    cost = (F.col("prompt_tokens") * F.col("prompt_rate")
            + F.col("completion_tokens") * F.col("completion_rate"))
    # five fixed rows
    return per.join(F.broadcast(rates), "provider", "left").select(
        "provider", "prompt_tokens", "completion_tokens", cost.alias("cost_usd")
    )


def _mean_confidences() -> list[Column]:
    return [F.avg(F.when(F.col("label") == name, F.col("confidence"))).alias(f"_{name}")
            for name in PATH_LABELS]


def _tied(counts: dict[str, Column], top: Column) -> Column:
    """How many labels share the highest count."""
    return sum(((c == top).cast("int") for c in counts.values()), F.lit(0))


def _dominant(rule: str, counts: dict[str, Column], top: Column, tied: Column) -> Column:
    """The winning label under a tie rule; equal confidences go to the first label."""
    if rule == "highest_confidence":
        values = {
            name: F.when(counts[name] == top, F.coalesce(F.col(f"_{name}"), F.lit(0.0)))
            for name in PATH_LABELS
        }
        best = F.greatest(*values.values())
    else:
        values, best = counts, top
    winner = F.lit(None).cast("string")
    for name in reversed(PATH_LABELS):
        winner = F.when(values[name] == best, name).otherwise(winner)
    return F.when(tied > 1, "neutral").otherwise(winner) if rule == "neutral_default" else winner


def tie_rules(paths: DataFrame, keys: Sequence[str] = ("post_id",)) -> DataFrame:
    """Per post the tie flag and the winner under every tie rule, from one aggregate."""
    g = paths.groupBy(*keys).agg(
        *[F.count_if(F.col("label") == name).alias(f"{name}_count") for name in PATH_LABELS],
        *_mean_confidences())
    counts = {name: F.col(f"{name}_count") for name in PATH_LABELS}
    top = F.greatest(*counts.values())
    tied = _tied(counts, top)
    return g.select(*keys, (tied > 1).alias("is_tie"), *[
        _dominant(rule, counts, top, tied).alias(rule) for rule in TIE_RULES])


def vote(
    paths: DataFrame, tie_rule: str = "neutral_default", keys: Sequence[str] = ("post_id",),
    with_reasoning: bool = True,
) -> DataFrame:
    """Majority vote per post with counts, tie flag, agreement and soft score.

    Plain conditional aggregates: they fold on the map side, so the number of paths of a post
    does not matter.
    """
    if tie_rule not in TIE_RULES:
        raise ValueError(f"tie_rule must be one of {TIE_RULES}")
    keys = list(keys)
    label = F.col("label")
    aggs = [F.count_if(label == name).alias(f"{name}_count") for name in PATH_LABELS]
    aggs.append(F.count(F.lit(1)).alias("total_paths"))
    if tie_rule == "highest_confidence":
        aggs += _mean_confidences()
    if with_reasoning and "reasoning_summary" in paths.columns:
        reason = F.trim("reasoning_summary")
        order = F.when(F.length(reason) > 10, F.col("path_id"))
        aggs.append(F.min_by(reason, order).alias("_reason"))
    g = paths.groupBy(*keys).agg(*aggs)

    counts = {name: F.col(f"{name}_count") for name in PATH_LABELS}
    top = F.greatest(*counts.values())
    tied = _tied(counts, top)
    dominant = _dominant(tie_rule, counts, top, tied)
    total = F.col("total_paths")
    out = [
        *keys, *counts.values(), total,
        dominant.alias("dominant_label"), top.alias("dominant_count"),
        (tied > 1).alias("is_tie"),
        F.round(top / total, 4).alias("agreement_score"),
        F.round((counts["positive"] - counts["negative"]) / total, 4)
        .alias("teacher_soft_score"),
    ]
    if "_reason" in g.columns:
        out.append(F.coalesce("_reason", F.lit("")).alias("reasoning_sample"))
    return g.select(*out)


def with_posts(weak: DataFrame, posts: DataFrame) -> DataFrame:
    """Weak labels with the posts' own columns; ids are compared as text."""
    left = weak.withColumn("post_id", F.col("post_id").cast("string"))
    right = posts.withColumn("post_id", F.col("post_id").cast("string"))
    return left.join(right, "post_id", "left")


def keep_consistent(weak: DataFrame, threshold: int = 5) -> DataFrame:
    return weak.filter(F.col("dominant_count") >= threshold)


def retention_stats(weak: DataFrame, thresholds: Sequence[int] = (5,), total: int = 8):
    """Per threshold: rows before and after, share kept, mean agreement, class shares of the kept.

    Weak labels fold to one row per (dominant_count, label) first; the thresholds then meet that
    small table.
    """
    spark = weak.sparkSession
    folded = weak.groupBy("dominant_count", "dominant_label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("agreement_score").alias("agreement")
    )
    grid = small_table(spark, [(int(m),) for m in thresholds], "threshold int")
    initial = folded.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    joined = F.broadcast(grid).join(
        folded, F.col("dominant_count") >= F.col("threshold"), "left"
    )
    kept = F.coalesce(F.sum("n"), F.lit(0))
    g = joined.groupBy("threshold").agg(
        kept.alias("retained_count"),
        F.sum("agreement").alias("agreement"),
        *[F.sum(F.when(F.col("dominant_label") == c, F.col("n"))).alias(f"_{c}")
          for c in PATH_LABELS],
    ).withColumn("initial_count", initial)
    ratio = F.coalesce(F.try_divide("retained_count", "initial_count"), F.lit(0.0))
    return g.select(
        "threshold",
        F.concat(F.col("threshold").cast("string"), F.lit(f"/{total}")).alias("rule"),
        "initial_count", "retained_count",
        F.round(ratio, 4).alias("retention_ratio"),
        F.round(ratio * 100, 2).alias("retention_pct"),
        F.round(F.coalesce(F.try_divide("agreement", "retained_count"), F.lit(0.0)), 4)
        .alias("mean_agreement"),
        *[F.coalesce(F.try_divide(f"_{c}", "retained_count"), F.lit(0.0)).alias(f"{c}_share")
          for c in PATH_LABELS],
    )


def path_ablation(paths: DataFrame, truth: DataFrame, grid: Sequence[int] = PATH_GRID):
    """Vote and score with the first k paths, for each k of the grid.

    The grid is folded into one pass: per post the counts among the first k paths are conditional
    aggregates, so a path row is read once and never multiplied.
    """
    label, pid = F.col("label"), F.col("path_id")
    g = paths.groupBy("post_id").agg(*[
        F.count_if((label == name) & (pid <= k)).alias(f"{name}_{k}")
        for k in grid for name in PATH_LABELS
    ])
    known = g.join(truth.select("post_id", "truth"), "post_id")
    per_k = F.inline(F.array(*[
        F.struct(F.lit(int(k)).alias("num_paths"),
                 *[F.col(f"{name}_{k}").alias(f"{name}_count") for name in PATH_LABELS])
        for k in grid
    ]))
    # most posts share a few combinations of counts: the votes are worked out on those
    votes = known.select("truth", per_k).groupBy(
        "truth", "num_paths", *[f"{name}_count" for name in PATH_LABELS]
    ).agg(F.count(F.lit(1)).alias("posts"))
    counts = {name: F.col(f"{name}_count") for name in PATH_LABELS}
    total = sum(counts.values(), F.lit(0))
    top = F.greatest(*counts.values())
    tied = sum(((c == top).cast("int") for c in counts.values()), F.lit(0))
    first = F.when(counts["positive"] == top, "positive").when(
        counts["neutral"] == top, "neutral").otherwise("negative")
    scored = votes.filter(total > 0).select(
        "num_paths", canonical(F.col("truth")).alias("truth"),
        canonical(F.when(tied > 1, "neutral").otherwise(first)).alias("pred"),
        "posts", (F.round(top / total, 4) * F.col("posts")).alias("agreement"),
    )
    counted = scored.groupBy("num_paths", "truth", "pred").agg(
        F.sum("posts").alias("n"), F.sum("agreement").alias("agreement"))
    return metrics_from_counts(counted, ["num_paths"], means=["agreement"]).select(
        "num_paths", "accuracy", "macro_f1", "weighted_f1", "mean_agreement")


def retention_ablation(weak: DataFrame, thresholds: Sequence[int] = RETENTION_GRID):
    return retention_stats(weak, thresholds).select(
        "threshold", "retained_count", "retention_pct", "mean_agreement"
    )


def order_ablation(scored: DataFrame) -> DataFrame:
    """(seed, truth, pred) rows to accuracy and macro F1 per seed."""
    return metrics_from_counts(
        prediction_counts(scored, ["shuffle_seed"]), ["shuffle_seed"]
    ).select("shuffle_seed", "accuracy", "macro_f1")


def order_ablation_summary(per_seed: DataFrame) -> DataFrame:
    return per_seed.agg(
        F.count(F.lit(1)).alias("seeds"),
        F.avg("accuracy").alias("mean_accuracy"),
        F.stddev_samp("accuracy").alias("std_accuracy"),
    )
