"""Reading posts: schemas, column mapping, provenance, the cross-dataset benchmark protocol."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_SCHEMA = T.StructType([
    T.StructField("post_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("num_comments", T.LongType()),
    T.StructField("source", T.StringType()),
])
PATH_SCHEMA = T.StructType([
    T.StructField("post_id", T.StringType()),
    T.StructField("path_id", T.IntegerType()),
    T.StructField("reasoning_summary", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("display_label", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
])

# Source columns for each standard column, first match wins; and the defaults.
SOURCE_COLUMNS = {
    "post_id": ["id", "name"],
    "timestamp": ["created_utc", "created", "timestamp"],
    "subreddit": ["subreddit"],
    "title": ["title"],
    "body": ["selftext", "body", "text"],
    "score": ["score", "ups"],
    "num_comments": ["num_comments"],
}
DEFAULTS = {"subreddit": "wallstreetbets", "title": "", "body": "", "score": 0, "num_comments": 0}
MULTI_TARGET = "[,;/]"


class SyntheticDataError(RuntimeError):
    """A research step was given synthetic rows."""


def to_utc(c: Column, kind: T.DataType) -> Column:
    """Epoch seconds, text or timestamp to a timestamp; what cannot be read is null."""
    if isinstance(kind, T.NumericType):
        return F.timestamp_micros((c.cast("double") * 1_000_000).cast("bigint"))
    if isinstance(kind, T.StringType):
        return F.try_to_timestamp(c)
    return c.cast("timestamp")


def standardise(df: DataFrame, source: str) -> DataFrame:
    """Map any of the known source columns onto the standard ones and fill in what is missing.

    Without an id column rows get `post_<n>`; n is unique but not consecutive, because numbering
    rows consecutively would need all of them in one place.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    picked = {
        target: next((c for c in names if c in kinds), None)
        for target, names in SOURCE_COLUMNS.items()
    }
    out = {}
    for target, column in picked.items():
        kind = RAW_SCHEMA[target].dataType
        if target == "timestamp":
            out[target] = (
                to_utc(F.col(column), kinds[column]) if column
                else F.lit(None).cast("timestamp")
            )
        elif column:
            out[target] = F.col(column).cast(kind)
        elif target == "post_id":
            out[target] = F.concat(
                F.lit("post_"), F.monotonically_increasing_id().cast("string"))
        else:
            out[target] = F.lit(DEFAULTS[target]).cast(kind)
    return df.select(
        *[out[f.name].alias(f.name) for f in RAW_SCHEMA.fields if f.name in out],
        F.lit(source).alias("source"), F.lit("REAL").alias("data_source"),
    )


def provenance(source: Column) -> Column:
    """SYNTHETIC where the source says so, in any case; judged row by row."""
    named = F.contains(F.lower(F.coalesce(source.cast("string"), F.lit("unknown"))),
                       F.lit("synthetic"))
    return F.when(named, "SYNTHETIC").otherwise("REAL")


def tag_provenance(df: DataFrame) -> DataFrame:
    if "data_source" in df.columns:
        return df
    source = F.col("source") if "source" in df.columns else F.lit("unknown")
    return df.withColumn("data_source", provenance(source))


def _is_synthetic(df: DataFrame) -> Column:
    bad = F.lit(False)
    if "data_source" in df.columns:
        bad = bad | (F.col("data_source") == "SYNTHETIC")
    if "source" in df.columns:
        bad = bad | (provenance(F.col("source")) == "SYNTHETIC")
    return bad


def provenance_audit(df: DataFrame) -> DataFrame:
    """(data_source, source, rows, synthetic) of a tagged table."""
    return df.groupBy("data_source", "source").agg(
        F.count(F.lit(1)).alias("rows"), F.bool_or(_is_synthetic(df)).alias("synthetic")
    )


def assert_real(df: DataFrame) -> DataFrame:
    """Raise on the first synthetic row found; stops reading there."""
    if df.filter(_is_synthetic(df)).limit(1).count():
        raise SyntheticDataError("the table holds synthetic rows")
    return df


def read_posts(
    spark: SparkSession, path: str, allow_synthetic: bool = False,
    schema: T.StructType | None = RAW_SCHEMA,
) -> DataFrame:
    """Posts from Parquet, tagged; synthetic rows are refused unless allowed."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = tag_provenance(reader.parquet(path))
    return df if allow_synthetic else assert_real(df)


def fiqa_protocol(df: DataFrame, subtask: str | None = None) -> DataFrame:
    """Benchmark rows of one subtask: non-zero score, one target, binary label from the sign."""
    if "sentence" in df.columns:
        df = df.withColumnRenamed("sentence", "text")
    formats = {"news": "headline", "headline": "headline", "headlines": "headline",
               "post": "post", "posts": "post", "microblog": "post"}
    wanted = formats.get((subtask or "").strip().lower())
    if wanted and "format" in df.columns:
        df = df.filter(F.col("format") == wanted)
    name = next((c for c in ("score", "sentiment_score") if c in df.columns), None)
    if name:
        score = F.col(name)
        df = df.filter(score != 0)  # a missing score drops out as well
        if "target" in df.columns:
            df = df.filter(~F.coalesce(F.col("target"), F.lit("")).rlike(MULTI_TARGET))
        df = df.withColumn(
            "sentiment_label", F.when(score > 0, "BULLISH").otherwise("BEARISH")
        ).withColumn("continuous_score", score)
    return df.withColumn("data_source", F.lit("REAL"))


def label_carry(df: DataFrame, hidden: str = "_sentiment") -> DataFrame:
    """The label column; else the hidden one; else null.  And its score."""
    from sentivane.functions.labels import label_to_score

    if "sentiment_label" not in df.columns:
        label = F.col(hidden) if hidden in df.columns else F.lit(None).cast("string")
        df = df.withColumn("sentiment_label", label)
    return df.withColumn("sentiment_score", label_to_score(F.col("sentiment_label")))


def first_existing(spark: SparkSession, paths: Sequence[str], view: str) -> DataFrame | None:
    """Register the first readable Parquet path as a view; null if there is none."""
    for path in paths:
        try:
            df = spark.read.parquet(path)
        except AnalysisException:
            continue
        df.createOrReplaceTempView(view)
        return df
    return None
