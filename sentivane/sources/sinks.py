"""Writers for splits, label tables, reports and the experiment log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentivane.session import small_table

_CLASS = "struct<precision:double,recall:double,f1:double,support:bigint>"
METRIC_SCHEMA = (
    "accuracy double, balanced_accuracy double, macro_f1 double, weighted_f1 double, "
    f"per_class struct<BULLISH:{_CLASS},NEUTRAL:{_CLASS},BEARISH:{_CLASS}>"
)


def write_splits(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One table, one folder per split: a reader of one split opens only its files."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Each row of a (nested) record table as one JSON object."""
    df.write.mode(mode).json(path)


def nest_metrics(metrics: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Flat metric columns to the nested record with `per_class`."""
    def one(c: str):
        return F.struct(*[
            F.col(f"{c}_{f}").alias(f) for f in ("precision", "recall", "f1", "support")
        ])

    return metrics.select(
        *keep, "accuracy", "balanced_accuracy", "macro_f1", "weighted_f1", "macro_precision",
        "weighted_precision", "macro_recall", "weighted_recall",
        F.struct(one("bullish").alias("BULLISH"), one("neutral").alias("NEUTRAL"),
                 one("bearish").alias("BEARISH")).alias("per_class"),
        "total_samples",
    )


def benchmark_table(
    spark: SparkSession, folder: str, files: Sequence[tuple[str, str, str]]
) -> DataFrame:
    """All metric files of a folder as one flat table.

    `files` lists (model, file, phase); files it does not name are left out.

    Files hold one JSON object each (or are folders written by `write_report`).
    """
    raw = spark.read.schema(METRIC_SCHEMA).option("multiLine", True).option(
        "recursiveFileLookup", True).json(folder)
    names = small_table(spark, list(files), "model string, file string, phase string")
    path = F.input_file_name()
    tagged = raw.select(
        "*", F.regexp_extract(path, r"([^/]+\.json)(?:/[^/]*)?$", 1).alias("file"))
    zero = F.lit(0.0)
    per = F.col("per_class")
    return tagged.join(F.broadcast(names), "file").select(  # one row per listed file
        "phase", "model",
        F.coalesce("accuracy", zero).alias("accuracy"),
        F.coalesce("balanced_accuracy", zero).alias("balanced_acc"),
        F.coalesce("macro_f1", zero).alias("macro_f1"),
        F.coalesce("weighted_f1", zero).alias("weighted_f1"),
        F.coalesce(per["BULLISH"]["f1"], zero).alias("bullish_f1"),
        F.coalesce(per["BEARISH"]["f1"], zero).alias("bearish_f1"),
        F.coalesce(per["NEUTRAL"]["f1"], zero).alias("neutral_f1"),
    )


def union_log(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both, union of their columns, null where a column is new."""
    return old.unionByName(new, allowMissingColumns=True)


# Folder name of one experiment; the prefix keeps it a string when it is read.
_RUN = "run"


def append_log(rows: DataFrame, path: str) -> None:
    """Add experiments to a log whose columns may grow; read it back with `read_log`.

    Each experiment id has its own folder, which a run replaces as a whole when it commits: running
    an experiment again, or a job again after a failure, leaves one copy of its rows.
    """
    run = F.concat(F.lit("id-"), F.coalesce(F.sha1(F.col("experiment_id").cast("string").cast("binary")),
                                            F.lit("none")))
    rows.withColumn(_RUN, run).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(_RUN).parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path).drop(_RUN)
