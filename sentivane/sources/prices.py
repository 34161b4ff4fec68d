"""Reading daily price bars."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shape_bars(df: DataFrame, sort: bool = False) -> DataFrame:
    """Lower-case names with underscores and a plain date."""
    df = df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])
    df = df.withColumn("date", F.to_date("date"))
    return df.orderBy("ticker", "date") if sort else df


def read_bars(
    spark: SparkSession, path: str, tickers: Sequence[str] = (),
    start: dt.date | None = None, end: dt.date | None = None, fmt: str = "parquet",
) -> DataFrame:
    """Bars of the given tickers and dates (start inclusive, end exclusive).

    Both conditions reach the scan; a table partitioned by ticker reads only its folders.
    """
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    df = shape_bars(reader.format(fmt).load(path))
    if tickers:
        df = df.filter(F.col("ticker").isin(list(tickers)))
    if start:
        df = df.filter(F.col("date") >= F.lit(start))
    if end:
        df = df.filter(F.col("date") < F.lit(end))
    return df


def write_bars(bars: DataFrame, path: str) -> None:
    """One folder per ticker, days in order inside each file."""
    (bars.repartition("ticker", F.year("date")).sortWithinPartitions("ticker", "date")
     .write.mode("overwrite").partitionBy("ticker").parquet(path))
