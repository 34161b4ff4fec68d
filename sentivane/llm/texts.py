"""Small helpers for operators that read whole texts in Arrow batches."""

from __future__ import annotations

from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows in an Arrow batch: what a Python worker holds at once stays small beside long texts.
BATCH_ROWS = 500
# Distinct words a worker remembers before it starts anew.
CACHE_WORDS = 400_000
WHITE = b" \t\n\v\f\r"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for a while; afterwards it is as it was."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def by_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """`df.mapInArrow` with small batches; `fn` takes and returns an iterator of record batches."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def raw(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8 bytes; null as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def narrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) with fixed names, whatever else the table holds."""
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))


def words(text: bytes) -> list[bytes]:
    """Runs of anything but blank, tab, line feed, vertical tab, form feed, carriage return."""
    return text.split()


class Memo(dict):
    """A dict that fills itself and starts anew when it holds too many keys."""

    def __init__(self, make, limit: int = CACHE_WORDS):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value
