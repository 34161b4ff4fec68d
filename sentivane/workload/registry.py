"""Query name -> Spark callable and, where there is one, the SQL twin."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(fn):
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = fn
        if sql:
            ORACLE[key] = sql
        return fn

    return register


def rounded(df, digits: int = 6):
    """Doubles rounded: sums run in another order on every engine."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    return df.select(*[
        F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
        else F.col(f.name) for f in df.schema.fields
    ])


def r(names: str, digits: int = 6, prefix: str = "") -> str:
    """SQL: rounded columns by name."""
    return ", ".join(f"round({prefix}{n}, {digits}) AS {n}" for n in names.split())
