"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once per row.

    Catalyst inlines a column expression wherever it is mentioned and shares it only where it is
    sure to be needed; a lambda over a one-element array binds it, also inside `when` branches.
    """
    return F.get(F.transform(F.array(value), body), 0)
