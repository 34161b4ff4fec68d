"""Blocks and margins of the linear models."""

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sentivane.operators import linear, models


def test_blocks_end_at_rows_and_entries():
    assert linear._block_bounds(np.array([], int)) == []
    assert linear._block_bounds(np.full(1030, 1)) == [(0, 512), (512, 1024), (1024, 1030)]
    big = linear.BLOCK_ENTRIES
    assert linear._block_bounds(np.array([big, 1, big + 5, 0, big, 2])) == [
        (0, 1), (1, 2), (2, 3), (3, 5), (5, 6)]


def test_margins_in_slices_are_the_products(spark, monkeypatch):
    monkeypatch.setattr(linear, "BLOCK_ENTRIES", 3)
    weights = np.arange(15.0).reshape(5, 3)
    vectors = [{0: 1.0, 3: 2.0}, {}, {1: 1.0, 2: 1.0, 3: 1.0}, {}, {2: 4.0}, {0: 1.0, 1: 5.0}]
    df = spark.createDataFrame(
        [(i, Vectors.sparse(4, v)) for i, v in enumerate(vectors)], ["i", "features"]).coalesce(1)
    got = {r["i"]: r["m"] for r in df.select(
        "i", models.sparse_margins(weights, F.col("features")).alias("m")).collect()}
    for i, v in enumerate(vectors):
        assert got[i] == list(weights[-1] + sum((x * weights[t] for t, x in v.items()), np.zeros(3)))
