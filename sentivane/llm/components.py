"""Connected components of an edge table with DataFrame operations only.

Rounds of large-star and small-star: every node tells its larger neighbours, then its smaller ones,
the least node it knows.  The number of rounds grows with the logarithm of the component size, also
for long chains.  A node with very many edges costs nothing special: the least neighbour is a grouped
minimum (combined before the shuffle), and handing it back is an equi-join whose large side adaptive
execution may split.  Each round is a written table, so lost executors recompute one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentivane.session import stage


def _least(edges: DataFrame, node: str, other: str) -> DataFrame:
    return edges.groupBy(F.col(node).alias("u")).agg(F.min(other).alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """edges (a > b): links every larger neighbour of a node to the least node it knows."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both, "a", "b").select("u", F.least("u", "m").alias("m"))
    # pairs (u, v) with v > u: u is the smaller end of an edge
    return (
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least, "u")
        .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    )


def small_star(edges: DataFrame) -> DataFrame:
    """edges (a > b): links a node and its smaller neighbours to the least of them."""
    least = _least(edges, "a", "b")
    linked = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).join(least, "u")
    return (
        linked.select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")
        .union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable, for every node that has an edge.

    Loops and edges with a null end are ignored.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    now = stage(pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
                .distinct(), "edges")
    mark = None
    while True:
        # stars only: no centre is a leaf. The two sums change with every change of the edge set.
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
                       .alias("s")).first()
        if (seen["n"], seen["s"]) == mark or not seen["n"]:
            break
        mark = seen["n"], seen["s"]
        now = stage(small_star(large_star(now)), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
