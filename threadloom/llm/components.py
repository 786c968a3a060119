"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each node's greater neighbours go to the least of it and its neighbours. Small: its lesser ones and itself do."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
    seen = both if large else both.where("u < v")
    least = seen.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
    joined = seen.join(least, "v")
    if large:
        linked = joined.where("u > v").select(F.col("u").alias("a"), F.col("m").alias("b"))
    else:
        linked = joined.select(F.col("u").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("v").alias("a"), F.col("m").alias("b")))
    return linked.where("a <> b").distinct()


def connected(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root): every node that ``edges`` (a, b: longs) names, with the least node of its component.

    Each round is written to the shared folder; only the count and a checksum of its edges come to the driver. A round
    never raises the sum of the edges' ends, and leaves it only when all are stars, so rounds end; their number grows
    with the logarithm of the longest chain.
    """
    now = shared.materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), folder, "edges-0")
    was = None
    for k in itertools.count(1):
        state = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if not state["n"] or state == was:
            break
        was = state
        now = shared.materialize(_star(_star(now, large=True), large=False), folder, f"edges-{k}")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
