"""Connected components by alternating large and small stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import table


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Large star: link every larger neighbour of u to the least of u and its neighbours.
    Small star: the same for u and its smaller neighbours."""
    both = edges if small else edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    joined = both.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    else:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the least node.

    `edges` has long columns u and v. Each round is cut off by a written table; rounds grow
    with the logarithm of the longest path."""
    now = table(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        now = table(_stars(_stars(now, False), True), "stars")
        new = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.count_if(F.lit(False))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v"), F.col("v")).distinct())
