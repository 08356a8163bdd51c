"""Connected components by alternating stars.

Each round links every node to the smallest node around it (large star: from its larger neighbours, small
star: from its smaller ones) until the edges are stars. Rounds grow with the logarithm of the size of a
component; each is a grouped minimum, combined before its shuffle, and a join. Edges are written to the
shared folder every round, so a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqloom.llm.common import stored

MOST_ROUNDS = 60


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")


def small_star(edges: DataFrame) -> DataFrame:
    """`edges` point from the larger to the smaller node."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return moved.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of the edges (u, v); loops and repeats do no harm."""
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    state = None
    for _ in range(MOST_ROUNDS):
        now = stored(small_star(large_star(now)))
        # Sums of hashes tell whether the set of edges is still changing.
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select("v", "v").distinct())
        state = seen
    raise RuntimeError("components did not settle")
