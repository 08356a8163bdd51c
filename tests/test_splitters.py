"""Ranks by sampled splitters: exact, and even where values are packed closely or repeat."""

import random

from pyspark.sql import functions as F

from seqloom.operators.splitters import global_ranks, ordered


def test_ranks_equal_a_sort(spark):
    draw = random.Random(1)
    rows = [(i, draw.choice([0.5, draw.random(), None])) for i in range(3000)]
    out = global_ranks(spark.createDataFrame(rows, "id bigint, v double").repartition(7), ["v", "id"], partitions=9).collect()
    wanted = {i: k for k, (i, v) in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])))}
    assert {r["id"]: r["rank"] for r in out} == wanted


def test_partitions_are_even_for_packed_and_equal_values(spark):
    packed = spark.range(100_000).select("id", (1 + F.col("id") * 1e-10).alias("v"))
    for df in (packed, packed.withColumn("v", F.lit(4.0))):
        sizes = [r["count"] for r in ordered(df, ["v", "id"], partitions=8).groupBy("_range").count().collect()]
        assert len(sizes) == 8 and max(sizes) < 2.5 * min(sizes)


def test_nothing_to_rank(spark):
    assert global_ranks(spark.createDataFrame([], "id bigint, v double"), ["v", "id"]).collect() == []
