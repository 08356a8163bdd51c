"""Global order without a global sort in one task: sampled splitters with partition offsets.

Rows are range partitioned (Spark samples the splitters, so partitions are even whatever the values are,
as long as `order` ends in something that tells equal values apart) and sorted inside their partition.
A row's place in its partition plus the sizes of the partitions before it is its rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from seqloom.session import stored

#: Bits of monotonically_increasing_id that number the rows of a partition.
ROW_BITS = 33


def ordered(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """`df` stored in ranges of `order`, with `_range` (their number, in order) and `_at` (0-based place in it)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    dealt = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_place", place))
    at = F.col("_place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return dealt.withColumns({"_range": F.shiftright("_place", ROW_BITS), "_at": at}).drop("_place")


def range_offsets(placed: DataFrame) -> DataFrame:
    """_range and _before: the rows of all ranges before it. One row for each partition."""
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))


def global_ranks(df: DataFrame, order: list[str], rank: str = "rank", partitions: int | None = None) -> DataFrame:
    """`df` with the 0-based rank of each row in `order` over the whole table."""
    placed = ordered(df, order, partitions)
    # As many rows as there are partitions: small enough to go to every task.
    return placed.join(F.broadcast(range_offsets(placed)), "_range").withColumn(rank, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def running_sums(df: DataFrame, order: list[str], value: str, name: str = "before", partitions: int | None = None) -> DataFrame:
    """`df` with the sum of `value` over all rows before each in `order`: prefix sums inside each range, then over
    the totals of the ranges."""
    placed = ordered(df, order, partitions)
    totals = placed.groupBy("_range").agg(F.sum(value).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_at", "_before", "_inside")
