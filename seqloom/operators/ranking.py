"""Exact ranks, cumulative counts and percentiles that never sort a whole group in one task.

Equal values are collapsed to one counted row first, so a value held by a third of a group costs one row.
The distinct values of all groups are range partitioned together by sampled splitters (`splitters`): prefix
sums inside each range and over the ranges' totals give every value its place, however close the values lie.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqloom.functions.hashing import draw_hex
from seqloom.operators.splitters import running_sums

HEX_PREFIX = 4


def _attach(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be NULL."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, condition).drop(*[f"_r_{k}" for k in keys])


def cumulative_counts(df: DataFrame, groups: list[str], value: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per group and distinct value: (groups, value, n, upto, total), `upto` counting the
    rows at or below the value. NULLs and NaNs are left out. `extra` adds aggregates per value."""
    extra = extra or {}
    v = F.col(value)
    usable = df.where(v.isNotNull() & ~F.isnan(v.cast("double")))
    distinct = usable.groupBy(*groups, v.cast("double").alias(value)).agg(
        F.count("*").alias("n"), *[c.alias(name) for name, c in extra.items()]
    )
    placed = running_sums(distinct, [*groups, value], "n", "_so_far")
    # A group starts where the rows of the groups before it end.
    whole = placed.groupBy(*groups) if groups else placed.groupBy()
    starts = whole.agg(F.min("_so_far").alias("_start"), F.sum("n").alias("total"))
    upto = F.col("_so_far") + F.col("n") - F.col("_start")
    joined = _attach(placed, starts, groups) if groups else placed.crossJoin(starts)
    return joined.select(*groups, value, "n", *extra, upto.alias("upto"), "total")


def percentiles(df: DataFrame, groups: list[str], value: str, named: dict[str, float]) -> DataFrame:
    """Linear-interpolated percentiles: one row per group, one column per entry of `named`."""
    counts = cumulative_counts(df, groups, value)
    aggregates = []
    for name, q in named.items():
        # 0-based position; the value at 0-based rank r is the smallest one with upto > r.
        position = (F.col("total") - 1) * F.lit(float(q))
        lower, upper = F.floor(position), F.ceil(position)
        at = F.min(F.when(F.col("upto") > lower, F.col(value)))
        above = F.min(F.when(F.col("upto") > upper, F.col(value)))
        part = F.max(position - lower)
        aggregates.append((at + (above - at) * part).alias(name))
    if groups:
        return counts.groupBy(*groups).agg(*aggregates)
    return counts.agg(*aggregates)


def spread_ranks(df: DataFrame, row_id: str, *seed, rank: str = "rank", groups: list[str] | None = None) -> DataFrame:
    """0-based position of every row in a uniform random order, over all rows or within groups,
    without one task seeing a whole group."""
    groups = groups or []
    keyed = df.withColumn("_h", draw_hex(*seed, F.col(row_id)))
    keyed = keyed.withColumn("_prefix", F.substring("_h", 1, HEX_PREFIX))
    sizes = keyed.groupBy(*groups, "_prefix").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*(groups or [F.lit(1)])).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*groups, "_prefix", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy(*groups, "_prefix").orderBy("_h", row_id)
    return (
        keyed.join(offsets, [*groups, "_prefix"])
        .withColumn(rank, F.col("_before") + F.row_number().over(local) - 1)
        .drop("_h", "_prefix", "_before")
    )


def sample_per_group(df: DataFrame, groups: list[str], row_id: str, n: int, *seed) -> DataFrame:
    """At most n rows per group, uniform and without replacement. The rank filter is pushed below
    the shuffle, so a hot group sends n rows per task."""
    drawn = Window.partitionBy(*groups).orderBy("_h", row_id)
    return (
        df.withColumn("_h", draw_hex(*seed, F.col(row_id)))
        .withColumn("_rank", F.row_number().over(drawn))
        .where(F.col("_rank") <= n)
        .drop("_h", "_rank")
    )


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows per group in the given order, with their 1-based rank."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.where(F.col(rank) <= n)
