"""Scores between two arrays of doubles. The target always comes first."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from seqloom.functions.hashing import let


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def average(values: Column) -> Column:
    return let(values, lambda v: total(v) / F.nullif(F.size(v), F.lit(0)))


def differences(a, b) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x - y)


def spread(target) -> Column:
    """Sum of squared deviations from the vector's own mean."""

    def squares(t: Column) -> Column:
        return let(average(t), lambda m: total(F.transform(t, lambda x: (x - m) * (x - m))))

    return let(_col(target), squares)


def r2_within(target, predicted) -> Column:
    """R2 over the entries of one vector; a constant target scores 1 when matched, else 0.
    Arrays of different sizes fail the job."""

    def score(v: Column) -> Column:
        residual = total(F.transform(differences(v["t"], v["p"]), lambda d: d * d))
        sums = F.struct(residual.alias("res"), spread(v["t"]).alias("tot"))
        value = let(
            sums,
            lambda s: F.when(s["tot"] == 0, F.when(s["res"] == 0, 1.0).otherwise(0.0)).otherwise(
                1.0 - s["res"] / F.nullif(s["tot"], F.lit(0.0))
            ),
        )
        return (
            F.when(v["t"].isNull() | v["p"].isNull(), F.lit(None).cast("double"))
            .when(F.size(v["t"]) == F.size(v["p"]), value)
            .otherwise(F.raise_error(F.lit("shape mismatch between target and prediction")))
        )

    return let(F.struct(_col(target).alias("t"), _col(predicted).alias("p")), score)


def mae(target, predicted) -> Column:
    return average(F.transform(differences(target, predicted), F.abs))


def rmse(target, predicted) -> Column:
    return F.sqrt(average(F.transform(differences(target, predicted), lambda d: d * d)))


def max_abs_error(a, b) -> Column:
    return F.array_max(F.transform(differences(a, b), F.abs))


def all_within(a, b, tolerance: float) -> Column:
    """Every entry strictly closer than `tolerance`; a missing entry is not."""
    return F.forall(F.zip_with(_col(a), _col(b), lambda x, y: F.abs(x - y)), lambda e: F.coalesce(e < tolerance, F.lit(False)))


def is_finite(value) -> Column:
    """A usable number: neither NULL nor infinite nor NaN, which orders above infinity."""
    return F.coalesce(F.abs(_col(value)) < float("inf"), F.lit(False))


def rescale(value: Column, low: Column, high: Column) -> Column:
    """Min-max scaling; a zero range divides by 1."""
    return (value - low) / F.when(high == low, 1.0).otherwise(high - low)


def unscale(value: Column, low: Column, high: Column) -> Column:
    return value * (high - low) + low
