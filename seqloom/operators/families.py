"""Predictions by family: sampling, spread between and within families, accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqloom.fixed import MECHANICAL, MECHANICAL_SLOTS, SEED
from seqloom.operators.curation import long_vector
from seqloom.operators.ranking import sample_per_group
from seqloom.operators.scoring import r2_across


def family_sample(
    df: DataFrame, row_id: str, per_family: int = 60, min_rows: int = 10, min_length: int = 80, max_length: int = 768,
    seed: int = SEED, family: str = "family_group", seq: str = "sequence",
) -> DataFrame:
    """Up to `per_family` rows of every named family that has enough rows of usable length."""
    usable = df.where(F.length(seq).between(min_length, max_length) & (F.col(family) != "other"))
    big_enough = usable.groupBy(family).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_rows).select(family)
    return sample_per_group(usable.join(big_enough, family, "left_semi"), [family], row_id, per_family, F.lit(seed))


def family_profile(df: DataFrame, predicted: str = "prediction", family: str = "family_group") -> DataFrame:
    """Per family: size, mean prediction of the mechanical slots, and the mean over slots of the
    population SD within the family, for the mechanical slots and for all eight."""
    slots = long_vector(df.where(F.col(predicted).isNotNull()), [family], p=predicted).groupBy(family, "slot").agg(
        F.count("*").alias("n"), F.avg("p").alias("mean"), F.stddev_pop("p").alias("sd")
    )
    mechanical = F.col("slot").isin(MECHANICAL_SLOTS)
    return slots.groupBy(family).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("slot") == s, F.col("mean"))).alias(f"mean_{p}") for s, p in zip(MECHANICAL_SLOTS, MECHANICAL)],
        F.avg(F.when(mechanical, F.col("sd"))).alias("within_family_sd"),
        F.avg("sd").alias("within_family_sd_all8"),
    )


def family_spread(profile: DataFrame) -> DataFrame:
    """Between-family SD of the mean predictions, mean within-family SD, and their ratio."""
    between = sum((F.stddev_pop(f"mean_{p}") for p in MECHANICAL[1:]), F.stddev_pop(f"mean_{MECHANICAL[0]}"))
    spread = profile.agg(
        (between / len(MECHANICAL)).alias("between_family_sd"), F.avg("within_family_sd").alias("within_family_sd")
    )
    return spread.withColumn(
        "ratio",
        F.when(F.col("within_family_sd") > 0, F.col("between_family_sd") / F.nullif(F.col("within_family_sd"), F.lit(0.0)))
        .otherwise(F.lit(float("inf"))),
    )


def family_accuracy(
    df: DataFrame, target: str = "target", predicted: str = "prediction", family: str = "family_group",
) -> DataFrame:
    """Per family: mean R2 over the mechanical slots and over all, and the mean absolute error."""
    slots = (
        long_vector(df.where(F.col(predicted).isNotNull()), [family], y=target, p=predicted)
        .groupBy(family, "slot")
        .agg(
            F.count("*").alias("n"), r2_across("y", "p").alias("r2"),
            F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"),
        )
    )
    return slots.groupBy(family).agg(
        F.max("n").alias("n"),
        F.avg(F.when(F.col("slot").isin(MECHANICAL_SLOTS), F.col("r2"))).alias("mean_r2_mechanical"),
        F.avg("r2").alias("mean_r2_all8"),
        F.avg("mae").alias("mean_abs_error"),
    ).orderBy(F.desc("mean_r2_mechanical"), family)
