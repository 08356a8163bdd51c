"""Accuracy of predicted property vectors over a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seqloom.fixed import EXACT_LABEL_TOL, MECHANICAL_SLOTS, SD_SLOTS
from seqloom.functions.vectors import all_within, average, differences, r2_within
from seqloom.operators.curation import long_vector, property_name
from seqloom.operators.ranking import percentiles


def r2_across(y, p, where: Column | None = None) -> Column:
    """Regression R2 as an aggregate; a constant truth scores 1 when matched everywhere, else 0.
    Not the squared correlation that SQL calls regr_r2."""
    y, p = F.col(y) if isinstance(y, str) else y, F.col(p) if isinstance(p, str) else p
    if where is not None:
        y, p = F.when(where, y), F.when(where, p)
    residual = F.sum((y - p) * (y - p))
    spread = F.var_pop(y) * F.count(y)
    return F.when(spread == 0, F.when(residual == 0, 1.0).otherwise(0.0)).otherwise(
        1.0 - residual / F.nullif(spread, F.lit(0.0))
    )


def pearson(x, y) -> Column:
    """Correlation as an aggregate; NULL where either side is constant."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def property_accuracy(df: DataFrame, target: str = "target", predicted: str = "prediction") -> DataFrame:
    """Per property over rows with a prediction: R2, Pearson r, MAE, sample SD of both sides."""
    long = long_vector(df.where(F.col(predicted).isNotNull()), [], y=target, p=predicted)
    return (
        long.groupBy("slot")
        .agg(
            F.count("*").alias("n"),
            r2_across("y", "p").alias("r2"),
            pearson("y", "p").alias("pearson_r"),
            F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"),
            F.stddev_samp("y").alias("target_sd"),
            F.stddev_samp("p").alias("pred_sd"),
        )
        .withColumn("property", property_name("slot"))
    )


def slot_kind(slot) -> Column:
    slot = F.col(slot) if isinstance(slot, str) else slot
    return F.when(slot.isin(MECHANICAL_SLOTS), "mechanical").when(slot.isin(SD_SLOTS), "sd")


def accuracy_by_kind(df: DataFrame, target: str = "target", predicted: str = "prediction") -> DataFrame:
    """Mean R2 over the mechanical and over the SD slots."""
    scores = property_accuracy(df, target, predicted)
    return scores.groupBy(slot_kind("slot").alias("kind")).agg(F.avg("r2").alias("mean_r2"))


def within_vector_summary(df: DataFrame, target: str = "target", predicted: str = "prediction") -> DataFrame:
    """Mean, median, max and positive share of the per-row R2."""
    scored = df.where(F.col(predicted).isNotNull()).select(r2_within(target, predicted).alias("r2"))
    plain = scored.agg(
        F.count("*").alias("n"),
        F.avg("r2").alias("mean_r2"),
        F.max("r2").alias("max_r2"),
        F.avg((F.col("r2") > 0).cast("double")).alias("frac_positive"),
    )
    return plain.crossJoin(F.broadcast(percentiles(scored, [], "r2", {"median_r2": 0.5})))


def with_exact_label(df: DataFrame, target: str, predicted: str, tolerance: float = EXACT_LABEL_TOL) -> DataFrame:
    return df.withColumn("exact", all_within(target, predicted, tolerance))


def memorisation_summary(
    df: DataFrame, target: str = "target", predicted: str = "prediction", seq: str = "sequence",
    tolerance: float = EXACT_LABEL_TOL,
) -> DataFrame:
    """One row: how many labels are reproduced exactly, and errors and lengths on both sides."""
    flagged = with_exact_label(df.where(F.col(predicted).isNotNull()), target, predicted, tolerance).select(
        "exact",
        F.length(seq).alias("length"),
        average(F.transform(differences(target, predicted), F.abs)).alias("error"),
    )
    exact = F.col("exact")
    summary = flagged.agg(
        F.count("*").alias("n_rows"),
        F.count_if(exact).alias("n_exact"),
        F.avg(exact.cast("double")).alias("exact_fraction"),
        F.avg(F.when(exact, F.col("error"))).alias("mean_abs_error_exact"),
        F.avg(F.when(~exact, F.col("error"))).alias("mean_abs_error_other"),
    )
    medians = percentiles(flagged, ["exact"], "length", {"m": 0.5}).agg(
        F.max(F.when(exact, F.col("m"))).alias("median_length_exact"),
        F.max(F.when(~exact, F.col("m"))).alias("median_length_other"),
    )
    return summary.crossJoin(F.broadcast(medians))


def memorisation_by_property(
    df: DataFrame, target: str = "target", predicted: str = "prediction", tolerance: float = EXACT_LABEL_TOL,
    min_rows: int = 10,
) -> DataFrame:
    """Per property: R2 over all rows, and over rows not reproduced exactly (NULL for too few)."""
    flagged = with_exact_label(df.where(F.col(predicted).isNotNull()), target, predicted, tolerance)
    rest = ~F.col("exact")
    return (
        long_vector(flagged, ["exact"], y=target, p=predicted)
        .groupBy("slot")
        .agg(
            r2_across("y", "p").alias("r2_all_rows"),
            r2_across("y", "p", rest).alias("_r2_rest"),
            F.count_if(rest).alias("n_rest"),
        )
        .select(
            property_name("slot").alias("property"), "r2_all_rows",
            F.when(F.col("n_rest") > min_rows, F.col("_r2_rest")).alias("r2_non_memorised_rows"), "n_rest",
        )
    )
