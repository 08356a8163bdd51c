"""Scores within one vector and across a dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.catalog.base import Entry
from seqloom.catalog.bindings import predicted_pairs, remembered_pairs, vectors
from seqloom.catalog.oracle import (
    PREDICTED, REMEMBERED, VECTORS, across, mae, pearson, r2, rmse, slot_name, slots, spread, with_,
)
from seqloom.functions import vectors as vec
from seqloom.operators import scoring
from seqloom.operators.curation import long_vector


def within_vector_scores(spark, folder):
    return vectors(spark, folder).select(
        "vec_id", vec.r2_within("target", "prediction").alias("r2"), vec.spread("target").alias("target_spread"),
        vec.mae("target", "prediction").alias("mae"), vec.rmse("target", "prediction").alias("rmse"),
        vec.max_abs_error("target", "prediction").alias("max_abs_error"),
    )


def degenerate_scores(spark, folder):
    """A constant target, matched by itself and missed by the prediction."""
    constant = F.array_repeat(F.lit(0.5), 8)
    return vectors(spark, folder).select(
        "vec_id", vec.r2_within(constant, constant).alias("matched"), vec.r2_within(constant, "prediction").alias("missed")
    )


def property_accuracy(spark, folder):
    return scoring.property_accuracy(predicted_pairs(spark, folder)).drop("slot")


def label_accuracy(spark, folder):
    return scoring.property_accuracy(vectors(spark, folder)).drop("slot")


def accuracy_by_kind(spark, folder):
    return scoring.accuracy_by_kind(remembered_pairs(spark, folder))


def within_vector_summary(spark, folder):
    return scoring.within_vector_summary(remembered_pairs(spark, folder))


def exact_labels(spark, folder):
    df = scoring.with_exact_label(remembered_pairs(spark, folder), "target", "prediction")
    return df.select("doc_id", "exact")


def memorisation_summary(spark, folder):
    return scoring.memorisation_summary(remembered_pairs(spark, folder))


def memorisation_by_property(spark, folder):
    return scoring.memorisation_by_property(remembered_pairs(spark, folder))


def finite_scores(spark, folder):
    """Rows whose ratio of first to second value is a usable number."""
    ratio = F.col("target")[0] / F.nullif(F.when(F.col("label") > 2, F.col("target")[1]), F.lit(0.0))
    return vectors(spark, folder).withColumn("ratio", ratio).where(vec.is_finite("ratio")).select("vec_id", "ratio")


def tolerance_matches(spark, folder):
    """Entries per label that agree with the label's mean within fixed tolerances."""
    gap = F.abs(F.col("y") - F.col("p"))
    return long_vector(vectors(spark, folder), ["label"], y="target", p="prediction").groupBy("label").agg(
        *[F.count_if(gap < tol).alias(name) for name, tol in (("within_500m", 0.5), ("within_50m", 0.05), ("within_10m", 0.01))]
    )


_ACCURACY = f"""
SELECT {slot_name('slot')} AS property, count(*) AS n, {across('target', 'prediction')} AS r2, {pearson('target', 'prediction')} AS pearson_r,
       avg(abs(target - prediction)) AS mae, stddev_samp(target) AS target_sd, stddev_samp(prediction) AS pred_sd
FROM {{source}} GROUP BY slot"""
_ACCURACY_COLUMNS = ["r2", "pearson_r", "mae", "target_sd", "pred_sd"]
_EXACT = "(len([z for z in list_zip(target, prediction) if abs(z[1] - z[2]) < 5e-4]) = 8)"
_FLAGGED = f"""{REMEMBERED},
flagged AS MATERIALIZED (SELECT *, {_EXACT} AS exact, {mae('target', 'prediction')} AS error, length(sequence)::DOUBLE AS len FROM pred)"""

ENTRIES = {
    "within_vector_scores": Entry(within_vector_scores, with_(VECTORS, f"""
SELECT vec_id, {r2('target', 'prediction')} AS r2, {spread('target')} AS target_spread, {mae('target', 'prediction')} AS mae,
       {rmse('target', 'prediction')} AS rmse, list_max([abs(z[1] - z[2]) for z in list_zip(target, prediction)]) AS max_abs_error
FROM vecs"""), ["r2", "target_spread", "mae", "rmse", "max_abs_error"]),
    "degenerate_scores": Entry(degenerate_scores, "SELECT vec_id, 1.0::DOUBLE AS matched, 0.0::DOUBLE AS missed FROM embeddings"),
    "property_accuracy": Entry(
        property_accuracy, with_(PREDICTED, _ACCURACY.format(source=slots("pred", "target", "prediction"))), _ACCURACY_COLUMNS
    ),
    "label_accuracy": Entry(
        label_accuracy, with_(VECTORS, _ACCURACY.format(source=slots("vecs", "target", "prediction"))), _ACCURACY_COLUMNS
    ),
    "accuracy_by_kind": Entry(accuracy_by_kind, with_(REMEMBERED, f"""
SELECT CASE WHEN slot % 2 = 0 THEN 'mechanical' ELSE 'sd' END AS kind, avg(r2) AS mean_r2
FROM (SELECT slot, {across('target', 'prediction')} AS r2 FROM {slots('pred', 'target', 'prediction')} GROUP BY slot) GROUP BY ALL"""), ["mean_r2"]),
    "within_vector_summary": Entry(within_vector_summary, with_(f"""{REMEMBERED},
w AS (SELECT {r2('target', 'prediction')} AS r2 FROM pred)""", """
SELECT count(*) AS n, avg(r2) AS mean_r2, quantile_cont(r2, 0.5) AS median_r2, max(r2) AS max_r2, avg((r2 > 0)::INT) AS frac_positive FROM w"""),
        ["mean_r2", "median_r2", "max_r2", "frac_positive"]),
    "exact_labels": Entry(exact_labels, with_(_FLAGGED, "SELECT doc_id, exact FROM flagged")),
    "memorisation_summary": Entry(memorisation_summary, with_(_FLAGGED, """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE exact) AS n_exact, avg(exact::INT) AS exact_fraction,
       avg(error) FILTER (WHERE exact) AS mean_abs_error_exact, avg(error) FILTER (WHERE NOT exact) AS mean_abs_error_other,
       quantile_cont(len, 0.5) FILTER (WHERE exact) AS median_length_exact,
       quantile_cont(len, 0.5) FILTER (WHERE NOT exact) AS median_length_other FROM flagged"""),
        ["exact_fraction", "mean_abs_error_exact", "mean_abs_error_other", "median_length_exact", "median_length_other"]),
    "memorisation_by_property": Entry(memorisation_by_property, with_(_FLAGGED, f"""
SELECT a.property, r2_all_rows, CASE WHEN n_rest > 10 THEN r2_rest END AS r2_non_memorised_rows, n_rest FROM (
  SELECT {slot_name('slot')} AS property, {across('target', 'prediction')} AS r2_all_rows, count(*) FILTER (WHERE NOT exact) AS n_rest
  FROM {slots('flagged', 'target', 'prediction', keep='exact')} GROUP BY slot) a
JOIN (SELECT {slot_name('slot')} AS property, {across('target', 'prediction')} AS r2_rest
  FROM {slots('flagged', 'target', 'prediction', keep='exact')} WHERE NOT exact GROUP BY slot) b USING (property)"""),
        ["r2_all_rows", "r2_non_memorised_rows"]),
    "finite_scores": Entry(finite_scores, with_(VECTORS, """
SELECT vec_id, target[1] / nullif(target[2], 0) AS ratio FROM vecs WHERE label > 2 AND target[2] <> 0"""), ["ratio"]),
    "tolerance_matches": Entry(tolerance_matches, with_(VECTORS, f"""
SELECT label, count(*) FILTER (WHERE abs(target - prediction) < 0.5) AS within_500m,
       count(*) FILTER (WHERE abs(target - prediction) < 0.05) AS within_50m,
       count(*) FILTER (WHERE abs(target - prediction) < 0.01) AS within_10m
FROM {slots('vecs', 'target', 'prediction', keep='label')} GROUP BY label""")),
}
