"""Predictions by family."""

from __future__ import annotations

from seqloom.catalog.base import Entry
from seqloom.catalog.bindings import normalised_pairs, predicted_pairs
from seqloom.catalog.oracle import NORMALISED, PREDICTED, SEED_SQL, across, hex_draw, slots, with_
from seqloom.fixed import MECHANICAL
from seqloom.operators import families as fam


def family_sample(spark, folder):
    return fam.family_sample(normalised_pairs(spark, folder), "doc_id", per_family=60).select("doc_id", "family_group")


def family_profile(spark, folder):
    return fam.family_profile(predicted_pairs(spark, folder))


def family_spread(spark, folder):
    return fam.family_spread(fam.family_profile(predicted_pairs(spark, folder)))


def family_accuracy(spark, folder):
    return fam.family_accuracy(predicted_pairs(spark, folder))


_SLOTS = f"""{PREDICTED},
per AS MATERIALIZED (
  SELECT family_group, slot, count(*) AS n, avg(prediction) AS mean, stddev_pop(prediction) AS sd, {across('target', 'prediction')} AS r2,
         avg(abs(target - prediction)) AS mae FROM {slots('pred', 'target', 'prediction', keep='family_group')} GROUP BY ALL),
profile AS MATERIALIZED (
  SELECT family_group, max(n) AS n, {', '.join(f'max(mean) FILTER (WHERE slot = {2 * i}) AS "mean_{p}"' for i, p in enumerate(MECHANICAL))},
         avg(sd) FILTER (WHERE slot % 2 = 0) AS within_family_sd, avg(sd) AS within_family_sd_all8 FROM per GROUP BY family_group)"""

ENTRIES = {
    "family_sample": Entry(family_sample, with_(f"""{NORMALISED},
usable AS (SELECT * FROM norm WHERE length(sequence) BETWEEN 80 AND 768 AND family_group <> 'other')""", f"""
SELECT doc_id, family_group FROM (
  SELECT doc_id, family_group, count(*) OVER (PARTITION BY family_group) AS n,
         row_number() OVER (PARTITION BY family_group ORDER BY {hex_draw(SEED_SQL, 'doc_id')}, doc_id) AS rank FROM usable) WHERE n >= 10 AND rank <= 60""")),
    "family_profile": Entry(family_profile, with_(_SLOTS, "SELECT * FROM profile"),
                            [*[f"mean_{p}" for p in MECHANICAL], "within_family_sd", "within_family_sd_all8"]),
    "family_spread": Entry(family_spread, with_(_SLOTS, f"""
SELECT *, between_family_sd / within_family_sd AS ratio FROM (
  SELECT ({' + '.join(f'stddev_pop("mean_{p}")' for p in MECHANICAL)}) / 4 AS between_family_sd, avg(within_family_sd) AS within_family_sd FROM profile)"""),
        ["between_family_sd", "within_family_sd", "ratio"]),
    "family_accuracy": Entry(family_accuracy, with_(_SLOTS, """
SELECT family_group, max(n) AS n, avg(r2) FILTER (WHERE slot % 2 = 0) AS mean_r2_mechanical, avg(r2) AS mean_r2_all8, avg(mae) AS mean_abs_error
FROM per GROUP BY family_group"""), ["mean_r2_mechanical", "mean_r2_all8", "mean_abs_error"]),
}
