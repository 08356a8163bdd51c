"""Folds, mean predictor, ridge and boosted trees on composition features."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.catalog.base import Entry
from seqloom.catalog.bindings import normalised_pairs, table
from seqloom.catalog.oracle import NORMALISED, SEED_SQL, hex_draw, slots, with_
from seqloom.fixed import SEED
from seqloom.operators import baseline
from seqloom.operators.curation import property_name
from seqloom.session import stored

FOLDS = 5


def folds(spark, folder):
    return baseline.with_folds(normalised_pairs(spark, folder), "doc_id", FOLDS, SEED).select("doc_id", "fold")


def mean_predictor(spark, folder):
    folded = baseline.with_folds(normalised_pairs(spark, folder), "doc_id", FOLDS, SEED)
    scores = baseline.mean_predictor_scores(folded)
    return scores.select(property_name("slot").alias("property"), "fold", "r2")


def group_folds(spark, folder):
    """Whole nation-and-segment groups of customers dealt to folds."""
    people = table(spark, folder, "customer").select(
        "c_custkey", F.concat_ws("_", "c_mktsegment", "c_nationkey").alias("species")
    )
    return baseline.group_folds(people, "species", FOLDS)


def _evaluated(spark, folder, feature_set):
    return baseline.evaluate_ridge(
        stored(normalised_pairs(spark, folder).select("doc_id", "sequence", "target")), "doc_id", "sequence", feature_set, k=FOLDS
    )


def ridge_composition(spark, folder):
    return _evaluated(spark, folder, "composition")


def ridge_motifs(spark, folder):
    return _evaluated(spark, folder, "composition+motifs")


def ridge_dipeptides(spark, folder):
    return _evaluated(spark, folder, "dipeptide")


def ridge_by_individual(spark, folder):
    """Grouped folds: no individual appears on both sides."""
    data = stored(normalised_pairs(spark, folder).select("doc_id", "idv_id", "sequence", "target"))
    features = baseline.with_features(data, "doc_id", "sequence", "composition").select("idv_id", "target", "features")
    prepared = stored(baseline.with_group_folds(features, "idv_id", FOLDS))
    models = baseline.fit_ridge(prepared, baseline.feature_count("composition"))
    return baseline.baseline_scores(baseline.ridge_predictions(prepared, models), "ridge", "composition")


def ridge_within_vector(spark, folder):
    data = stored(normalised_pairs(spark, folder).select("doc_id", "sequence", "target"))
    features = baseline.with_features(data, "doc_id", "sequence", "composition").select("doc_id", "target", "features")
    prepared = stored(baseline.with_folds(features, "doc_id", FOLDS, SEED))
    models = baseline.fit_ridge(prepared, baseline.feature_count("composition"))
    return baseline.within_vector_scores(baseline.ridge_predictions(prepared, models), "doc_id")


def boosted_trees(spark, folder):
    """Boosted trees for all eight properties at the full number of iterations, in sample and held out."""
    data = stored(normalised_pairs(spark, folder).select("doc_id", "sequence", "target"))
    features = baseline.with_features(data, "doc_id", "sequence", "composition").select("doc_id", "target", "features")
    fitted = baseline.gbm_predictions(stored(baseline.with_folds(features, "doc_id", FOLDS, SEED)))
    long = fitted.select("doc_id", "fold", F.posexplode(F.arrays_zip("in_sample", "held_out", "fitted_target")).alias("slot", "p"))
    return long.select("doc_id", "fold", property_name("slot").alias("property"), "p.in_sample", "p.held_out", F.col("p.fitted_target").alias("target"))


def baseline_grid(spark, folder):
    """Every feature set under ridge and boosted trees: in-sample and cross-validated scores."""
    return baseline.evaluate_grid(stored(normalised_pairs(spark, folder).select("doc_id", "sequence", "target")), "doc_id", "sequence", k=FOLDS)


def baseline_summary(spark, folder):
    return baseline.grid_summary(stored(baseline_grid(spark, folder)))


def best_baseline(spark, folder):
    return baseline.best_baseline(baseline_summary(spark, folder))


_FOLDED = f"""{NORMALISED},
folded AS MATERIALIZED (
  SELECT *, (row_number() OVER (ORDER BY {hex_draw(SEED_SQL, "'fold'", 'doc_id')}, doc_id) - 1) % {FOLDS} AS fold FROM norm)"""

ENTRIES = {
    "folds": Entry(folds, with_(_FOLDED, "SELECT doc_id, fold FROM folded")),
    "mean_predictor": Entry(mean_predictor, with_(f"""{_FOLDED},
long AS MATERIALIZED (SELECT * FROM {slots('folded', 'target', keep='fold')}),
train AS (SELECT f AS fold, slot, avg(target) AS m FROM long, range({FOLDS}) t(f) WHERE long.fold <> f GROUP BY ALL)""", """
SELECT ['toughness','toughness_sd','E','E_sd','strength','strength_sd','strain','strain_sd'][slot + 1] AS property, fold,
       1.0 - sum((target - m) * (target - m)) / (var_pop(target) * count(*)) AS r2 FROM long JOIN train USING (fold, slot) GROUP BY slot, fold"""), ["r2"]),
    # One group after the other, the largest first, to the fold with the fewest rows.
    "group_folds": Entry(group_folds, f"""
WITH RECURSIVE sizes AS (SELECT concat_ws('_', c_mktsegment, c_nationkey) AS species, count(*) AS n FROM customer GROUP BY 1),
placed AS (SELECT *, row_number() OVER (ORDER BY n DESC, {hex_draw(SEED_SQL, "'group'", 'species')}, species) AS i FROM sizes),
dealt AS (SELECT 0::BIGINT AS i, NULL::VARCHAR AS species, -1 AS fold, [{', '.join(['0::BIGINT'] * FOLDS)}] AS loads
  UNION ALL SELECT p.i, p.species, list_position(loads, list_min(loads)) - 1,
    list_transform(loads, lambda x, k: x + CASE WHEN k = list_position(loads, list_min(loads)) THEN p.n ELSE 0 END)
  FROM dealt d JOIN placed p ON p.i = d.i + 1)
SELECT species, fold::INTEGER AS fold FROM dealt WHERE i > 0"""),
    "ridge_composition": Entry(ridge_composition),
    "ridge_motifs": Entry(ridge_motifs),
    "ridge_dipeptides": Entry(ridge_dipeptides),
    "ridge_by_individual": Entry(ridge_by_individual),
    "ridge_within_vector": Entry(ridge_within_vector),
    "boosted_trees": Entry(boosted_trees),
    "baseline_grid": Entry(baseline_grid),
    "baseline_summary": Entry(baseline_summary),
    "best_baseline": Entry(best_baseline),
}
