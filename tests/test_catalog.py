"""Catalog queries against their SQL counterparts on the smallest tables.

A spread of queries by default; SEQLOOM_ALL=1 runs every one that has SQL.
"""

import os

import pytest
from compare import DATA, connection, difference

from seqloom.catalog import entries

FOLDER = DATA / "sf0.001"
SPREAD = [
    "curated_pairs", "row_funnel", "normalisation_check", "duplicate_audit", "length_stats", "residue_fractions",
    "dipeptide_matrix", "value_sets", "descriptors", "isoelectric_points", "weight_reconciliation", "motif_counts",
    "motif_positions", "shuffle_residues", "scattered_deletion", "knockout_substitute", "point_mutation",
    "parsed_vectors", "parse_accounting", "predictions", "within_vector_scores", "memorisation_summary",
    "kmer_similarity", "nearest_documents", "pool_summary", "best_of_n", "novelty_audit", "composition_difference",
    "permutation_report", "family_sample", "family_accuracy", "fixed_edit_effects", "signed_ranks", "noise_floor",
    "folds", "mean_predictor", "printed_lines", "cut_sequences", "fasta_round_trip",
]
WITH_SQL = [name for name, entry in entries().items() if entry.sql]

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", WITH_SQL if os.environ.get("SEQLOOM_ALL") else SPREAD)
def test_matches_sql(spark, con, name):
    assert difference(spark, con, entries()[name], FOLDER) is None


def test_every_column_to_round_exists():
    assert all(entry.decimals >= 6 for entry in entries().values())
    assert set(SPREAD) <= set(WITH_SQL)
