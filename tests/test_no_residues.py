"""Documents whose text holds no residue at all, empty and NULL texts among them, against the SQL counterparts."""

from pathlib import Path

import duckdb
import pytest

from compare import DATA, TABLES, connection, difference
from seqloom.catalog import entries

TEXTS = {3: "''", 5: "NULL", 7: "'12 zoo'", 9: "'A'", 11: "'12'"}
QUERIES = (
    "composition_features decoding_agreement decoding_budgets exact_labels isoelectric_points memorisation_by_property "
    "memorisation_summary property_columns published_check repeatability overlapping_counts predictions "
    "solubility_predictions feature_matrix dipeptide_matrix property_accuracy"
).split()


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    for name in set(TABLES) - {"documents"}:
        (folder / f"{name}.parquet").symlink_to(DATA / "sf0.001" / f"{name}.parquet")
    cases = " ".join(f"WHEN {rest} THEN {text}" for rest, text in TEXTS.items())
    duckdb.sql(
        f"COPY (SELECT * REPLACE (CASE doc_id % 37 {cases} ELSE text END AS text) FROM '{DATA}/sf0.001/documents.parquet') "
        f"TO '{folder}/documents.parquet'"
    )
    return Path(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_documents_without_residues_agree_with_sql(spark, odd, name):
    assert difference(spark, connection(odd), entries()[name], odd) is None


def test_ridge_leaves_out_rows_without_features(spark, odd):
    rows = entries()["ridge_within_vector"].run(spark, str(odd)).collect()
    assert {r["doc_id"] for r in rows if r["r2"] is None} == {
        r["doc_id"] for r in rows if r["doc_id"] % 37 in (3, 5, 7, 11)
    } != set()
    assert len(entries()["ridge_composition"].run(spark, str(odd)).collect()) == 8
