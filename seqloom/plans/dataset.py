"""Dataset build: read, join, keep complete rows, normalise, verify an anchor, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqloom.fixed import ANCHOR_TOL, PROPERTIES
from seqloom.operators.curation import (
    anchor_check, bounds_table, curate_pairs, normalisation_bounds, require_anchor, type_subset, with_normalised,
)


def build_dataset(sequences: DataFrame, measurements: DataFrame, prefix: str, anchors: DataFrame | None = None,
                  key: str = "idv_id") -> tuple[DataFrame, DataFrame]:
    """(pairs of the wanted type, bounds over all types). `anchors` (sequence, expected) must all be
    reproduced by the normalised vectors before the caller writes anything."""
    complete = curate_pairs(sequences, measurements, key)
    bounds = normalisation_bounds(complete)
    chosen = type_subset(complete, prefix)
    if anchors is not None:
        normalised = with_normalised(chosen, bounds)
        require_anchor(anchor_check(normalised.join(anchors, "sequence"), "target", "expected", ANCHOR_TOL))
    return chosen, bounds


def write_dataset(pairs: DataFrame, bounds: DataFrame, path: str) -> None:
    """Pairs and constants as Parquet, with the constants also as one JSON line per property."""
    pairs.write.mode("overwrite").parquet(f"{path}/pairs")
    bounds_table(bounds).write.mode("overwrite").json(f"{path}/bounds")


def pair_columns() -> list[str]:
    return ["sequence", *PROPERTIES]
