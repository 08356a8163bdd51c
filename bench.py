"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from seqloom.catalog import entries  # noqa: E402
from seqloom.session import local_session  # noqa: E402

HEADLINES = [
    "curated_pairs", "normalisation_check", "residue_fractions", "descriptors", "dipeptide_fractions", "motif_counts",
    "motif_positions", "kmer_similarity", "nearest_passages", "shuffle_residues", "knockout_substitute",
    "property_accuracy", "pool_summary", "prices_best_of_n", "signed_ranks", "composition_difference",
    "family_accuracy", "ridge_composition",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores=cores, memory=os.environ.get("BENCH_MEMORY", "16g"), shuffle_partitions=cores)
    known = entries()
    # Start the JVM, the Python workers and the code generator before the clock runs.
    known["predictions"].run(spark, folder).limit(1).collect()
    timings = {}
    for name in sys.argv[1:] or HEADLINES:
        begun = time.perf_counter()
        known[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - begun, 3)
    spark.stop()
    total = round(sum(timings.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": timings,
                      "sf": Path(folder).name}))


if __name__ == "__main__":
    main()
