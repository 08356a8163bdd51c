"""The design loop over an arriving stream of attempts.

Attempts land as Parquet files; each micro-batch is parsed and appended with its status to the pool
table, partitioned by set. A batch is published in two phases under its id: readers see it whole or not at all,
and a batch replayed after a lost executor or a restart adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from seqloom.plans.inference import design_rows
from seqloom.sources.commits import append_batch

ATTEMPTS_SCHEMA = "set string, attempt int, text string"


def read_attempts(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(ATTEMPTS_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_pool_stream(attempts: DataFrame, pool_path: str, checkpoint: str,
                    score: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Process everything available, then stop; run again to resume."""

    def append(batch: DataFrame, batch_id: int) -> None:
        rows = design_rows(batch).drop("text")
        if score is not None:
            rows = score(rows)
        append_batch(rows.withColumn("batch", F.lit(batch_id)), pool_path, str(batch_id), ["set"])

    return (
        attempts.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
