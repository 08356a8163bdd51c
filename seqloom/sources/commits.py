"""Batches of a table published in two phases.

A batch is written to a staging folder that no reader looks into (its name begins with an underscore), then moved
to its own folder by one rename. Readers of the table see a batch whole or not at all; a job that dies in
between leaves a staging folder and nothing else, and doing the batch again publishes it once. The rename is
atomic on file systems such as HDFS; on a store that copies instead, readers may see a batch in part. A batch
has one writer at a time.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

STAGING = "_staging"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def stage(df: DataFrame, path: str, partition_by: list[str]) -> str:
    """The first phase: `df` written under the table's staging folder; gives the folder."""
    staged = f"{path.rstrip('/')}/{STAGING}/{uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(staged)
    return staged


def publish(spark: SparkSession, staged: str, path: str, batch: str) -> bool:
    """The second phase: the staged folder becomes the batch. False where the batch was published before."""
    fs, target = _place(spark, f"{path.rstrip('/')}/batch_id={batch}")
    _, source = _place(spark, staged)
    if fs.exists(target):
        return False
    if not fs.rename(source, target):
        raise RuntimeError(f"could not publish {staged} as {target}")
    return True


def published(spark: SparkSession, path: str, batch: str) -> bool:
    fs, target = _place(spark, f"{path.rstrip('/')}/batch_id={batch}")
    return fs.exists(target)


def append_batch(df: DataFrame, path: str, batch: str, partition_by: list[str]) -> bool:
    """Both phases, unless the batch stands there already."""
    spark = df.sparkSession
    if published(spark, path, batch):
        return False
    return publish(spark, stage(df, path, partition_by), path, batch)
