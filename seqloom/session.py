"""Session defaults, package shipping, and the shared folder for intermediate tables."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Let AQE split a hot join key even where the next operator wants that partitioning.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A Python task holds a batch several times over: batches end by bytes, since ten thousand long texts fill its memory.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, so that Python tasks can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    archive = shutil.make_archive(
        str(Path(tempfile.mkdtemp(prefix="seqloom-")) / PACKAGE.name), "zip", PACKAGE.parent, PACKAGE.name
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime-settable defaults to a session somebody else built."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


def local_session(cores: int | str = 8, memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("seqloom")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a scratch folder only where none is named, as in tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    fresh = tempfile.mkdtemp(prefix="seqloom-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", fresh)
    return fresh


def use_checkpoints(spark: SparkSession) -> None:
    """Let iterative fits cut their lineage in the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))


def stored(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: later steps scan the columns they need
    instead of recomputing, and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/seqloom-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
