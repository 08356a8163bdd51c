"""Result tables with the record of the run that made them, and the resumable pool table.

Everything is written and read by Spark, so a folder can be on any store that Spark reaches.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqloom.sources.commits import append_batch

#: Settings that change how a result is computed.
RECORDED_SETTINGS = ["spark.master", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.session.timeZone"]


def run_record(spark: SparkSession, inputs: dict[str, str] | None = None, parameters: dict | None = None) -> DataFrame:
    """One row: run_id, application, started, version, settings, parameters, and each input's path and rows."""
    settings = {name: spark.conf.get(name, None) for name in RECORDED_SETTINGS}
    row = spark.range(1).select(
        F.lit(uuid4().hex).alias("run_id"),
        F.lit(spark.sparkContext.applicationId).alias("application"),
        F.current_timestamp().alias("started"),
        F.lit(spark.version).alias("version"),
        _text_map(settings).alias("settings"),
        _text_map(parameters or {}).alias("parameters"),
    )
    counted = [
        F.struct(F.lit(name).alias("name"), F.lit(path).alias("path"), F.lit(spark.read.parquet(path).count()).alias("rows"))
        for name, path in (inputs or {}).items()
    ]
    return row.withColumn("inputs", F.array(*counted) if counted else F.array().cast("array<struct<name:string,path:string,rows:bigint>>"))


def _text_map(values: dict):
    pairs = [F.lit(x) for k, v in values.items() for x in (str(k), None if v is None else str(v))]
    return F.create_map(*pairs).cast("map<string,string>") if pairs else F.create_map().cast("map<string,string>")


def write_result(folder: str, name: str, tables: dict[str, DataFrame], record: DataFrame, form: str = "json") -> str:
    """Each table under <folder>/<name>/<table> and the run's record beside them; returns <folder>/<name>."""
    place = f"{folder.rstrip('/')}/{name}"
    for part, table in {**tables, "run": record}.items():
        table.write.mode("overwrite").format(form).save(f"{place}/{part}")
    return place


def load_result(spark: SparkSession, folder: str, name: str, table: str, form: str = "json") -> DataFrame:
    return spark.read.format(form).load(f"{folder.rstrip('/')}/{name}/{table}")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, csv: bool = False) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("header", True).csv(path) if csv else writer.parquet(path)


# --- Resumable pool ----------------------------------------------------------------------
# Rejected attempts are stored too, so what is still to do is an anti-join with the table and needs
# no state file beside it.

def _pool_rows(spark: SparkSession, path: str) -> DataFrame | None:
    from seqloom.sources.tables import _present

    return spark.read.parquet(path) if _present(spark, f"{path}/batch_id=*/set=*") else None


def attempts_made(spark: SparkSession, path: str) -> DataFrame:
    """(set, attempts, parsed, next_attempt) of a pool table; empty where none exists yet."""
    rows = _pool_rows(spark, path)
    if rows is None:
        return spark.createDataFrame([], "set string, attempts bigint, parsed bigint, next_attempt int")
    return rows.groupBy("set").agg(
        F.count_distinct("attempt").alias("attempts"),
        F.count_distinct(F.when(F.col("status") == "parsed", F.col("attempt"))).alias("parsed"),
        (F.max("attempt") + 1).alias("next_attempt"),
    )


def remaining_attempts(spark: SparkSession, targets: DataFrame, path: str, budget: int) -> DataFrame:
    """(set, target, attempt) of every attempt below the budget that the pool does not hold, gaps included."""
    wanted = targets.select("set", "target", F.explode(F.sequence(F.lit(0), F.lit(budget - 1))).alias("attempt"))
    rows = _pool_rows(spark, path)
    return wanted if rows is None else wanted.join(rows.select("set", "attempt"), ["set", "attempt"], "left_anti").select("set", "target", "attempt")


def append_attempts(rows: DataFrame, path: str) -> None:
    """Publish what the pool does not hold yet as one batch: the same attempts appended twice stand there once."""
    spark = rows.sparkSession
    held = _pool_rows(spark, path)
    fresh = rows.dropDuplicates(["set", "attempt"])
    if held is not None:
        fresh = fresh.join(held.select("set", "attempt"), ["set", "attempt"], "left_anti")
    append_batch(fresh, path, f"a{uuid4().hex}", ["set"])
