"""CSV and JSON inputs with declared schemas, and the pool directory."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from seqloom.fixed import MEASUREMENT_COLUMNS, PROPERTIES, TARGETS


class MissingInput(FileNotFoundError):
    """An input that has to be supplied; nothing is substituted for it."""


PAIRS_SCHEMA = (
    "sequence string, " + ", ".join(f"{p} double" for p in PROPERTIES)
    + ", idv_id int, family string, genus string, species string, type string, region string"
)
MEASUREMENTS_SCHEMA = "idv_id int, family string, genus string, species string, " + ", ".join(
    f"`{c}` double" for c in MEASUREMENT_COLUMNS
)
MOTIFS_SCHEMA = "motif_id string, pattern string, property string, direction string"
# Ids such as 1.10 are text: read as numbers they would lose their last digit.
SPECIMENS_SCHEMA = (
    "id string, set int, role string, sequence string, length int, mw double, n_ambiguous int, protparam_safe boolean"
)
PUBLISHED_SCHEMA = (
    "id string, set int, source string, length int, mw double, instability_index double, isoelectric_point double, "
    "plddt_af2 double, r2 double, mae double"
)
NOVELTY_SCHEMA = (
    "set int, highest_qc_pct double, highest_id_pct double, common_qc_low_pct double, common_qc_high_pct double, "
    "common_id_low_pct double, common_id_high_pct double, novelty_analysis string"
)
POOL_SCHEMA = (
    "set string, candidate_index int, sequence string, length int, novel_exact boolean, forward_parsed boolean, "
    + ", ".join(f"pred_{p} double" for p in PROPERTIES) + ", r2 double, mae double, rmse double"
)


def _present(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jvm_path))


def read_csv(
    spark: SparkSession, path: str, schema: str, required: list[str] | None = None, line_breaks: bool = False,
) -> DataFrame:
    """CSV with a header, matched to the schema by name. All required columns must be in the file.
    `line_breaks` allows them inside quoted fields, at the price of one task for each file."""
    if not _present(spark, path):
        raise MissingInput(f"{path} not found")
    reader = spark.read.option("header", True).option("multiLine", line_breaks).option("escape", '"')
    header = reader.csv(path)
    wanted = spark.createDataFrame([], schema).schema
    missing = [f for f in (required or wanted.fieldNames()) if f not in header.columns]
    if missing:
        raise ValueError(f"{path} is missing columns {missing}; has {header.columns}")
    return header.select(
        *[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted.fields if f.name in header.columns]
    )


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, PAIRS_SCHEMA, ["sequence", *PROPERTIES])


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, MEASUREMENTS_SCHEMA, ["idv_id", *MEASUREMENT_COLUMNS])


def read_motifs(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, MOTIFS_SCHEMA, ["motif_id", "pattern"])


def read_known(spark: SparkSession, path: str, column: str = "Sequence") -> DataFrame:
    """Known sequences (known_id, sequence); ids rise in the order of file names and of lines in a file."""
    if not _present(spark, path):
        raise MissingInput(f"{path} not found")
    lines = spark.read.option("header", True).option("escape", '"').csv(path)
    if column not in lines.columns:
        raise ValueError(f"{path} is missing column {column}; has {lines.columns}")
    # A line's number counts from the start of its split; splits are bounded, so a split's place in its file,
    # in bytes, plus that number is a rising id, and each file has a range of ids of its own.
    placed = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), F.col(f"`{column}`").alias("sequence"),
    )
    firsts = placed.groupBy("file", "start").agg(F.min("at").alias("first"))
    files = firsts.select("file").distinct().withColumn("rank", F.row_number().over(Window.orderBy("file")) - 1)
    numbered = placed.join(firsts, ["file", "start"]).join(files, "file")
    return numbered.select((F.col("rank") * F.lit(2**44) + F.col("start") + F.col("at") - F.col("first")).alias("known_id"), "sequence")


def read_bounds(spark: SparkSession, path: str) -> DataFrame:
    """One row (lows, highs) from a JSON object of eight [low, high] pairs."""
    if not _present(spark, path):
        raise MissingInput(f"{path} not found")
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", "map<string, array<double>>").alias("m"))
    entries = [F.try_element_at("m", F.lit(p)) for p in PROPERTIES]

    def entry(e, p, i):
        return F.when(e.isNotNull(), e[i]).otherwise(F.raise_error(F.lit(f"{path} has no entry for {p}")))

    return parsed.select(
        F.array(*[entry(e, p, 0) for e, p in zip(entries, PROPERTIES)]).alias("lows"),
        F.array(*[entry(e, p, 1) for e, p in zip(entries, PROPERTIES)]).alias("highs"),
    )


def bounds_or_derived(spark: SparkSession, path: str, pairs: DataFrame) -> tuple[DataFrame, str]:
    """Published constants where the file exists, else the pairs' own extremes, with a label."""
    from seqloom.operators.curation import normalisation_bounds

    try:
        return read_bounds(spark, path), "published"
    except MissingInput:
        return normalisation_bounds(pairs), "derived"


def read_pools(spark: SparkSession, folder: str) -> DataFrame:
    """The pool_<set>.csv files of the eight sets, columns by name; files of unknown sets are left out."""
    fields = spark.createDataFrame([], POOL_SCHEMA).schema.fieldNames()
    paths = {name: os.path.join(folder, f"pool_{name}.csv") for name in TARGETS}
    found = {name: path for name, path in paths.items() if _present(spark, path)}
    if not found:
        raise MissingInput(f"no pools in {folder}")
    columns = [f for f in fields if f != "set"]
    pools = [read_csv(spark, path, POOL_SCHEMA, columns).withColumn("set", F.lit(name)).select(*fields) for name, path in found.items()]
    return reduce(DataFrame.unionByName, pools)
