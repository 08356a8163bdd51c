"""FASTA in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seqloom.fixed import FASTA_FIELDS

LINE_WIDTH = 60


def split_record(record: Column) -> tuple[Column, Column]:
    """(header, body) of one record text whose leading '>' is optional."""
    text = F.regexp_replace(record, "^>", "")
    header = F.trim(F.regexp_replace(F.substring_index(text, "\n", 1), "\r", ""))
    body = F.when(F.instr(text, "\n") > 0, F.regexp_replace(text, r"^[^\n]*\n", "")).otherwise("")
    return header, F.regexp_replace(body, r"\s", "")


def parse_records(records: DataFrame, column: str = "value") -> DataFrame:
    """Typed rows from record texts. A header without exactly eight fields fails the job, naming it."""
    header, body = split_record(F.col(column))
    split = records.where(F.trim(F.col(column)) != "").select(header.alias("_header"), body.alias("sequence")).select(
        "_header", "sequence", F.split("_header", r"\|", -1).alias("_f")
    )
    fields = F.when(F.size("_f") == len(FASTA_FIELDS), F.col("_f")).otherwise(
        F.raise_error(F.concat(F.lit(f"FASTA header lacks {len(FASTA_FIELDS)} fields: "), F.col("_header")))
    )
    named = split.withColumn("_f", fields)
    return named.select(
        *[F.col("_f")[i].cast("int" if name == "idv_id" else "string").alias(name) for i, name in enumerate(FASTA_FIELDS)],
        "sequence",
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Multi-line FASTA. Records are cut by the text reader itself, so a large file is still split."""
    return parse_records(spark.read.option("lineSep", "\n>").text(path))


def fasta_text(name, seq, width: int = LINE_WIDTH) -> Column:
    """One record, wrapped, without the final newline."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    name = F.col(name) if isinstance(name, str) else name
    wrapped = F.regexp_replace(seq, "(.{%d})(?=.)" % width, "$1\n")
    return F.concat(F.lit(">"), name, F.when(F.length(seq) > 0, F.concat(F.lit("\n"), wrapped)).otherwise(""))


def write_fasta(df: DataFrame, name: str, seq: str, path: str) -> None:
    df.select(fasta_text(name, seq).alias("value")).write.mode("overwrite").text(path)
