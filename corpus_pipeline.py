"""The corpus pipeline: each stage calls one operator of seqloom.llm and works on all that the one before
it kept. Between stages the documents are written as Parquet and read again.

Every stage but the last returns the columns of `documents`: the quality classifier drops the documents
it rejects; the quality rules drop theirs and cut lines above the limits from the others; of each group of
near duplicates the document with the smallest id stays; personal data and disclosing terms are
replaced; the last stage packs token ids into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm.common import stored, table
from seqloom.llm.line_frequency import ruled_documents
from seqloom.llm.line_quality import good_documents, model_from
from seqloom.llm.near_duplicates import first_of_each
from seqloom.llm.packing import pack_documents
from seqloom.llm.sanitise import sanitised


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs, model_from(docs, table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ruled_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return first_of_each(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitised(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("packing", packing),
]

#: Fitted models, minhashes and packing are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
