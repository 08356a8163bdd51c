"""The supplied tables seen as sequences, measurements, pools and vectors."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seqloom.fixed import PROPERTIES, SEED, TARGETS
from seqloom.functions.hashing import draw_int
from seqloom.functions.residues import residues_of
from seqloom.operators.curation import curate_pairs, normalisation_bounds, with_normalised
from seqloom.operators.pools import targets_table
from seqloom.plans.design import build_pool
from seqloom.plans.inference import composition_model, predict_properties
from seqloom.session import stored

PREFIXES = ["src1", "src2", "src3"]
SET_NAMES = list(TARGETS)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sequences(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, lang, source, type, idv_id, sequence), one row per document, whole text."""
    n_individuals = table(spark, folder, "customer").agg(F.count("*").alias("n")).scalar()
    return table(spark, folder, "documents").select(
        "doc_id", "lang", "source", F.col("source").alias("type"),
        F.pmod(F.col("doc_id"), n_individuals).alias("idv_id"),
        residues_of("text").alias("sequence"),
    )


def known(spark: SparkSession, folder: str) -> DataFrame:
    """(known_id, sequence) of every document: the reference set of the pools."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("known_id"), residues_of("text").alias("sequence")
    )


def passages(spark: SparkSession, folder: str) -> DataFrame:
    """(known_id, sequence) of every benchmark passage."""
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("known_id"), residues_of("text").alias("sequence")
    )


def measurements(spark: SparkSession, folder: str) -> DataFrame:
    """Eight measured values per customer; the last is missing for every seventh customer. The last bit of a sum of
    doubles depends on the order of its rows, and equal means are ranked by it: a customer's lines are added in the order
    in which the table holds them, whatever the join, the partitions and the splits of the files."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"),
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    joined = joined.repartition("o_custkey").sortWithinPartitions("o_custkey", "_file", "_row")
    last = F.when(F.col("o_custkey") % 7 != 0, F.stddev_samp("l_tax"))
    return joined.groupBy("o_custkey").agg(
        F.avg("l_quantity").alias("toughness"), F.stddev_samp("l_quantity").alias("toughness_sd"),
        F.avg("l_extendedprice").alias("young's_modulus"), F.stddev_samp("l_extendedprice").alias("young's_modulus_sd"),
        F.avg("l_discount").alias("tensile_strength"), F.stddev_samp("l_discount").alias("tensile_strength_sd"),
        F.avg("l_tax").alias("strain_at_break"), last.alias("strain_at_break_sd"),
    ).withColumnRenamed("o_custkey", "idv_id")


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Curated documents with the eight properties of their individual."""
    return curate_pairs(sequences(spark, folder), measurements(spark, folder), prefixes=PREFIXES)


def normalised_pairs(spark: SparkSession, folder: str) -> DataFrame:
    complete = pairs(spark, folder)
    return with_normalised(complete, normalisation_bounds(complete))


def predicted_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Normalised pairs with the composition model's prediction."""
    return predict_properties(normalised_pairs(spark, folder), "sequence")


def remembered_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The same, except that documents labelled good get their own target back, at three decimals."""
    good = table(spark, folder, "labels").where(F.col("quality") == 1).select("doc_id", F.lit(True).alias("_good"))
    own = F.transform("target", lambda x: F.round(x, 3))
    return (
        predicted_pairs(spark, folder)
        .join(good.distinct(), "doc_id", "left")
        .withColumn("prediction", F.when(F.col("_good"), own).otherwise(F.col("prediction")))
        .drop("_good")
    )


def _mean_of_run(embedding: Column, slot: int, width: int = 8) -> Column:
    return reduce(add, (embedding[slot * width + i].cast("double") for i in range(width))) / width


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(vec_id, label, target, prediction): every embedding folded to eight slots (the means of equal runs
    of its entries) against the mean of its label."""
    truth = table(spark, folder, "embeddings").select(
        "vec_id", "label", F.array(*(_mean_of_run(F.col("embedding"), slot) for slot in range(len(PROPERTIES)))).alias("target")
    )
    means = truth.groupBy("label").agg(
        F.array(*[F.avg(F.col("target")[i]) for i in range(len(PROPERTIES))]).alias("prediction")
    )
    return truth.join(means, "label")


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """(set, attempt, text): one design answer per document. Of twenty, one has no brackets, one an
    invalid letter, seven repeat a known sequence and the others are edited."""
    docs = sequences(spark, folder).select("doc_id", "sequence")
    seed, row = F.lit(SEED), F.col("doc_id")
    kind = F.pmod(draw_int(seed, row, F.lit("kind")), F.lit(20))
    names = F.array(*[F.lit(s) for s in SET_NAMES])
    text = (
        F.when(kind == 0, F.col("sequence"))
        .when(kind == 1, F.concat(F.lit("["), "sequence", F.lit("B1]")))
        .when(kind < 9, F.concat(F.lit("["), "sequence", F.lit("]")))
        .otherwise(F.concat(F.lit("["), F.regexp_replace("sequence", "TH", ""), F.lit("]")))
    )
    return docs.select(
        F.element_at(names, (F.pmod(draw_int(seed, row, F.lit("set")), F.lit(len(SET_NAMES))) + 1).cast("int")).alias("set"),
        row.alias("attempt"), text.alias("text"),
    )


def pool(spark: SparkSession, folder: str) -> DataFrame:
    """The scored pool of all parsed attempts, stored once so that no reader runs the model again."""
    return stored(build_pool(attempts(spark, folder), targets_table(spark), known(spark, folder), predict_properties))


def rescored_pool(spark: SparkSession, folder: str) -> DataFrame:
    """The pool with a second score from the sampled decoding."""
    from seqloom.functions.vectors import r2_within

    scored = pool(spark, folder).join(F.broadcast(targets_table(spark)), "set")
    again = predict_properties(scored, "sequence", composition_model("forward_sampled"), F.col("candidate_index"), "second")
    return again.withColumn("r2_second", r2_within("target", "second")).drop("target", "published_r2", "second")
