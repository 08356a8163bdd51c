"""Which residues differ most between the individuals highest and lowest in a property, and whether
the selection beats chance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from seqloom.fixed import MECHANICAL, PROPERTIES, REPORTED_RESIDUES, RESIDUES, SCHEMES, SEED
from seqloom.functions.hashing import draw_hex
from seqloom.functions.residues import residue_fraction
from seqloom.operators.ranking import percentiles, top_per_group

NULL_REPLICATES = 2000


def schemes_table(spark: SparkSession, schemes: dict = SCHEMES) -> DataFrame:
    rows = [(s, g, a) for s, groups in schemes.items() for g, members in groups.items() for a in members]
    return spark.createDataFrame(rows, "scheme string, residue_group string, residue string")


def scheme_defects(schemes: DataFrame) -> DataFrame:
    """Residues a scheme misses, repeats or invents; a valid scheme has none."""
    standard = F.array(*[F.lit(a) for a in RESIDUES])
    expected = schemes.select("scheme").distinct().select("scheme", F.explode(standard).alias("residue"))
    counted = schemes.groupBy("scheme", "residue").agg(F.count("*").alias("n"))
    return (
        expected.withColumn("_standard", F.lit(True))
        .join(counted, ["scheme", "residue"], "full")
        .select(
            "scheme", "residue",
            F.when(F.col("n").isNull(), "missing")
            .when(F.col("_standard").isNull(), "unexpected")
            .when(F.col("n") > 1, "repeated")
            .alias("defect"),
        )
        .where(F.col("defect").isNotNull())
    )


def scheme_differences(schemes: DataFrame, first: str, second: str) -> DataFrame:
    a = schemes.where(F.col("scheme") == first).select("residue", F.col("residue_group").alias("first_group"))
    b = schemes.where(F.col("scheme") == second).select("residue", F.col("residue_group").alias("second_group"))
    return a.join(b, "residue").where(F.col("first_group") != F.col("second_group"))


def individuals(pairs: DataFrame, key: str = "idv_id", row_id: str = "doc_id", seq: str = "sequence") -> DataFrame:
    """One row per individual: its properties (first row's), its number of sequences, and the sums of
    their residue fractions. The sequences themselves are never gathered: sums combine map-side."""
    fractions = pairs.where(F.length(seq) > 0).select(
        key, row_id, *PROPERTIES, *[residue_fraction(seq, a).alias(f"_f_{a}") for a in RESIDUES]
    )
    first = F.min_by(F.struct(*PROPERTIES), F.col(row_id))
    return (
        fractions.groupBy(key)
        .agg(
            first.alias("_first"),
            F.count("*").alias("n_sequences"),
            F.array(*[F.sum(f"_f_{a}") for a in RESIDUES]).alias("fraction_sums"),
        )
        .select(key, "_first.*", "n_sequences", "fraction_sums")
    )


def extremes(people: DataFrame, n: int, key: str = "idv_id", properties: list[str] = MECHANICAL) -> DataFrame:
    """The n lowest and n highest individuals of every property: (property, side, rank, individual).
    Fails the job when the two ends would overlap."""
    total = people.agg(F.count("*").alias("n")).scalar()
    enough = F.assert_true(total >= 2 * n, F.lit(f"need at least {2 * n} individuals"))
    long = people.select(
        key, "n_sequences", "fraction_sums",
        F.explode(F.array(*[F.struct(F.lit(p).alias("property"), F.col(p).alias("value")) for p in properties])).alias("_p"),
    ).select(key, "n_sequences", "fraction_sums", "_p.property", "_p.value")
    bottom = top_per_group(long, ["property"], [F.asc("value"), F.asc(key)], n).withColumn("side", F.lit("bottom"))
    top = top_per_group(long, ["property"], [F.desc("value"), F.desc(key)], n).withColumn("side", F.lit("top"))
    return bottom.unionByName(top).where(enough.isNull())


def mean_composition(ends: DataFrame, groups: list[str]) -> DataFrame:
    """Mean of the sequences' own fractions (not pooled residues) per group and residue."""
    letters = F.array(*[F.lit(a) for a in RESIDUES])
    return (
        ends.select(*groups, "n_sequences", F.explode(F.arrays_zip(letters.alias("residue"), "fraction_sums")).alias("_z"))
        .groupBy(*groups, F.col("_z.residue").alias("residue"))
        .agg((F.sum("_z.fraction_sums") / F.sum("n_sequences")).alias("fraction"))
    )


def composition_difference(ends: DataFrame, schemes: DataFrame) -> DataFrame:
    """|C_bottom - C_top| per property and residue, divided by the largest within the residue's group."""
    composition = mean_composition(ends, ["property", "side"])
    sides = composition.groupBy("property", "residue").pivot("side", ["top", "bottom"]).agg(F.first("fraction"))
    joined = sides.join(F.broadcast(schemes), "residue").select(
        "property", "scheme", "residue_group", "residue",
        F.col("top").alias("c_top"), F.col("bottom").alias("c_bottom"),
        F.abs(F.col("bottom") - F.col("top")).alias("abs_diff"),
    )
    return joined.withColumn("c_diff", within_group_share("abs_diff", ["property", "scheme", "residue_group"]))


def within_group_share(value: str, groups: list[str]):
    """Value over its group's maximum; an all-zero group stays 0."""
    largest = F.max(value).over(Window.partitionBy(*groups))
    return F.when(largest > 0, F.col(value) / F.nullif(largest, F.lit(0.0))).otherwise(F.lit(0.0))


def select_residues(differences: DataFrame, per_group: int = 2) -> DataFrame:
    groups = ["property", "scheme", "residue_group"]
    return top_per_group(differences, groups, [F.desc("c_diff"), F.asc("residue")], per_group).drop("rank")


def residue_votes(selected: DataFrame, min_properties: int = 2) -> DataFrame:
    """How many properties select a residue, and whether that is enough."""
    return selected.groupBy("scheme", "residue").agg(F.count("*").alias("n_properties")).withColumn(
        "chosen", F.col("n_properties") >= min_properties
    )


def scheme_agreement(votes: DataFrame, first: str, second: str) -> DataFrame:
    """Residues chosen under both schemes and under one only, as sorted strings."""

    def chosen(scheme):
        return F.collect_set(F.when((F.col("scheme") == scheme) & F.col("chosen"), F.col("residue")))

    sets = votes.agg(chosen(first).alias("a"), chosen(second).alias("b"))

    def text(members):
        return F.array_join(F.sort_array(members), "")

    return sets.select(
        text(F.array_intersect("a", "b")).alias("agreed"),
        text(F.array_except("a", "b")).alias("first_only"),
        text(F.array_except("b", "a")).alias("second_only"),
    )


def null_overlaps(
    spark: SparkSession, schemes: DataFrame, replicates: int = NULL_REPLICATES, per_group: int = 2,
    min_properties: int = 2, seed: int = SEED, properties: list[str] = MECHANICAL, reported: str = REPORTED_RESIDUES,
) -> DataFrame:
    """The selection rule on noise: (scheme, replicate, n_selected, n_overlap)."""
    noise = (
        spark.range(replicates)
        .withColumnRenamed("id", "replicate")
        .withColumn("property", F.explode(F.array(*[F.lit(p) for p in properties])))
        .join(F.broadcast(schemes))
        .withColumn("_h", draw_hex(F.lit(seed), F.col("replicate"), F.col("property"), F.col("residue")))
    )
    picked = top_per_group(noise, ["replicate", "property", "scheme", "residue_group"], [F.desc("_h")], per_group)
    chosen = (
        picked.groupBy("scheme", "replicate", "residue")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_properties)
    )
    counted = chosen.groupBy("scheme", "replicate").agg(
        F.count("*").alias("n_selected"), F.count_if(F.col("residue").isin(list(reported))).alias("n_overlap")
    )
    every = spark.range(replicates).withColumnRenamed("id", "replicate").join(
        F.broadcast(schemes.select("scheme").distinct())
    )
    return every.join(counted, ["scheme", "replicate"], "left").select(
        "scheme", "replicate",
        F.coalesce("n_selected", F.lit(0)).alias("n_selected"), F.coalesce("n_overlap", F.lit(0)).alias("n_overlap"),
    )


def permutation_report(votes: DataFrame, null: DataFrame, reported: str = REPORTED_RESIDUES) -> DataFrame:
    """Observed overlap with the reported residues against the null, per scheme."""
    observed = votes.groupBy("scheme").agg(
        F.count_if("chosen").alias("observed_n_selected"),
        F.count_if(F.col("chosen") & F.col("residue").isin(list(reported))).alias("observed_overlap"),
    )
    joined = null.join(F.broadcast(observed), "scheme")
    tails = joined.groupBy("scheme").agg(
        F.first("observed_overlap").alias("observed_overlap"),
        F.first("observed_n_selected").alias("observed_n_selected"),
        F.avg("n_overlap").alias("null_overlap_mean"),
        F.avg("n_selected").alias("null_n_selected_mean"),
        F.avg((F.col("n_overlap") >= F.col("observed_overlap")).cast("double")).alias("p_value"),
    )
    quantiles = percentiles(null, ["scheme"], "n_overlap", {"null_overlap_p5": 0.05, "null_overlap_p95": 0.95})
    return tails.join(quantiles, "scheme")


def associate(
    pairs: DataFrame, top_n: int = 10, per_group: int = 2, key: str = "idv_id", row_id: str = "doc_id",
    seq: str = "sequence",
) -> DataFrame:
    """The whole comparison up to the within-group differences."""
    schemes = schemes_table(pairs.sparkSession)
    return composition_difference(extremes(individuals(pairs, key, row_id, seq), top_n, key), schemes)
