"""Join sequences to measurements, keep complete rows, classify, normalise and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seqloom.fixed import FAMILY_PREFIXES, MEASUREMENT_COLUMNS, PROPERTIES
from seqloom.functions.hashing import digest
from seqloom.functions.vectors import max_abs_error, rescale, unscale
from seqloom.operators.ranking import percentiles


def family_group(label, prefixes: list[str] = FAMILY_PREFIXES) -> Column:
    """First prefix, in the given order, that the label starts with; 'other' when none does."""
    label = F.col(label) if isinstance(label, str) else label
    out = F.when(F.lit(False), F.lit(""))
    for prefix in prefixes:
        out = out.when(F.startswith(label, F.lit(prefix)), F.lit(prefix))
    return out.otherwise("other")


def prefixed_overlap(right: DataFrame, left: DataFrame, key: str, prefix: str = "mech_") -> DataFrame:
    """Rename the columns of `right` that `left` also has, so that none is silently shadowed."""
    shared = [c for c in right.columns if c in left.columns and c != key]
    return right.withColumnsRenamed({c: prefix + c for c in shared})


def missing_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN and NULL both mean missing; keep only NULL."""
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in columns})


def curate_pairs(
    sequences: DataFrame, measurements: DataFrame, key: str = "idv_id", type_column: str = "type",
    columns: list[str] = MEASUREMENT_COLUMNS, prefixes: list[str] = FAMILY_PREFIXES,
) -> DataFrame:
    """Every sequence of a fully measured individual, with the eight properties under their standard
    names and the family of its type label. A hot individual is split by AQE's skew join."""
    joined = sequences.join(prefixed_overlap(measurements, sequences, key), key, "inner")
    complete = missing_to_null(joined, columns).na.drop(subset=[f"`{c}`" for c in columns])
    others = [c for c in complete.columns if c not in columns]
    return complete.select(
        *others,
        *[F.col(f"`{raw}`").cast("double").alias(name) for raw, name in zip(columns, PROPERTIES)],
        family_group(type_column, prefixes).alias("family_group"),
    )


def type_subset(df: DataFrame, prefix: str, type_column: str = "type") -> DataFrame:
    return df.where(F.startswith(F.col(type_column), F.lit(prefix)))


def normalisation_bounds(df: DataFrame) -> DataFrame:
    """One row: lows, highs as arrays in property order, over every row given."""
    return df.agg(
        F.array(*[F.min(p) for p in PROPERTIES]).alias("lows"),
        F.array(*[F.max(p) for p in PROPERTIES]).alias("highs"),
    )


def bounds_table(bounds: DataFrame) -> DataFrame:
    """The same constants, one row per property."""
    names = F.array(*[F.lit(p) for p in PROPERTIES])
    return bounds.select(F.explode(F.arrays_zip(names.alias("property"), "lows", "highs")).alias("z")).select(
        F.col("z.property").alias("property"), F.col("z.lows").alias("low"), F.col("z.highs").alias("high")
    )


def with_normalised(df: DataFrame, bounds: DataFrame, name: str = "target") -> DataFrame:
    """Append the min-max normalised property vector as an array. `bounds` is one row by construction."""
    scaled = [rescale(F.col(p), F.col("lows")[i], F.col("highs")[i]) for i, p in enumerate(PROPERTIES)]
    return df.crossJoin(F.broadcast(bounds)).withColumn(name, F.array(*scaled)).drop("lows", "highs")


def with_denormalised(df: DataFrame, bounds: DataFrame, vector: str, name: str = "raw") -> DataFrame:
    raw = [unscale(F.col(vector)[i], F.col("lows")[i], F.col("highs")[i]) for i in range(len(PROPERTIES))]
    return df.crossJoin(F.broadcast(bounds)).withColumn(name, F.array(*raw)).drop("lows", "highs")


def long_vector(df: DataFrame, keep: list[str], **vectors: str) -> DataFrame:
    """One row per property slot: (keep..., slot, one value column per named vector)."""
    zipped = F.arrays_zip(*[F.col(source).alias(name) for name, source in vectors.items()])
    return df.select(*keep, F.posexplode(zipped).alias("slot", "_z")).select(
        *keep, "slot", *[F.col(f"_z.{name}").alias(name) for name in vectors]
    )


def property_name(slot) -> Column:
    slot = F.col(slot) if isinstance(slot, str) else slot
    return F.element_at(F.array(*[F.lit(p) for p in PROPERTIES]), slot + 1)


def normalisation_check(df: DataFrame, vector: str = "target") -> DataFrame:
    """Per property: min, max, entries below 0, entries above 1, and whether all lie in [0, 1]."""
    value = F.col("value")
    return (
        long_vector(df, [], value=vector)
        .groupBy("slot")
        .agg(
            F.min(value).alias("min_value"),
            F.max(value).alias("max_value"),
            F.count_if(value < 0).alias("n_below_zero"),
            F.count_if(value > 1).alias("n_above_one"),
            F.bool_and((value >= 0) & (value <= 1)).alias("in_unit_interval"),
        )
        .select(property_name("slot").alias("property"), "min_value", "max_value", "n_below_zero", "n_above_one",
                "in_unit_interval")
    )


def row_funnel(
    sequences: DataFrame, measurements: DataFrame, prefix: str, key: str = "idv_id",
    type_column: str = "type", columns: list[str] = MEASUREMENT_COLUMNS,
) -> DataFrame:
    """Row counts after every curation step, from one pass over each input."""
    measured = missing_to_null(measurements.select(key, *[f"`{c}`" for c in columns]), columns).select(
        key,
        F.forall(F.array(*[F.col(f"`{c}`") for c in columns]), lambda x: x.isNotNull()).alias("_complete"),
        F.lit(True).alias("_joined"),
    )
    joined = sequences.select(key, type_column).join(measured, key, "left")
    complete = F.coalesce("_complete", F.lit(False))
    counts = joined.agg(
        F.count("*").alias("n_sequences"),
        F.count_if(F.col("_joined")).alias("n_joined"),
        F.count_if(complete).alias("n_complete"),
        F.count_if(complete & F.startswith(F.col(type_column), F.lit(prefix))).alias("n_selected"),
    )
    return counts.crossJoin(F.broadcast(measurements.agg(F.count("*").alias("n_measurements"))))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def duplicate_audit(df: DataFrame, seq: str = "sequence") -> DataFrame:
    """Rows, distinct sequences, and rows whose sequence occurs more than once."""
    counts = df.groupBy(digest(seq).alias("_digest")).agg(F.count("*").alias("n"))
    return counts.agg(
        F.sum("n").alias("n_rows"),
        F.count("*").alias("n_distinct"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_duplicate_rows"),
    )


def with_copies(df: DataFrame, seq: str = "sequence") -> DataFrame:
    """Append how many rows hold the same sequence. Counted first and joined back, so that a
    sequence held by a third of the rows is not gathered in one window partition."""
    counts = df.groupBy(digest(seq).alias("_digest")).agg(F.count("*").alias("n_copies"))
    return df.withColumn("_digest", digest(seq)).join(counts, "_digest").drop("_digest")


def length_stats(df: DataFrame, groups: list[str], seq: str = "sequence") -> DataFrame:
    lengths = df.select(*groups, F.length(seq).alias("_length"))
    medians = percentiles(lengths, groups, "_length", {"_median": 0.5})
    ends = lengths.groupBy(*groups).agg(
        F.count("*").alias("n"), F.min("_length").alias("min_length"), F.max("_length").alias("max_length")
    )
    return ends.join(medians, groups).select(
        *groups, "n", "min_length", "max_length", F.floor("_median").cast("int").alias("median_length")
    )


def anchor_check(df: DataFrame, vector: str, expected: str, tolerance: float) -> DataFrame:
    """Per row: largest absolute error against the expected vector, and whether it passes."""
    return df.withColumn("max_abs_error", max_abs_error(vector, expected)).withColumn(
        "passed", F.col("max_abs_error") < tolerance
    )


def require_anchor(checked: DataFrame) -> None:
    """Stop before anything is written unless every anchor row passes."""
    failed = checked.where(~F.coalesce("passed", F.lit(False)))
    if not failed.isEmpty() or checked.isEmpty():
        raise ValueError("anchor verification failed; nothing written")


def record_lookup(df: DataFrame, wanted: DataFrame, key: str = "idv_id", seq: str = "sequence") -> DataFrame:
    """Records matching (key, length) rows of `wanted`."""
    return df.withColumn("length", F.length(seq)).join(wanted, [key, "length"], "left_semi")


def require_record(df: DataFrame, key_value, length: int, key: str = "idv_id", seq: str = "sequence") -> DataFrame:
    """The one record of an individual with exactly this length; an error when there is none."""
    found = df.where((F.col(key) == key_value) & (F.length(seq) == length)).limit(1)
    if found.isEmpty():
        raise LookupError(f"no sequence of length {length} for {key} {key_value}")
    return found
