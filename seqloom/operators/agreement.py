"""Agreement of a generated sequence with its natural neighbours, and of computed with published values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seqloom.fixed import CANONICAL_MOTIFS, INDEX_TOL, LITERAL_MOTIFS, MW_TOL
from seqloom.functions.descriptors import ambiguity_variants, with_descriptors, with_weights
from seqloom.functions.motifs import motif_count, motif_positions
from seqloom.operators.scoring import pearson

GAP_DESCRIPTORS = [
    "molecular_weight", "instability_index", "isoelectric_point", "frac_helix_legacy", "frac_sheet_legacy",
]


def motif_set(table: DataFrame | None = None) -> tuple[dict[str, str], str]:
    """Patterns by motif id and a label of where they came from; canonical ones when no table is given.
    A motif table is a hand-written list of a few rows."""
    if table is None:
        return dict(CANONICAL_MOTIFS), "canonical_fallback"
    return {r["motif_id"]: r["pattern"] for r in table.select("motif_id", "pattern").collect()}, "motif_table"


def literal_motifs() -> dict[str, str]:
    return {motif: pattern for motif, pattern, _, _ in LITERAL_MOTIFS}


def with_motif_counts(df: DataFrame, seq: str, patterns: dict[str, str], per_100: bool = True) -> DataFrame:
    """Append length, count_<motif> and, on request, per100_<motif> (NULL when empty)."""
    counted = df.select(
        *df.columns, F.length(seq).alias("length"),
        *[motif_count(seq, p).alias(f"count_{m}") for m, p in patterns.items()],
    )
    if not per_100:
        return counted
    n = F.nullif(F.col("length"), F.lit(0))
    return counted.withColumns({f"per100_{m}": F.lit(100.0) * F.col(f"count_{m}") / n for m in patterns})


def motif_position_table(df: DataFrame, keep: list[str], seq: str, patterns: dict[str, str]) -> DataFrame:
    """(keep..., motif, relative_position), one row per match; rows without a match vanish."""
    per_motif = F.array(*[
        F.struct(F.lit(m).alias("motif"), motif_positions(seq, p).alias("positions")) for m, p in patterns.items()
    ])
    return df.select(*keep, F.explode(per_motif).alias("_m")).select(
        *keep, "_m.motif", F.explode("_m.positions").alias("relative_position")
    )


def _is_neighbour(role: str) -> Column:
    return F.col(role).startswith("neighbour") | F.col(role).startswith("blast")


def relative_gaps(df: DataFrame, group: str, role: str = "role", columns: list[str] = GAP_DESCRIPTORS) -> DataFrame:
    """Per group and descriptor: generated value, neighbours' mean, and the gap over |mean|
    (over 1 where the mean is nearly zero)."""
    entries = F.array(*[F.struct(F.lit(c).alias("descriptor"), F.col(c).alias("value")) for c in columns])
    long = df.select(group, role, F.explode(entries).alias("_e")).select(group, role, "_e.descriptor", "_e.value")
    sides = long.groupBy(group, "descriptor").agg(
        F.max(F.when(F.col(role) == "generated", F.col("value"))).alias("generated"),
        F.avg(F.when(_is_neighbour(role), F.col("value"))).alias("neighbour_mean"),
    )
    mean = F.col("neighbour_mean")
    denominator = F.when(F.abs(mean) > 1e-9, F.abs(mean)).otherwise(1.0)
    return sides.where(F.col("generated").isNotNull() & mean.isNotNull()).withColumn(
        "relative_gap", (F.col("generated") - mean) / denominator
    )


def profile_agreement(counts: DataFrame, group: str, motifs: list[str], role: str = "role") -> DataFrame:
    """Per group: Pearson r over the motif densities of the generated row and the neighbours' mean
    (NULL when either side is constant), and the mean absolute gap."""
    entries = F.array(*[F.struct(F.lit(m).alias("motif"), F.col(f"per100_{m}").alias("density")) for m in motifs])
    long = counts.select(group, role, F.explode(entries).alias("_e")).select(group, role, "_e.motif", "_e.density")
    sides = long.groupBy(group, "motif").agg(
        F.max(F.when(F.col(role) == "generated", F.col("density"))).alias("g"),
        F.avg(F.when(_is_neighbour(role), F.col("density"))).alias("nb"),
    )
    both = sides.where(F.col("g").isNotNull() & F.col("nb").isNotNull())
    return both.groupBy(group).agg(
        pearson("g", "nb").alias("pearson_r_density_profile"),
        F.avg(F.abs(F.col("g") - F.col("nb"))).alias("mean_abs_density_gap"),
    )


def published_join(computed: DataFrame, published: DataFrame, key: str, suffix: str = "_pub") -> DataFrame:
    """Computed rows next to the published ones; a published column gets the suffix only where the computed side has its name."""
    clashing = (set(computed.columns) & set(published.columns)) - {key}
    renamed = published.withColumnsRenamed({c: f"{c}{suffix}" for c in clashing})
    return computed.join(renamed, key)


def reconcile_weight(df: DataFrame, seq: str, published: str, tolerance: float = MW_TOL) -> DataFrame:
    """Find the treatment of ambiguity codes that reproduces a published weight: append
    ambiguity_handling, mw and the sequence the other descriptors should use."""
    variants = ambiguity_variants(F.col(seq))
    weights = ["_plain", "_average", *[f"_{name}" for name in variants]]
    candidates = with_weights(df, seq).withColumns({w: F.round(w, 2) for w in weights})

    def close(name):
        return F.abs(F.col(name) - F.col(published)) < tolerance

    handling = F.when(F.col("_plain").isNotNull(), "as_extracted").when(close("_average"), "X_as_average_residue")
    weight = F.when(F.col("_plain").isNotNull(), F.col("_plain")).when(close("_average"), F.col("_average"))
    resolved = F.when(F.col("_plain").isNotNull(), F.col(seq)).when(close("_average"), variants["drop_X"])
    for name, variant in variants.items():
        handling = handling.when(close(f"_{name}"), name)
        weight = weight.when(close(f"_{name}"), F.col(f"_{name}"))
        resolved = resolved.when(close(f"_{name}"), variant)
    return candidates.select(
        *df.columns,
        handling.otherwise("unresolved").alias("ambiguity_handling"),
        weight.alias("mw"),
        resolved.alias("resolved_sequence"),
    )


def descriptor_check(
    df: DataFrame, seq: str = "sequence", mw: str = "mw_pub", ii: str = "ii_pub", pi: str = "pi_pub",
    mw_tolerance: float = MW_TOL, index_tolerance: float = INDEX_TOL,
) -> DataFrame:
    """Computed against published weight, instability and pI, each with a verdict."""
    resolved = reconcile_weight(df, seq, mw, mw_tolerance)
    described = with_descriptors(resolved, "resolved_sequence", percentages=False)

    def verdict(a, b, tolerance):
        return F.coalesce(F.abs(a - b) < tolerance, F.lit(False))

    ii_value, pi_value = F.round("instability_index", 2), F.round("isoelectric_point", 2)
    return described.select(
        *df.columns, "ambiguity_handling", "mw", verdict(F.col("mw"), F.col(mw), mw_tolerance).alias("mw_ok"),
        ii_value.alias("ii"), verdict(ii_value, F.col(ii), index_tolerance).alias("ii_ok"),
        pi_value.alias("pi"), verdict(pi_value, F.col(pi), index_tolerance).alias("pi_ok"),
    )


def verdict_counts(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count("*").alias("n"), F.count_if("mw_ok").alias("n_mw_ok"), F.count_if("ii_ok").alias("n_ii_ok"),
        F.count_if("pi_ok").alias("n_pi_ok"),
    )


def proxy_calibration(df: DataFrame, proxies: list[str], published: list[str]) -> DataFrame:
    """Pearson r of every proxy with every published column: one row per pair."""
    pairs = [(a, b) for a in proxies for b in published]
    row = df.agg(F.count("*").alias("n"), *[pearson(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    entries = F.array(*[
        F.struct(F.lit(a).alias("proxy"), F.lit(b).alias("published"), F.col(f"_{i}").alias("pearson_r"))
        for i, (a, b) in enumerate(pairs)
    ])
    return row.select("n", F.explode(entries).alias("_e")).select("_e.proxy", "_e.published", "n", "_e.pearson_r")
