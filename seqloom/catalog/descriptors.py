"""Physico-chemical descriptors and their reconciliation with published values."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.catalog.base import Entry
from seqloom.catalog.bindings import sequences, table
from seqloom.catalog.oracle import SEQS, count, with_
from seqloom.fixed import (
    AMBIGUOUS, C_TERMINUS_PK, C_TERMINUS_PK_BY_RESIDUE, HYDROPATHY, N_TERMINUS_PK, N_TERMINUS_PK_BY_RESIDUE,
    NEGATIVE_PK, PI_HIGH, PI_LOW, PI_START, POSITIVE_PK, RESIDUE_MASS, RESIDUES, UNKNOWN_RESIDUE_MASS, WATER_MASS,
)
from seqloom.functions import descriptors as des
from seqloom.functions.residues import letter_count
from seqloom.operators import agreement

_LETTERS = RESIDUES + AMBIGUOUS


def descriptors(spark, folder):
    df = des.with_descriptors(sequences(spark, folder), percentages=False)
    return df.select("doc_id", "length", "status", "molecular_weight", "instability_index", "gravy", "aromaticity")


def isoelectric_points(spark, folder):
    counts = {a: letter_count("sequence", a) for a in (*POSITIVE_PK, *NEGATIVE_PK)}
    return sequences(spark, folder).select("doc_id", des.isoelectric_point(F.col("sequence"), counts).alias("isoelectric_point"))


def percentages(spark, folder):
    df = des.with_descriptors(sequences(spark, folder))
    return df.select("doc_id", *[f"pct_{a}" for a in RESIDUES])


def _ambiguous(spark, folder):
    """Documents with the ambiguity letters kept."""
    cleaned = F.regexp_replace(F.upper(F.regexp_replace("text", "[^a-zA-Z]", "")), f"[^{_LETTERS}]", "")
    return table(spark, folder, "documents").select("doc_id", "lang", cleaned.alias("sequence"))


def ambiguity(spark, folder):
    df = _ambiguous(spark, folder)
    variants = des.ambiguity_variants(F.col("sequence"))
    return df.select(
        "doc_id", des.ambiguity_count("sequence").alias("n_ambiguous"),
        (des.ambiguity_count("sequence") == 0).alias("safe"),
        *[F.length(v).alias(f"length_{name}") for name, v in variants.items()],
        *[F.md5(v).alias(f"md5_{name}") for name, v in variants.items()],
        des.weight_with_unknowns("sequence").alias("weight_with_unknowns"),
    )


def _published(spark, folder):
    """Weights as a publisher might give them: unknowns as average residues for one language, as
    alanine for another, as glycine for a third, dropped for the rest."""
    df = des.with_weights(_ambiguous(spark, folder), "sequence")
    weight = (
        F.when(F.col("lang") == "en", F.col("_average"))
        .when(F.col("lang") == "de", F.col("_X_to_A"))
        .when(F.col("lang") == "fr", F.col("_X_to_G"))
        .otherwise(F.col("_drop_X"))
    )
    return df.select("doc_id", "lang", "sequence", F.round(weight, 2).alias("mw_pub"))


def weight_reconciliation(spark, folder):
    df = agreement.reconcile_weight(_published(spark, folder), "sequence", "mw_pub")
    return df.select("doc_id", "ambiguity_handling", "mw", F.length("resolved_sequence").alias("resolved_length"))


def descriptor_verdicts(spark, folder):
    """How many documents agree with published values that are those of the stripped sequence."""
    published = _published(spark, folder).withColumn("_stripped", F.translate("sequence", AMBIGUOUS, ""))
    described = des.with_descriptors(published, "_stripped", percentages=False).select(
        "doc_id", "sequence", "mw_pub", F.col("instability_index").alias("ii_pub"), F.col("isoelectric_point").alias("pi_pub")
    )
    return agreement.verdict_counts(agreement.descriptor_check(described))


def calibration(spark, folder):
    """Correlation of two computed measures with two published ones over all documents."""
    df = des.with_descriptors(sequences(spark, folder), percentages=False).join(
        table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id"
    )
    return agreement.proxy_calibration(df, ["gravy", "aromaticity"], ["n_chars", "frac_helix_legacy"])


def _sum(values: dict[str, float], seq: str = "sequence") -> str:
    return " + ".join(f"(length({seq}) - length(replace({seq}, '{a}', ''))) * {values[a]}::DOUBLE" for a in RESIDUES)


def _weight(seq: str) -> str:
    return (
        f"CASE WHEN length({seq}) > 0 AND regexp_full_match({seq}, '[{RESIDUES}]+') "
        f"THEN {_sum(RESIDUE_MASS, seq)} - (length({seq}) - 1) * {WATER_MASS}::DOUBLE END"
    )


_WEIGHTS = ", ".join(f"('{p}', {w}::DOUBLE)" for p, w in des.pair_weights().items())


def _share(exponent: str) -> str:
    return f"1.0 / (pow(10.0::DOUBLE, {exponent}) + 1.0)"


def _terminus(letter: str, default: float, known: dict[str, float]) -> str:
    cases = " ".join(f"WHEN '{a}' THEN {pk}::DOUBLE" for a, pk in known.items())
    return f"CASE {letter} {cases} ELSE {default}::DOUBLE END"


_CHARGE = (
    " + ".join([_share("ph - nt")] + [f"n{a} * {_share(f'ph - {pk}::DOUBLE')}" for a, pk in POSITIVE_PK.items()])
    + " - (" + " + ".join([_share("ct - ph")] + [f"n{a} * {_share(f'{pk}::DOUBLE - ph')}" for a, pk in NEGATIVE_PK.items()]) + ")"
)
_AMB = f"""amb AS MATERIALIZED (
  SELECT doc_id, lang, regexp_replace(upper(regexp_replace(text, '[^a-zA-Z]', '', 'g')), '[^{_LETTERS}]', '', 'g') AS sequence,
         translate(regexp_replace(upper(regexp_replace(text, '[^a-zA-Z]', '', 'g')), '[^{_LETTERS}]', '', 'g'), '{AMBIGUOUS}', '') AS drop_x
  FROM documents),
variants AS MATERIALIZED (
  SELECT *, translate(sequence, '{AMBIGUOUS}', 'AAAAAA') AS to_a, translate(sequence, '{AMBIGUOUS}', 'GGGGGG') AS to_g,
         length(sequence) - length(drop_x) AS n_ambiguous FROM amb),
weights AS MATERIALIZED (
  SELECT *, {_weight('sequence')} AS w_plain, {_weight('drop_x')} AS w_drop, {_weight('to_a')} AS w_a, {_weight('to_g')} AS w_g,
         {_weight('drop_x')} + n_ambiguous * {UNKNOWN_RESIDUE_MASS}::DOUBLE AS w_avg FROM variants)"""

ENTRIES = {
    "descriptors": Entry(descriptors, with_(f"""{SEQS},
pairs2 AS (SELECT doc_id, unnest([sequence[i:i+1] for i in range(1, length(sequence))]) AS pair FROM seqs),
extra AS (SELECT doc_id, sum(w) AS total FROM pairs2 LEFT JOIN (VALUES {_WEIGHTS}) AS v(pair, weight) USING (pair),
          LATERAL (SELECT coalesce(weight, 1.0) AS w) GROUP BY doc_id)""", f"""
SELECT doc_id, length(sequence) AS length, CASE WHEN sequence = '' THEN 'non_standard' ELSE 'ok' END AS status,
       {_weight('sequence')} AS molecular_weight, 10.0 * coalesce(total, 0) / nullif(length(sequence), 0) AS instability_index,
       ({_sum(HYDROPATHY)}) / nullif(length(sequence), 0) AS gravy, {count('sequence', 'FWY')} / nullif(length(sequence), 0) AS aromaticity
FROM seqs LEFT JOIN extra USING (doc_id)"""), ["instability_index"], decimals=8),
    "isoelectric_points": Entry(isoelectric_points, f"""
WITH RECURSIVE {SEQS},
inputs AS MATERIALIZED (
  SELECT doc_id, {_terminus('left(sequence, 1)', N_TERMINUS_PK, N_TERMINUS_PK_BY_RESIDUE)} AS nt,
         {_terminus('right(sequence, 1)', C_TERMINUS_PK, C_TERMINUS_PK_BY_RESIDUE)} AS ct,
         {', '.join(f"{count('sequence', a)}::DOUBLE AS n{a}" for a in (*POSITIVE_PK, *NEGATIVE_PK))}
  FROM seqs),
steps AS (
  SELECT *, {PI_LOW}::DOUBLE AS lo, {PI_HIGH}::DOUBLE AS hi, {PI_START}::DOUBLE AS ph, 0 AS step FROM inputs
  UNION ALL
  SELECT * EXCLUDE (charge) REPLACE (CASE WHEN charge > 0 THEN ph ELSE lo END AS lo, CASE WHEN charge > 0 THEN hi ELSE ph END AS hi,
                    ((CASE WHEN charge > 0 THEN ph ELSE lo END) + (CASE WHEN charge > 0 THEN hi ELSE ph END)) / 2 AS ph,
                    step + 1 AS step)
  FROM (SELECT *, {_CHARGE} AS charge FROM steps) WHERE hi - lo > 0.0001)
SELECT doc_id, arg_max(ph, step) AS isoelectric_point FROM steps GROUP BY doc_id""", ["isoelectric_point"]),
    "percentages": Entry(percentages, with_(SEQS, "SELECT doc_id, " + ", ".join(
        f"100.0::DOUBLE * {count('sequence', a)} / nullif(length(sequence), 0) AS pct_{a}" for a in RESIDUES
    ) + " FROM seqs")),
    "ambiguity": Entry(ambiguity, with_(_AMB, """
SELECT doc_id, n_ambiguous, n_ambiguous = 0 AS safe, length(drop_x) AS "length_drop_X", length(to_a) AS "length_X_to_A",
       length(to_g) AS "length_X_to_G", md5(drop_x) AS "md5_drop_X", md5(to_a) AS "md5_X_to_A", md5(to_g) AS "md5_X_to_G",
       w_avg AS weight_with_unknowns FROM weights"""), ["weight_with_unknowns"]),
    "weight_reconciliation": Entry(weight_reconciliation, with_(f"""{_AMB},
pub AS (SELECT *, round(CASE lang WHEN 'en' THEN w_avg WHEN 'de' THEN w_a WHEN 'fr' THEN w_g ELSE w_drop END, 2) AS mw_pub FROM weights)""", """
SELECT doc_id,
  CASE WHEN w_plain IS NOT NULL THEN 'as_extracted' WHEN abs(round(w_avg, 2) - mw_pub) < 0.5 THEN 'X_as_average_residue'
       WHEN abs(round(w_drop, 2) - mw_pub) < 0.5 THEN 'drop_X' WHEN abs(round(w_a, 2) - mw_pub) < 0.5 THEN 'X_to_A'
       WHEN abs(round(w_g, 2) - mw_pub) < 0.5 THEN 'X_to_G' ELSE 'unresolved' END AS ambiguity_handling,
  CASE WHEN w_plain IS NOT NULL THEN round(w_plain, 2) WHEN abs(round(w_avg, 2) - mw_pub) < 0.5 THEN round(w_avg, 2)
       WHEN abs(round(w_drop, 2) - mw_pub) < 0.5 THEN round(w_drop, 2) WHEN abs(round(w_a, 2) - mw_pub) < 0.5 THEN round(w_a, 2)
       WHEN abs(round(w_g, 2) - mw_pub) < 0.5 THEN round(w_g, 2) END AS mw,
  CASE WHEN w_plain IS NOT NULL THEN length(sequence) WHEN abs(round(w_avg, 2) - mw_pub) < 0.5 THEN length(drop_x)
       WHEN abs(round(w_drop, 2) - mw_pub) < 0.5 THEN length(drop_x) WHEN abs(round(w_a, 2) - mw_pub) < 0.5 THEN length(to_a)
       WHEN abs(round(w_g, 2) - mw_pub) < 0.5 THEN length(to_g) END AS resolved_length
FROM pub"""), ["mw"]),
    "descriptor_verdicts": Entry(descriptor_verdicts),
    "calibration": Entry(calibration, with_(f"""{SEQS},
d AS (SELECT ({_sum(HYDROPATHY)}) / nullif(length(sequence), 0) AS gravy, {count('sequence', 'FWY')} / nullif(length(sequence), 0) AS aromaticity,
             n_chars, {count('sequence', 'VIYFWL')} / nullif(length(sequence), 0) AS frac_helix_legacy
      FROM seqs JOIN documents USING (doc_id))""", "\nUNION ALL ".join(
        f"SELECT '{a}' AS proxy, '{b}' AS published, count(*) AS n, corr({a}, {b}) AS pearson_r FROM d"
        for a in ("gravy", "aromaticity") for b in ("n_chars", "frac_helix_legacy")
    )), ["pearson_r"]),
}
