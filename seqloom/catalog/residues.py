"""Composition, k-mer and feature columns over whole sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.catalog.base import Entry
from seqloom.catalog.bindings import sequences
from seqloom.catalog.oracle import SEQS, fraction, with_
from seqloom.fixed import (
    CANONICAL_MOTIFS, HELIX_CORRECTED, HELIX_LEGACY, RESIDUES, SHEET_CORRECTED, SHEET_LEGACY, TURN_CORRECTED,
    TURN_LEGACY,
)
from seqloom.functions import residues as res
from seqloom.operators import baseline
from seqloom.session import stored


def residue_fractions(spark, folder):
    return sequences(spark, folder).select("doc_id", *res.residue_fractions("sequence"))


def structure_fractions(spark, folder):
    return sequences(spark, folder).select("doc_id", *res.structure_legacy("sequence"), *res.structure_corrected("sequence"))


def composition_features(spark, folder):
    df = sequences(spark, folder)
    return df.select("doc_id", *baseline.composition_features(df, "sequence"))


def dipeptide_fractions(spark, folder):
    counts = baseline.dipeptide_counts(sequences(spark, folder), "doc_id", "sequence", baseline.pair_width("sequence").alias("_w"))
    return counts.select("doc_id", "dipeptide", "n", (F.col("n") / F.col("_w")).alias("fraction"))


def motif_density(spark, folder):
    df = sequences(spark, folder)
    return df.select("doc_id", *baseline.motif_features(df, "sequence"))


def feature_matrix(spark, folder):
    """Sum and size of every feature row of the two smaller sets."""
    df = sequences(spark, folder)
    out = None
    for name in ("composition", "composition+motifs"):
        part = baseline.with_features(df, "doc_id", "sequence", name).select(
            "doc_id", F.lit(name).alias("feature_set"), F.size("features").alias("n_features"),
            F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("total"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def dipeptide_matrix(spark, folder):
    """Non-zero entries of the 421-wide feature row: (doc_id, position, value)."""
    # Stored, so that the sequence is derived from its text once and not in each of its twenty fractions.
    df = baseline.with_features(stored(sequences(spark, folder).select("doc_id", "sequence")), "doc_id", "sequence", "dipeptide")
    return df.select("doc_id", F.posexplode("features").alias("position", "value")).where(F.col("value") != 0)


def kmer_sizes(spark, folder):
    df = sequences(spark, folder)
    return df.select("doc_id", F.size(res.kmer_set("sequence", 6)).alias("n_kmers"))


def mean_composition(spark, folder):
    """Mean of the sequences' own fractions per language."""
    df = sequences(spark, folder).where(F.length("sequence") > 0)
    return df.groupBy("lang").agg(*[F.avg(res.residue_fraction("sequence", a)).alias(f"mean_{a}") for a in RESIDUES])


def alphabet_test(spark, folder):
    """Which documents hold only residue letters as they stand."""
    from seqloom.catalog.bindings import table

    docs = table(spark, folder, "documents")
    return docs.select("doc_id", res.is_standard("text").alias("standard"),
                       res.is_standard(res.residues_of("text"), allow_empty=False).alias("cleaned_standard"))


def value_sets(spark, folder):
    """Common, joint and own 3-mers of every document and the one with the next id."""
    sets = sequences(spark, folder).select("doc_id", res.kmer_set("sequence", 3).alias("a"))
    following = sets.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return sets.join(following, "doc_id").select(
        "doc_id", F.size(F.array_intersect("a", "b")).alias("n_common"), F.size(F.array_union("a", "b")).alias("n_joint"),
        F.size(F.array_except("a", "b")).alias("n_own"),
    )


_FRACTIONS = ", ".join(f"{fraction('sequence', a)} AS \"aa_{a}\"" for a in RESIDUES)
_DENSITY = {
    m: f"100.0::DOUBLE * length(regexp_extract_all(sequence, '{p}')) / nullif(length(sequence), 0)"
    for m, p in CANONICAL_MOTIFS.items()
}
_KMERS3 = """sets AS (SELECT doc_id, list_distinct([sequence[i:i+2] for i in range(1, greatest(length(sequence) - 1, 1))]) AS a FROM seqs),
nxt AS (SELECT x.doc_id, x.a, y.a AS b FROM sets x JOIN sets y ON y.doc_id = x.doc_id + 1)"""
_COMPOSITION_SUM = " + ".join(fraction("sequence", a) for a in RESIDUES) + " + log10(length(sequence))"
_MOTIF_SUM = " + ".join(_DENSITY.values())
_PAIRS2 = f"""dp AS (SELECT doc_id, length(sequence) AS len, unnest([sequence[i:i+1] for i in range(1, length(sequence))]) AS dipeptide FROM seqs),
counts AS (SELECT doc_id, dipeptide, any_value(len) AS len, count(*) AS n FROM dp GROUP BY doc_id, dipeptide)"""

ENTRIES = {
    "residue_fractions": Entry(residue_fractions, with_(SEQS, f"SELECT doc_id, {_FRACTIONS} FROM seqs")),
    "structure_fractions": Entry(structure_fractions, with_(SEQS, f"""
SELECT doc_id, {fraction('sequence', HELIX_LEGACY)} AS frac_helix_legacy, {fraction('sequence', TURN_LEGACY)} AS frac_turn_legacy,
       {fraction('sequence', SHEET_LEGACY)} AS frac_sheet_legacy, {fraction('sequence', HELIX_CORRECTED)} AS frac_helix_corrected,
       {fraction('sequence', TURN_CORRECTED)} AS frac_turn_corrected, {fraction('sequence', SHEET_CORRECTED)} AS frac_sheet_corrected
FROM seqs""")),
    "composition_features": Entry(composition_features, with_(SEQS, f"""
SELECT doc_id, {_FRACTIONS}, log10(length(sequence)) AS log_length FROM seqs"""), ["log_length"]),
    "dipeptide_fractions": Entry(dipeptide_fractions, with_(f"{SEQS},\n{_PAIRS2}", """
SELECT doc_id, dipeptide, n, n / greatest(len - 1, 1) AS fraction FROM counts""")),
    "motif_density": Entry(motif_density, with_(SEQS, f"""
SELECT doc_id, {', '.join(f'{v} AS "motif_{m}"' for m, v in _DENSITY.items())} FROM seqs""")),
    "feature_matrix": Entry(feature_matrix, with_(SEQS, f"""
SELECT doc_id, 'composition' AS feature_set, 21::BIGINT AS n_features, {_COMPOSITION_SUM} AS total FROM seqs
UNION ALL
SELECT doc_id, 'composition+motifs', 26::BIGINT, {_COMPOSITION_SUM} + {_MOTIF_SUM} FROM seqs"""), ["total"]),
    "dipeptide_matrix": Entry(dipeptide_matrix, with_(f"{SEQS},\n{_PAIRS2}", f"""
SELECT doc_id, (instr('{RESIDUES}', dipeptide[1]) - 1) * 20 + instr('{RESIDUES}', dipeptide[2]) - 1 + 21 AS position,
       n / greatest(len - 1, 1) AS value FROM counts
UNION ALL
SELECT doc_id, a.i - 1, (length(sequence) - length(replace(sequence, a.letter, '')))::DOUBLE / length(sequence) FROM seqs,
  (SELECT i, '{RESIDUES}'[i] AS letter FROM range(1, 21) r(i)) a WHERE contains(sequence, a.letter)
UNION ALL
SELECT doc_id, 20, log10(length(sequence)) FROM seqs WHERE length(sequence) > 1"""), ["value"]),
    "kmer_sizes": Entry(kmer_sizes, with_(SEQS, """
SELECT doc_id, len(list_distinct([sequence[i:i+5] for i in range(1, greatest(length(sequence) - 4, 1))]))::BIGINT AS n_kmers FROM seqs""")),
    "mean_composition": Entry(mean_composition, with_(SEQS, f"""
SELECT lang, {', '.join(f'avg({fraction("sequence", a)}) AS "mean_{a}"' for a in RESIDUES)} FROM seqs WHERE sequence <> '' GROUP BY lang"""),
        [f"mean_{a}" for a in RESIDUES]),
    "alphabet_test": Entry(alphabet_test, with_(SEQS, f"""
SELECT doc_id, regexp_full_match(text, '[{RESIDUES}]*') AS standard, regexp_full_match(sequence, '[{RESIDUES}]+') AS cleaned_standard
FROM seqs JOIN documents USING (doc_id)""")),
    "value_sets": Entry(value_sets, with_(f"{SEQS},\n{_KMERS3}", """
SELECT doc_id, len(list_intersect(a, b))::BIGINT AS n_common, len(list_distinct(a || b))::BIGINT AS n_joint,
       (len(a) - len(list_intersect(a, b)))::BIGINT AS n_own FROM nxt""")),
}
