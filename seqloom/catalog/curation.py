"""Joins, filters, normalisation and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.catalog.base import Entry
from seqloom.catalog.bindings import measurements, normalised_pairs, pairs, sequences, table
from seqloom.catalog.oracle import COMPLETE, MEAS, NORMALISED, PAIRS, SEQS, slot_name, slots, with_
from seqloom.fixed import PROPERTIES, TARGETS
from seqloom.functions.residues import is_standard
from seqloom.operators import curation as cur
from seqloom.operators.ranking import top_per_group

_PROPS = ", ".join(f'"{p}"' for p in PROPERTIES)


def curated_pairs(spark, folder):
    return pairs(spark, folder).select("doc_id", "idv_id", "type", "family_group", *PROPERTIES)


def row_funnel(spark, folder):
    return cur.row_funnel(sequences(spark, folder), measurements(spark, folder), "src1")


def renamed_overlap(spark, folder):
    """Sequences and customers both carry a `source`-like column; the right one gets a prefix."""
    left = sequences(spark, folder).select("idv_id", "doc_id", F.col("lang").alias("segment"))
    right = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("idv_id"), F.col("c_mktsegment").alias("segment")
    )
    return left.join(cur.prefixed_overlap(right, left, "idv_id"), "idv_id")


def part_families(spark, folder):
    parts = table(spark, folder, "part").withColumn("family_group", cur.family_group("p_type", ["S", "ST", "ECO", "PRO"]))
    return parts.groupBy("p_type", "family_group").agg(F.count("*").alias("n"))


def type_prefix_filter(spark, folder):
    return cur.type_subset(sequences(spark, folder), "src1").groupBy("type").agg(F.count("*").alias("n"))


def exact_type_filter(spark, folder):
    return sequences(spark, folder).where(F.col("lang") == "en").groupBy("source").agg(F.count("*").alias("n"))


def usable_sequences(spark, folder):
    usable = F.length("sequence").between(200, 700) & is_standard("sequence")
    return sequences(spark, folder).where(usable).select("doc_id", F.length("sequence").alias("length"))


def groups_of_size(spark, folder):
    """Sources with at least ten rows, 'other' left out."""
    grouped = pairs(spark, folder).where(F.col("family_group") != "other").groupBy("family_group", "lang")
    return grouped.agg(F.count("*").alias("n")).where(F.col("n") >= 10)


def first_rows(spark, folder):
    return sequences(spark, folder).orderBy("doc_id").limit(25).select("doc_id", F.length("sequence").alias("length"))


def normalisation_bounds(spark, folder):
    return cur.bounds_table(cur.normalisation_bounds(pairs(spark, folder)))


def normalised_targets(spark, folder):
    return normalised_pairs(spark, folder).select(
        "doc_id", *[F.col("target")[i].alias(f"true_{p}") for i, p in enumerate(PROPERTIES)]
    )


def normalisation_check(spark, folder):
    return cur.normalisation_check(normalised_pairs(spark, folder))


def denormalised(spark, folder):
    """Normalising and back reproduces the measurement."""
    complete = pairs(spark, folder)
    bounds = cur.normalisation_bounds(complete)
    back = cur.with_denormalised(cur.with_normalised(complete, bounds), bounds, "target")
    return back.select("doc_id", *[F.col("raw")[i].alias(p) for i, p in enumerate(PROPERTIES)])


def anchor_check(spark, folder):
    """Every pair against the first target vector, with the largest error and the verdict."""
    expected = F.array(*[F.lit(x) for x in TARGETS["F1"][0]])
    rows = normalised_pairs(spark, folder).withColumn("expected", expected)
    return cur.anchor_check(rows, "target", "expected", 0.5).select("doc_id", "max_abs_error", "passed")


def label_counts(spark, folder):
    return cur.value_counts(pairs(spark, folder), "family_group")


def duplicate_audit(spark, folder):
    return cur.duplicate_audit(sequences(spark, folder))


def sequence_copies(spark, folder):
    return cur.with_copies(sequences(spark, folder)).select("doc_id", "n_copies")


def length_stats(spark, folder):
    return cur.length_stats(sequences(spark, folder), ["lang"])


def length_landmarks(spark, folder):
    """Shortest, quartile, median and longest sequence of every language, by rank over length."""
    from seqloom.operators.ranking import cumulative_counts

    lengths = sequences(spark, folder).select("lang", F.length("sequence").alias("length"))
    counts = cumulative_counts(lengths, ["lang"], "length")
    total = F.col("total")

    def at(rank):
        return F.min(F.when(F.col("upto") > rank, F.col("length"))).cast("bigint")

    return counts.groupBy("lang").agg(
        at(F.lit(0)).alias("shortest"), at(F.floor(total / 4)).alias("quarter"), at(F.floor(total / 2)).alias("half"),
        at(total - 1).alias("longest"),
    )


def longest_per_source(spark, folder):
    rows = sequences(spark, folder).select("source", "doc_id", F.length("sequence").alias("length"))
    return top_per_group(rows, ["source"], [F.desc("length"), F.asc("doc_id")], 3)


def record_lookup(spark, folder):
    """Records whose length is the longest of their individual."""
    rows = sequences(spark, folder)
    wanted = rows.groupBy("idv_id").agg(F.max(F.length("sequence")).alias("length"))
    return cur.record_lookup(rows, wanted).select("doc_id", "idv_id", "length")


_NORM_COLUMNS = ", ".join(f'target[{i + 1}] AS "true_{p}"' for i, p in enumerate(PROPERTIES))
_F1 = f"{TARGETS['F1'][0]}::DOUBLE[]"

ENTRIES = {
    "curated_pairs": Entry(
        curated_pairs, with_(PAIRS, f"SELECT doc_id, idv_id, type, family_group, {_PROPS} FROM pairs"), PROPERTIES
    ),
    "row_funnel": Entry(row_funnel, with_(f"{SEQS}, {MEAS}", f"""
SELECT (SELECT count(*) FROM seqs) AS n_sequences,
       (SELECT count(*) FROM seqs JOIN meas USING (idv_id)) AS n_joined,
       (SELECT count(*) FROM seqs JOIN meas USING (idv_id) WHERE {COMPLETE}) AS n_complete,
       (SELECT count(*) FROM seqs JOIN meas USING (idv_id) WHERE {COMPLETE} AND starts_with(type, 'src1')) AS n_selected,
       (SELECT count(*) FROM meas) AS n_measurements""")),
    "renamed_overlap": Entry(renamed_overlap, with_(SEQS, """
SELECT idv_id, doc_id, lang AS segment, c_mktsegment AS mech_segment FROM seqs JOIN customer ON c_custkey = idv_id""")),
    "part_families": Entry(part_families, """
SELECT p_type, CASE WHEN p_type LIKE 'S%' THEN 'S' WHEN p_type LIKE 'ST%' THEN 'ST' WHEN p_type LIKE 'ECO%' THEN 'ECO'
       WHEN p_type LIKE 'PRO%' THEN 'PRO' ELSE 'other' END AS family_group, count(*) AS n
FROM part GROUP BY ALL"""),
    "type_prefix_filter": Entry(type_prefix_filter, "SELECT source AS type, count(*) AS n FROM documents WHERE starts_with(source, 'src1') GROUP BY source"),
    "exact_type_filter": Entry(exact_type_filter, "SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY source"),
    "usable_sequences": Entry(usable_sequences, with_(SEQS, "SELECT doc_id, length(sequence) AS length FROM seqs WHERE length(sequence) BETWEEN 200 AND 700")),
    "groups_of_size": Entry(groups_of_size, with_(PAIRS, """
SELECT family_group, lang, count(*) AS n FROM pairs WHERE family_group <> 'other' GROUP BY ALL HAVING count(*) >= 10""")),
    "first_rows": Entry(first_rows, with_(SEQS, "SELECT doc_id, length(sequence) AS length FROM seqs ORDER BY doc_id LIMIT 25")),
    "normalisation_bounds": Entry(normalisation_bounds, with_(PAIRS, "\nUNION ALL ".join(
        f"""SELECT '{p}' AS property, min("{p}") AS low, max("{p}") AS high FROM pairs""" for p in PROPERTIES
    )), ["low", "high"]),
    "normalised_targets": Entry(
        normalised_targets, with_(NORMALISED, f"SELECT doc_id, {_NORM_COLUMNS} FROM norm"), [f"true_{p}" for p in PROPERTIES]
    ),
    "normalisation_check": Entry(normalisation_check, with_(NORMALISED, f"""
SELECT {slot_name('slot')} AS property, min(target) AS min_value, max(target) AS max_value,
       count(*) FILTER (WHERE target < 0) AS n_below_zero, count(*) FILTER (WHERE target > 1) AS n_above_one,
       bool_and(target BETWEEN 0 AND 1) AS in_unit_interval
FROM {slots('norm', 'target')} GROUP BY slot"""), ["min_value", "max_value"]),
    "denormalised": Entry(denormalised, with_(PAIRS, f"SELECT doc_id, {_PROPS} FROM pairs"), PROPERTIES),
    "anchor_check": Entry(anchor_check, with_(NORMALISED, f"""
SELECT *, max_abs_error < 0.5 AS passed FROM (
  SELECT doc_id, list_max([abs(z[1] - z[2]) for z in list_zip(target, {_F1})]) AS max_abs_error FROM norm)"""),
        ["max_abs_error"]),
    "label_counts": Entry(label_counts, with_(PAIRS, "SELECT family_group, count(*) AS n FROM pairs GROUP BY ALL")),
    "duplicate_audit": Entry(duplicate_audit, with_(SEQS, """
SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_distinct, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS n_duplicate_rows
FROM (SELECT count(*) AS n FROM seqs GROUP BY sequence)""")),
    "sequence_copies": Entry(sequence_copies, with_(SEQS, "SELECT doc_id, count(*) OVER (PARTITION BY sequence) AS n_copies FROM seqs")),
    "length_stats": Entry(length_stats, with_(SEQS, """
SELECT lang, count(*) AS n, min(length(sequence)) AS min_length, max(length(sequence)) AS max_length,
       floor(quantile_cont(length(sequence)::DOUBLE, 0.5))::BIGINT AS median_length FROM seqs GROUP BY lang""")),
    "length_landmarks": Entry(length_landmarks, with_(SEQS, """
SELECT lang, l[1] AS shortest, l[1 + len(l) // 4] AS quarter, l[1 + len(l) // 2] AS half, l[len(l)] AS longest
FROM (SELECT lang, list(length(sequence) ORDER BY length(sequence)) AS l FROM seqs GROUP BY lang)""")),
    "longest_per_source": Entry(longest_per_source, with_(SEQS, """
SELECT * FROM (SELECT source, doc_id, length(sequence) AS length,
  row_number() OVER (PARTITION BY source ORDER BY length(sequence) DESC, doc_id) AS rank FROM seqs) WHERE rank <= 3""")),
    "record_lookup": Entry(record_lookup, with_(SEQS, """
SELECT doc_id, idv_id, length(sequence) AS length FROM seqs
WHERE (idv_id, length(sequence)) IN (SELECT (idv_id, max(length(sequence))) FROM seqs GROUP BY idv_id)""")),
}
