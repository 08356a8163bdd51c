"""Group comparison of residues between extreme individuals, and its permutation null."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.catalog.base import Entry
from seqloom.catalog.bindings import pairs
from seqloom.catalog.oracle import PAIRS, SEED_SQL, fraction, hex_draw, with_
from seqloom.fixed import MECHANICAL, PROPERTIES, REPORTED_RESIDUES, RESIDUES, SCHEMES
from seqloom.functions.descriptors import with_descriptors
from seqloom.functions.residues import letter_count
from seqloom.operators import association as assoc
from seqloom.operators.agreement import literal_motifs, profile_agreement, relative_gaps, with_motif_counts


def individuals(spark, folder):
    people = assoc.individuals(pairs(spark, folder))
    return people.select("idv_id", "n_sequences", *PROPERTIES, *(F.col("fraction_sums")[i].alias(f"sum_{a}") for i, a in enumerate(RESIDUES)))


def extreme_individuals(spark, folder):
    return assoc.extremes(assoc.individuals(pairs(spark, folder)), 10).select(
        "property", "side", "rank", "idv_id", "value", "n_sequences"
    )


def end_compositions(spark, folder):
    ends = assoc.extremes(assoc.individuals(pairs(spark, folder)), 10)
    return assoc.mean_composition(ends, ["property", "side"])


def composition_difference(spark, folder):
    return assoc.associate(pairs(spark, folder))


def selected_residues(spark, folder):
    return assoc.select_residues(assoc.associate(pairs(spark, folder))).select("property", "scheme", "residue_group", "residue")


def residue_votes(spark, folder):
    return assoc.residue_votes(assoc.select_residues(assoc.associate(pairs(spark, folder))))


def scheme_agreement(spark, folder):
    return assoc.scheme_agreement(residue_votes(spark, folder), *SCHEMES)


def permutation_report(spark, folder):
    null = assoc.null_overlaps(spark, assoc.schemes_table(spark))
    return assoc.permutation_report(residue_votes(spark, folder), null)


def scheme_composition(spark, folder):
    """Share of every residue group under both schemes, per language: the schemes' differences at work."""
    counted = pairs(spark, folder).select("lang", *[letter_count("sequence", a).alias(a) for a in RESIDUES])
    letters = F.array(*[F.struct(F.lit(a).alias("residue"), F.col(a).alias("n")) for a in RESIDUES])
    totals = counted.select("lang", F.explode(letters).alias("e")).groupBy("lang", "e.residue").agg(F.sum("e.n").alias("n"))
    return totals.join(F.broadcast(assoc.schemes_table(spark)), "residue").groupBy("lang", "scheme", "residue_group").agg(
        F.sum("n").alias("n_residues")
    )


def disputed_residues(spark, folder):
    """Occurrences of the residues that the two schemes class differently."""
    differing = assoc.scheme_differences(assoc.schemes_table(spark), *SCHEMES)
    letters = F.array(*[F.struct(F.lit(a).alias("residue"), letter_count("sequence", a).alias("n")) for a in RESIDUES])
    counts = pairs(spark, folder).select(F.explode(letters).alias("e")).groupBy("e.residue").agg(F.sum("e.n").alias("n"))
    return counts.join(F.broadcast(differing), "residue")


def segment_gaps(spark, folder):
    """Relative gap between the long and the short end of a group, descriptor by descriptor: every
    language's first document against the rest."""
    described = with_descriptors(pairs(spark, folder).select("doc_id", "lang", "sequence"), percentages=False)
    first = described.groupBy("lang").agg(F.min("doc_id").alias("_first"))
    roles = described.join(first, "lang").withColumn(
        "role", F.when(F.col("doc_id") == F.col("_first"), "generated").otherwise("neighbour1")
    )
    return relative_gaps(roles, "lang")


def segment_profiles(spark, folder):
    """Motif-density agreement of every source's first document with the source's others."""
    counts = with_motif_counts(pairs(spark, folder).select("doc_id", "source", "sequence"), "sequence", literal_motifs())
    first = counts.groupBy("source").agg(F.min("doc_id").alias("_first"))
    roles = counts.join(first, "source").withColumn(
        "role", F.when(F.col("doc_id") == F.col("_first"), "generated").otherwise("neighbour1")
    )
    return profile_agreement(roles, "source", list(literal_motifs()))


_SUMS = ", ".join(f"sum({fraction('sequence', a)}) AS s{a}" for a in RESIDUES)
_PEOPLE = f"""{PAIRS},
people AS MATERIALIZED (
  SELECT idv_id, count(*) AS n_sequences, {', '.join(f'arg_min("{p}", doc_id) AS "{p}"' for p in PROPERTIES)}, {_SUMS}
  FROM pairs WHERE sequence <> '' GROUP BY idv_id)"""
_ENDS = f"""{_PEOPLE},
long AS (""" + "\nUNION ALL ".join(f"""SELECT '{p}' AS property, "{p}" AS value, * FROM people""" for p in MECHANICAL) + """),
ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY property ORDER BY value, idv_id) AS low,
         row_number() OVER (PARTITION BY property ORDER BY value DESC, idv_id DESC) AS high FROM long),
ends AS MATERIALIZED (
  SELECT 'bottom' AS side, low AS rank, * FROM ranked WHERE low <= 10 UNION ALL SELECT 'top', high, * FROM ranked WHERE high <= 10)"""
_COMPOSED = f"""{_ENDS},
composed AS MATERIALIZED (""" + "\nUNION ALL ".join(
    f"SELECT property, side, '{a}' AS residue, sum(s{a}) / sum(n_sequences) AS fraction FROM ends GROUP BY ALL" for a in RESIDUES
) + ")"
SCHEMES_SQL = "schemes(scheme, residue_group, residue) AS (VALUES " + ", ".join(
    f"('{s}', '{g}', '{a}')" for s, groups in SCHEMES.items() for g, members in groups.items() for a in members
) + ")"
_DIFF = f"""{_COMPOSED},
{SCHEMES_SQL},
sides AS (SELECT property, residue, max(fraction) FILTER (WHERE side = 'top') AS c_top, max(fraction) FILTER (WHERE side = 'bottom') AS c_bottom
          FROM composed GROUP BY ALL),
diff AS MATERIALIZED (SELECT *, CASE WHEN m > 0 THEN abs_diff / nullif(m, 0) ELSE 0.0 END AS c_diff FROM (
  SELECT *, max(abs_diff) OVER (PARTITION BY property, scheme, residue_group) AS m FROM (
    SELECT property, scheme, residue_group, residue, c_top, c_bottom, abs(c_bottom - c_top) AS abs_diff FROM sides JOIN schemes USING (residue)))),
selected AS MATERIALIZED (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY property, scheme, residue_group ORDER BY c_diff DESC, residue) AS rank FROM diff) WHERE rank <= 2),
votes AS MATERIALIZED (SELECT scheme, residue, count(*) AS n_properties, count(*) >= 2 AS chosen FROM selected GROUP BY ALL)"""
_A, _B = SCHEMES
_MINE = "SELECT coalesce(string_agg(residue, '' ORDER BY residue), '') FROM votes WHERE chosen AND scheme = '{a}' AND residue {op} (SELECT residue FROM votes WHERE chosen AND scheme = '{b}')"
_REPORTED = "(" + ", ".join(f"'{a}'" for a in REPORTED_RESIDUES) + ")"

ENTRIES = {
    "individuals": Entry(individuals, with_(_PEOPLE, 'SELECT idv_id, n_sequences, ' + ", ".join(f'"{p}"' for p in PROPERTIES) + ", " + ", ".join(f's{a} AS "sum_{a}"' for a in RESIDUES) + " FROM people"),
                         [*PROPERTIES, *(f"sum_{a}" for a in RESIDUES)]),
    "extreme_individuals": Entry(extreme_individuals, with_(_ENDS, "SELECT property, side, rank, idv_id, value, n_sequences FROM ends"), ["value"]),
    "end_compositions": Entry(end_compositions, with_(_COMPOSED, "SELECT * FROM composed"), ["fraction"]),
    "composition_difference": Entry(composition_difference, with_(_DIFF, """
SELECT property, scheme, residue_group, residue, c_top, c_bottom, abs_diff, c_diff FROM diff"""), ["c_top", "c_bottom", "abs_diff", "c_diff"]),
    "selected_residues": Entry(selected_residues, with_(_DIFF, "SELECT property, scheme, residue_group, residue FROM selected")),
    "residue_votes": Entry(residue_votes, with_(_DIFF, "SELECT * FROM votes")),
    "scheme_agreement": Entry(scheme_agreement, with_(_DIFF, f"""
SELECT ({_MINE.format(a=_A, b=_B, op='IN')}) AS agreed, ({_MINE.format(a=_A, b=_B, op='NOT IN')}) AS first_only,
       ({_MINE.format(a=_B, b=_A, op='NOT IN')}) AS second_only""")),
    "permutation_report": Entry(permutation_report, with_(f"""{_DIFF},
noise AS (SELECT r AS replicate, property, scheme, residue_group, residue, {hex_draw(SEED_SQL, 'r', 'property', 'residue')} AS h
          FROM range(2000) t(r), (VALUES {', '.join(f"('{p}')" for p in MECHANICAL)}) AS p(property), schemes),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY replicate, property, scheme, residue_group ORDER BY h DESC) AS rank FROM noise) WHERE rank <= 2),
kept AS (SELECT scheme, replicate, residue FROM picked GROUP BY ALL HAVING count(*) >= 2),
per AS (SELECT every.scheme, r AS replicate, count(residue) AS n_selected, count(residue) FILTER (WHERE residue IN {_REPORTED}) AS n_overlap
        FROM (SELECT DISTINCT scheme FROM schemes) every CROSS JOIN range(2000) t(r) LEFT JOIN kept ON kept.replicate = r AND kept.scheme = every.scheme GROUP BY ALL),
obs AS (SELECT scheme, count(*) FILTER (WHERE chosen) AS observed_n_selected,
               count(*) FILTER (WHERE chosen AND residue IN {_REPORTED}) AS observed_overlap FROM votes GROUP BY scheme)""", """
SELECT scheme, any_value(observed_overlap) AS observed_overlap, any_value(observed_n_selected) AS observed_n_selected,
       avg(n_overlap) AS null_overlap_mean, avg(n_selected) AS null_n_selected_mean, avg((n_overlap >= observed_overlap)::INT) AS p_value,
       quantile_cont(n_overlap::DOUBLE, 0.05) AS null_overlap_p5, quantile_cont(n_overlap::DOUBLE, 0.95) AS null_overlap_p95
FROM per JOIN obs USING (scheme) GROUP BY scheme"""),
        ["null_overlap_mean", "null_n_selected_mean", "p_value", "null_overlap_p5", "null_overlap_p95"]),
    "scheme_composition": Entry(scheme_composition, with_(f"{PAIRS},\n{SCHEMES_SQL}", """
SELECT lang, scheme, residue_group, sum(length(sequence) - length(replace(sequence, residue, '')))::BIGINT AS n_residues
FROM pairs, schemes GROUP BY ALL""")),
    "disputed_residues": Entry(disputed_residues, with_(f"{PAIRS},\n{SCHEMES_SQL}", f"""
SELECT residue, sum(length(sequence) - length(replace(sequence, residue, '')))::BIGINT AS n, any_value(a.residue_group) AS first_group, any_value(b.residue_group) AS second_group
FROM pairs, (SELECT * FROM schemes WHERE scheme = '{_A}') a JOIN (SELECT * FROM schemes WHERE scheme = '{_B}') b USING (residue)
WHERE a.residue_group <> b.residue_group GROUP BY residue""")),
    "segment_gaps": Entry(segment_gaps),
    "segment_profiles": Entry(segment_profiles),
}
