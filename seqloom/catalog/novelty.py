"""Exact and k-mer novelty, nearest neighbours, and what is built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.catalog.base import Entry
from seqloom.catalog.bindings import attempts, known, passages, pool, sequences
from seqloom.catalog.oracle import ATTEMPTS, POOL, SEED_SQL, SEQS, hex_draw, residues, with_
from seqloom.fixed import SEED
from seqloom.operators import pools, similarity
from seqloom.operators.agreement import literal_motifs, motif_position_table, profile_agreement, relative_gaps
from seqloom.operators.ranking import sample_per_group
from seqloom.plans import design, inference


def _candidates(spark, folder):
    return inference.design_rows(attempts(spark, folder)).where(F.col("status") == "parsed").select("attempt", "sequence")


def novel_flags(spark, folder):
    return similarity.flag_novel(_candidates(spark, folder), known(spark, folder)).select("attempt", "novel_exact")


def novel_candidates(spark, folder):
    return similarity.novel_only(_candidates(spark, folder), known(spark, folder)).select("attempt")


def known_candidates(spark, folder):
    return similarity.known_only(_candidates(spark, folder), known(spark, folder)).select("attempt")


def distinct_sequences(spark, folder):
    rows = similarity.distinct_sequences(sequences(spark, folder), "doc_id", "sequence")
    return rows.select("first_id", F.length("sequence").alias("length"))


def kmer_similarity(spark, folder):
    """Every document against the passages."""
    return similarity.max_similarity(sequences(spark, folder), passages(spark, folder), "doc_id")


def nearest_passages(spark, folder):
    return similarity.nearest_neighbours(sequences(spark, folder), passages(spark, folder), "doc_id", n=2)


def nearest_documents(spark, folder):
    """Every passage's two nearest documents."""
    return similarity.nearest_neighbours(passages(spark, folder), known(spark, folder), "known_id", n=2)


def nearest_other_documents(spark, folder):
    """Every document's nearest document of another text."""
    return similarity.nearest_neighbours(sequences(spark, folder), known(spark, folder), "doc_id", n=1)


def novelty_report(spark, folder):
    return similarity.novelty_report(sequences(spark, folder), passages(spark, folder), "doc_id")


def similarity_by_language(spark, folder):
    scores = similarity.max_similarity(sequences(spark, folder), passages(spark, folder), "doc_id")
    tagged = scores.join(sequences(spark, folder).select("doc_id", "lang"), "doc_id")
    return pools.similarity_summary(tagged, ["lang"], ["max_containment", "max_jaccard"])


def novel_sample(spark, folder):
    """Up to 150 novel candidates per set."""
    novel = pool(spark, folder).where(F.col("novel_exact"))
    return sample_per_group(novel, ["set"], "candidate_index", 150, F.lit(SEED)).select("set", "candidate_index", "length")


def sampled_similarity(spark, folder):
    """K-mer scores of the sampled novel candidates against all documents."""
    novel = pool(spark, folder).where(F.col("novel_exact"))
    sample = sample_per_group(novel, ["set"], "candidate_index", 150, F.lit(SEED)).select("set", "candidate_index", "sequence")
    scores = similarity.max_similarity(sample, known(spark, folder), "candidate_index")
    return sample.select("set", "candidate_index").join(scores, "candidate_index")


def _specimens(spark, folder):
    return design.best_with_neighbours(pool(spark, folder), known(spark, folder))


def best_specimens(spark, folder):
    return _specimens(spark, folder).select("set", "name", "role", F.length("sequence").alias("length"), "containment")


def specimen_gaps(spark, folder):
    return relative_gaps(design.described_specimens(_specimens(spark, folder)), "set")


def gap_matrix(spark, folder):
    """The relative gaps with one column per set."""
    gaps = relative_gaps(design.described_specimens(_specimens(spark, folder)), "set")
    return gaps.groupBy("descriptor").pivot("set", ["F1", "F2", "F3", "S1", "S2", "S3", "S4", "S5"]).agg(F.first("relative_gap"))


def specimen_motifs(spark, folder):
    return design.motif_specimens(_specimens(spark, folder)).select(
        "name", "set", "role", "length", *[f"count_{m}" for m in literal_motifs()]
    )


def specimen_positions(spark, folder):
    specimens = _specimens(spark, folder)
    positions = motif_position_table(specimens, ["name"], "sequence", literal_motifs())
    roles = specimens.select("name", "set", "role")
    return positions.join(roles, "name", "left").groupBy("name", "set", "role", "motif").agg(
        F.count("*").alias("n"), F.avg("relative_position").alias("mean_position")
    )


def motif_agreement(spark, folder):
    counts = design.motif_specimens(_specimens(spark, folder))
    return profile_agreement(counts, "set", list(literal_motifs()))


_PASSAGES = f"passages AS MATERIALIZED (SELECT item_id AS known_id, {residues('text')} AS sequence FROM benchmark)"


def _kmers(name: str, source: str, key: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT {key}, k, count(*) OVER (PARTITION BY {key}) AS n FROM (
    SELECT DISTINCT {key}, unnest([sequence[i:i+5] for i in range(1, length(sequence) - 4)]) AS k FROM {source} WHERE length(sequence) >= 6))"""


def _overlaps(queries: str, query_key: str, references: str, ref_key: str) -> str:
    """CTEs with the shared k-mers of every pair that has any; references are distinct sequences."""
    return f"""refs AS MATERIALIZED (SELECT min({ref_key}) AS ref_id, sequence FROM {references} GROUP BY sequence),
{_kmers('qk', queries, query_key)},
{_kmers('rk', 'refs', 'ref_id')},
shared AS MATERIALIZED (SELECT qk.{query_key}, ref_id, count(*) AS shared, any_value(qk.n) AS nq, any_value(rk.n) AS nr FROM qk JOIN rk USING (k) GROUP BY ALL)"""


def _best(queries: str, key: str) -> str:
    return f"""
SELECT {key}, length(sequence) AS length, CASE WHEN length(sequence) >= 6 THEN coalesce(c, 0.0) END AS max_containment,
       CASE WHEN length(sequence) >= 6 THEN coalesce(j, 0.0) END AS max_jaccard
FROM {queries} LEFT JOIN (SELECT {key}, max(shared / nq) AS c, max(shared / (nq + nr - shared)) AS j FROM shared GROUP BY {key}) USING ({key})"""


def _nearest(queries: str, key: str, n: int = 2) -> str:
    return f"""
SELECT {key}, neighbour, ref_id, containment FROM (
  SELECT s.{key}, s.ref_id, shared / nq AS containment, row_number() OVER (PARTITION BY s.{key} ORDER BY shared DESC, s.ref_id) AS neighbour
  FROM shared s JOIN {queries} q ON q.{key} = s.{key} JOIN refs r ON r.ref_id = s.ref_id WHERE q.sequence <> r.sequence)
WHERE neighbour <= {n}"""


_PARSED = "(SELECT attempt, sequence FROM parsed WHERE status = 'parsed')"
_SAMPLE = f"""{POOL},
sample AS MATERIALIZED (SELECT * FROM (
  SELECT "set", candidate_index, length, sequence,
         row_number() OVER (PARTITION BY "set" ORDER BY {hex_draw(SEED_SQL, 'candidate_index')}, candidate_index) AS rank
  FROM pool WHERE novel_exact) WHERE rank <= 150)"""
_DOC_PASSAGES = f"{SEQS},\n{_PASSAGES},\n" + _overlaps("seqs", "doc_id", "passages", "known_id")

ENTRIES = {
    "novel_flags": Entry(novel_flags, with_(ATTEMPTS, f"SELECT attempt, sequence NOT IN (SELECT sequence FROM seqs) AS novel_exact FROM {_PARSED}")),
    "novel_candidates": Entry(novel_candidates, with_(ATTEMPTS, f"SELECT attempt FROM {_PARSED} p ANTI JOIN seqs USING (sequence)")),
    "known_candidates": Entry(known_candidates, with_(ATTEMPTS, f"SELECT attempt FROM {_PARSED} p SEMI JOIN seqs USING (sequence)")),
    "distinct_sequences": Entry(distinct_sequences, with_(SEQS, """
SELECT min(doc_id) AS first_id, any_value(length(sequence)) AS length FROM seqs GROUP BY sequence""")),
    "kmer_similarity": Entry(kmer_similarity, with_(_DOC_PASSAGES, _best("seqs", "doc_id"))),
    "nearest_passages": Entry(nearest_passages, with_(_DOC_PASSAGES, _nearest("seqs", "doc_id"))),
    "nearest_documents": Entry(nearest_documents, with_(
        f"{SEQS},\n{_PASSAGES},\n" + _overlaps("passages", "known_id", "seqs", "doc_id"), _nearest("passages", "known_id"))),
    "nearest_other_documents": Entry(nearest_other_documents, with_(
        f"{SEQS},\n" + _overlaps("seqs", "doc_id", "seqs", "doc_id"), _nearest("seqs", "doc_id", 1))),
    "novelty_report": Entry(novelty_report, with_(_DOC_PASSAGES, f"""
SELECT doc_id, length, sequence NOT IN (SELECT sequence FROM passages) AS novel_exact, max_jaccard AS max_jaccard_k6,
       max_containment AS max_containment_k6 FROM ({_best('seqs', 'doc_id')}) JOIN seqs USING (doc_id)""")),
    "similarity_by_language": Entry(similarity_by_language, with_(_DOC_PASSAGES, "SELECT lang, " + ", ".join(
        f"round({f.format(c)}, 3) AS {c}_{name}" for c in ("max_containment", "max_jaccard")
        for name, f in (("mean", "avg({})"), ("median", "quantile_cont({}, 0.5)"), ("max", "max({})"))
    ) + f" FROM ({_best('seqs', 'doc_id')}) JOIN seqs USING (doc_id) GROUP BY lang")),
    "novel_sample": Entry(novel_sample, with_(_SAMPLE, 'SELECT "set", candidate_index, length FROM sample')),
    "sampled_similarity": Entry(sampled_similarity, with_(
        f"{_SAMPLE},\n" + _overlaps("sample", "candidate_index", "seqs", "doc_id"),
        f'SELECT "set", b.* FROM ({_best("sample", "candidate_index")}) b JOIN sample USING (candidate_index)')),
    "best_specimens": Entry(best_specimens, with_(f"""{POOL},
best AS MATERIALIZED (SELECT "set", arg_max(sequence, (r2, -candidate_index)) AS sequence FROM scored GROUP BY "set"),
""" + _overlaps("best", '"set"', "seqs", "doc_id"), f"""
SELECT "set", "set" || '_gen' AS name, 'generated' AS role, length(sequence) AS length, NULL::DOUBLE AS containment FROM best
UNION ALL
SELECT "set", "set" || '_nb' || neighbour, 'neighbour' || neighbour, length(sequence), containment
FROM ({_nearest('best', '"set"')}) JOIN refs USING (ref_id)""")),
    "specimen_gaps": Entry(specimen_gaps),
    "gap_matrix": Entry(gap_matrix),
    "specimen_motifs": Entry(specimen_motifs),
    "specimen_positions": Entry(specimen_positions),
    "motif_agreement": Entry(motif_agreement),
}
