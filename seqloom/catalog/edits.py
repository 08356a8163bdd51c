"""Seeded sequence edits over whole sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.catalog.base import Entry
from seqloom.catalog.bindings import sequences
from seqloom.catalog.oracle import SEED_SQL, SEQS, hex_draw, int_draw, with_
from seqloom.fixed import CANONICAL_MOTIFS, KNOCKOUT_MOTIFS, RESIDUES, SEED
from seqloom.functions import edits as ed

# A pattern that the supplied texts contain often.
FREQUENT = "(?:TH|ER)+"


def _edited(edit):
    def query(spark, folder):
        return sequences(spark, folder).select("doc_id", edit(F.col("sequence"), F.col("doc_id")).alias("edited"))

    return query


def knockout_delete(spark, folder):
    return sequences(spark, folder).select(
        "doc_id", ed.knockout_delete("sequence", FREQUENT).alias("edited"),
        ed.matched_residues("sequence", FREQUENT).alias("n_removed"),
    )


def point_mutation(spark, folder):
    out = sequences(spark, folder).select("doc_id", ed.point_mutation("sequence", SEED, F.col("doc_id")).alias("m"))
    return out.select("doc_id", F.col("m.edited").alias("edited"), F.col("m.position").alias("position"))


def edit_panel(spark, folder):
    panel = ed.edit_panel(sequences(spark, folder).select("doc_id", "sequence"), "sequence", "doc_id", SEED)
    return panel.select("doc_id", "ablation", F.length("edited").alias("edit_length"), "n_changed", F.md5("edited").alias("digest"))


def edit_panel_counts(spark, folder):
    panel = ed.edit_panel(sequences(spark, folder).select("doc_id", "sequence"), "sequence", "doc_id", SEED)
    return panel.groupBy("ablation").agg(F.count("*").alias("n"), F.sum("n_changed").alias("n_changed"))


def _removed(seq, row):
    return ed.matched_residues(seq, FREQUENT)


def _quote(text: str) -> str:
    return f"'{text}'"


# One row per residue, with its 0-based position.
_CHARS = f"""{SEQS},
chars AS MATERIALIZED (
  SELECT doc_id, unnest(string_split(sequence, '')) AS c, unnest(range(length(sequence))) AS i FROM seqs WHERE sequence <> '')"""


def _collected(order: str, source: str, value: str = "c") -> str:
    """Residues joined back; documents without any give an empty text."""
    return (
        f"SELECT doc_id, coalesce(edited, '') AS edited FROM seqs LEFT JOIN "
        f"(SELECT doc_id, string_agg({value}, '' ORDER BY {order}) AS edited FROM ({source}) GROUP BY doc_id) USING (doc_id)"
    )


_REMOVED_CTE = f"""{_CHARS},
removed AS MATERIALIZED (SELECT doc_id, sequence, length(sequence) AS n, length(sequence) - length(regexp_replace(sequence, '{FREQUENT}', '', 'g')) AS r FROM seqs)"""
_PEERS = " ".join(f"WHEN '{a}' THEN '{p}'" for a, p in sorted(ed.conservative_peers().items()))
_MARKED = f"""{_CHARS},
pieces AS (
  SELECT doc_id, unnest(regexp_split_to_array(sequence, '{FREQUENT}')) AS g,
         unnest(regexp_extract_all(sequence, '{FREQUENT}') || ['']) AS m,
         unnest(range(len(regexp_extract_all(sequence, '{FREQUENT}')) + 1)) AS k FROM seqs),
masked AS (SELECT doc_id, string_agg(g || repeat('#', length(m)), '' ORDER BY k) AS m FROM pieces GROUP BY doc_id),
spots AS (
  SELECT doc_id, unnest(string_split(m, '')) AS mc, unnest(range(length(m))) AS i, length(m) AS n FROM masked WHERE m <> ''),
draws AS (SELECT *, {int_draw(SEED_SQL, 'doc_id', _quote('fill'), 'i')} % n AS source FROM spots),
filled AS (
  SELECT d.doc_id, d.i, CASE WHEN mc = '#' THEN c.c ELSE mc END AS c FROM draws d
  JOIN chars c ON c.doc_id = d.doc_id AND c.i = d.source)"""
_PANEL_COUNTS = "\nUNION ALL ".join(
    [f"SELECT '{name}' AS ablation, count(*) AS n, sum(length(sequence))::BIGINT AS n_changed FROM seqs WHERE sequence <> ''"
     for name in ("shuffle", "shuffle_blocks", "reverse", "random_matched")]
    + [f"SELECT '{kind}_{m}', count(*), sum(r)::BIGINT FROM (SELECT length(sequence) AS n, length(sequence) - length(regexp_replace(sequence, "
       f"'{CANONICAL_MOTIFS[m]}', '', 'g')) AS r FROM seqs) WHERE r > 0 AND ('{kind}' <> 'knockout' OR r < n) HAVING count(*) > 0"
       for m in KNOCKOUT_MOTIFS for kind in ("knockout", "scattered_control", "block_control", "substitute")]
    + ["SELECT 'termini_only', count(*), sum(length(sequence) - 230)::BIGINT FROM seqs WHERE length(sequence) > 230",
       "SELECT 'core_only', count(*), (count(*) * 230)::BIGINT FROM seqs WHERE length(sequence) > 230",
       "SELECT 'point_mutation', count(*), count(*) FROM seqs WHERE sequence <> ''"]
)

ENTRIES = {
    "shuffle_residues": Entry(_edited(lambda s, k: ed.shuffle_residues(s, SEED, k)), with_(
        _CHARS, _collected(f"{hex_draw(SEED_SQL, 'doc_id', _quote('shuffle'), 'i')}, i", "SELECT * FROM chars"))),
    "shuffle_blocks": Entry(_edited(lambda s, k: ed.shuffle_blocks(s, SEED, k)), with_(f"""{SEQS},
blocks AS (SELECT doc_id, unnest(regexp_extract_all(sequence, '.{{1,20}}')) AS c, unnest(range((length(sequence) + 19) // 20)) AS i FROM seqs WHERE sequence <> '')""",
        _collected(f"{hex_draw(SEED_SQL, 'doc_id', _quote('blocks'), 'i')}, i", "SELECT * FROM blocks"))),
    "reverse_sequence": Entry(_edited(lambda s, k: ed.reverse_sequence(s)), with_(SEQS, "SELECT doc_id, reverse(sequence) AS edited FROM seqs")),
    "knockout_delete": Entry(knockout_delete, with_(_REMOVED_CTE, f"""
SELECT doc_id, regexp_replace(sequence, '{FREQUENT}', '', 'g') AS edited, r AS n_removed FROM removed""")),
    "scattered_deletion": Entry(
        _edited(lambda s, k: ed.scattered_deletion(s, _removed(s, k), SEED, k)), with_(f"""{_REMOVED_CTE},
ranked AS (SELECT doc_id, c, i, r, n, row_number() OVER (PARTITION BY doc_id ORDER BY {hex_draw(SEED_SQL, 'doc_id', _quote('scatter'), 'i')}, i) AS rank
           FROM chars JOIN removed USING (doc_id))""",
            _collected("i", "SELECT * FROM ranked WHERE r <= 0 OR r >= n OR rank > r"))),
    "block_deletion": Entry(_edited(lambda s, k: ed.block_deletion(s, _removed(s, k), SEED, k)), with_(f"""{_REMOVED_CTE},
starts AS (SELECT *, {int_draw(SEED_SQL, 'doc_id', _quote('block'))} % (n - r + 1) AS start FROM removed)""", """
SELECT doc_id, CASE WHEN r > 0 AND r < n THEN left(sequence, start) || substr(sequence, start + r + 1) ELSE sequence END AS edited FROM starts""")),
    "knockout_substitute": Entry(_edited(lambda s, k: ed.knockout_substitute(s, FREQUENT, SEED, k)), with_(
        _MARKED, _collected("i", "SELECT * FROM filled"))),
    "keep_termini": Entry(_edited(lambda s, k: ed.keep_termini(s)), with_(SEQS, """
SELECT doc_id, CASE WHEN length(sequence) <= 230 THEN sequence ELSE left(sequence, 130) || right(sequence, 100) END AS edited FROM seqs""")),
    "keep_core": Entry(_edited(lambda s, k: ed.keep_core(s)), with_(SEQS, """
SELECT doc_id, CASE WHEN length(sequence) <= 230 THEN '' ELSE sequence[131:length(sequence) - 100] END AS edited FROM seqs""")),
    "truncate_to": Entry(_edited(lambda s, k: ed.truncate_to(s, 100)), with_(SEQS, "SELECT doc_id, left(sequence, 100) AS edited FROM seqs")),
    "random_matched": Entry(_edited(lambda s, k: ed.random_matched(s, SEED, k)), with_(
        _CHARS, _collected("i", "SELECT * FROM chars", f"'{RESIDUES}'[1 + {int_draw(SEED_SQL, 'doc_id', _quote('random'), 'i')} % 20]"))),
    "point_mutation": Entry(point_mutation, with_(f"""{SEQS},
picked AS (SELECT *, {int_draw(SEED_SQL, 'doc_id', _quote('point'))} % nullif(length(sequence), 0) AS position FROM seqs),
peers AS (SELECT *, CASE sequence[position + 1] {_PEERS} END AS peers FROM picked)""", f"""
SELECT doc_id, CASE WHEN sequence = '' THEN '' ELSE left(sequence, position)
  || peers[1 + {int_draw(SEED_SQL, 'doc_id', _quote('peer'))} % length(peers)] || substr(sequence, position + 2) END AS edited,
  coalesce(position, -1) AS position FROM peers""")),
    "edit_panel": Entry(edit_panel),
    "edit_panel_counts": Entry(edit_panel_counts, with_(SEQS, _PANEL_COUNTS)),
}
