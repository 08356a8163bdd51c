"""Seeded sequence edits. Every draw depends on (seed, row id, position) alone, so an edit is the
same whatever the partitioning and on every retry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seqloom.fixed import (
    CANONICAL_MOTIFS, KNOCKOUT_MOTIFS, RESIDUES, SCHEMES, SHUFFLE_BLOCK, TERMINUS_C, TERMINUS_N,
)
from seqloom.functions import draws
from seqloom.functions.hashing import draw_below, let
from seqloom.functions.motifs import marked
from seqloom.functions.residues import group_count


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _known(seq) -> Column:
    return F.coalesce(_col(seq), F.lit(""))


def _characters(seq: Column) -> Column:
    return F.when(F.length(seq) > 0, F.split(seq, "")).otherwise(F.array().cast("array<string>"))


def shuffle_residues(seq, seed, row_id) -> Column:
    return draws.shuffled(_known(seq), F.lit(seed), row_id, F.lit("shuffle"))


def shuffle_blocks(seq, seed, row_id, block: int = SHUFFLE_BLOCK) -> Column:
    return draws.shuffled_blocks(_col(seq), block, F.lit(seed), row_id, F.lit("blocks"))


def reverse_sequence(seq) -> Column:
    return F.reverse(_col(seq))


def knockout_delete(seq, pattern: str) -> Column:
    """All matches excised in one pass; matches formed at the joins stay."""
    return F.regexp_replace(_col(seq), pattern, "")


def matched_residues(seq, pattern: str) -> Column:
    """How many residues the knockout removes."""
    return F.length(_col(seq)) - F.length(knockout_delete(seq, pattern))


def scattered_deletion(seq, n_remove, seed, row_id, *salt, length=None) -> Column:
    """Drop `n_remove` residues at uniform positions; unchanged unless 0 < n_remove < length. `length` is a column that
    holds the length already."""
    seq, n_remove = _col(seq), _col(n_remove)
    applies = (n_remove > 0) & (n_remove < (F.length(seq) if length is None else length))
    thinner = draws.thinned(seq, F.when(applies, n_remove.cast("int")), F.lit(seed), row_id, F.lit("scatter"), *salt)
    return F.when(applies, thinner).otherwise(seq)


def block_deletion(seq, n_remove, seed, row_id, *salt, length=None) -> Column:
    """Drop one run of `n_remove` residues at a uniform start; unchanged unless 0 < n_remove < length, which may be given."""
    seq, n_remove = _col(seq), _col(n_remove)
    length = F.length(seq) if length is None else length
    start = draw_below(length - n_remove + 1, F.lit(seed), row_id, F.lit("block"), *salt).cast("int")
    applies = (n_remove > 0) & (n_remove < length)
    return F.when(
        applies, F.concat(F.substr(seq, F.lit(1), start), F.substr(seq, start + n_remove.cast("int") + 1))
    ).otherwise(seq)


def knockout_substitute(seq, pattern: str, seed, row_id, *salt) -> Column:
    """Matched residues replaced by residues drawn from the same sequence."""
    seq = _known(seq)
    return draws.filled(marked(seq, pattern, draws.HIT, draws.HIT), seq, F.lit(seed), row_id, F.lit("fill"), *salt)


def keep_termini(seq, n_term: int = TERMINUS_N, c_term: int = TERMINUS_C) -> Column:
    seq = _col(seq)
    return F.when(F.length(seq) <= n_term + c_term, seq).otherwise(
        F.concat(F.substring(seq, 1, n_term), F.right(seq, F.lit(c_term)))
    )


def keep_core(seq, n_term: int = TERMINUS_N, c_term: int = TERMINUS_C) -> Column:
    seq = _col(seq)
    return F.when(F.length(seq) <= n_term + c_term, F.lit("")).otherwise(
        F.substr(seq, F.lit(n_term + 1), F.length(seq) - (n_term + c_term))
    )


def truncate_to(seq, length: int) -> Column:
    return F.substring(_col(seq), 1, length)


def random_matched(seq, seed, row_id) -> Column:
    """Uniform residues, same length."""
    return draws.randomised(_known(seq), F.lit(seed), row_id, F.lit("random"))


def conservative_peers() -> dict[str, str]:
    """Residue -> the other members of its class, sorted."""
    return {
        a: "".join(sorted(set(members) - {a}))
        for members in SCHEMES["A_lehninger_style"].values()
        for a in members
    }


def point_mutation(seq, seed, row_id) -> Column:
    """struct<edited, position>: one residue swapped for a same-class peer; position -1 when none can be."""
    seq = _col(seq)
    eligible = F.filter(
        F.transform(_characters(seq), lambda c, i: F.when(F.instr(F.lit(RESIDUES), c) > 0, i)),
        lambda i: i.isNotNull(),
    )

    def peers_of(letter: Column) -> Column:
        out = F.lit("")
        for residue, others in sorted(conservative_peers().items()):
            out = F.when(letter == residue, F.lit(others)).otherwise(out)
        return out

    def swap(x: Column) -> Column:
        return let(
            F.struct(peers_of(F.substr(seq, x + 1, F.lit(1))).alias("peers"), x.alias("i")),
            lambda y: F.struct(
                F.concat(
                    F.substr(seq, F.lit(1), y["i"]),
                    F.substr(
                        y["peers"],
                        (draw_below(F.length(y["peers"]), F.lit(seed), row_id, F.lit("peer")) + 1).cast("int"),
                        F.lit(1),
                    ),
                    F.substr(seq, y["i"] + 2),
                ).alias("edited"),
                y["i"].alias("position"),
            ),
        )

    none = F.struct(seq.alias("edited"), F.lit(-1).alias("position"))
    drawn = (F.lit(seed), row_id, F.lit("point"))
    some = let(eligible, lambda e: F.get(e, draw_below(F.size(e), *drawn).cast("int")))
    # Where every letter is a residue, a letter's number is its position.
    position = F.when(group_count(seq, RESIDUES) == F.length(seq), draw_below(F.length(seq), *drawn).cast("int")).otherwise(some)
    return let(position, lambda i: F.when(i.isNull(), none).otherwise(swap(i)))


def edit_panel(
    df: DataFrame, seq: str, row_id: str, seed: int, keep: list[str] | None = None, motifs: dict[str, str] | None = None,
) -> DataFrame:
    """Explode each sequence into its applicable edits: (ablation, edited, n_changed).

    A motif contributes its knockout, both controls and the substitution only where it occurs;
    the termini/core pair only where the sequence is longer than the two ends.
    """
    motifs = {m: CANONICAL_MOTIFS[m] for m in KNOCKOUT_MOTIFS} if motifs is None else motifs
    s, key = F.col(seq), F.col(row_id)
    # Counted once: every edit asks for it.
    n = F.col("_length")

    def edit(name, edited, changed, when=None):
        row = F.struct(F.lit(name).alias("ablation"), edited.alias("edited"), changed.cast("int").alias("n_changed"))
        return row if when is None else F.when(when, row)

    rows = [
        edit("shuffle", shuffle_residues(s, seed, key), n),
        edit("shuffle_blocks", shuffle_blocks(s, seed, key), n),
        edit("reverse", reverse_sequence(s), n),
    ]
    for motif, pattern in motifs.items():
        removed = F.col(f"_removed_{motif}")
        tag = F.lit(motif)
        rows += [
            edit(f"knockout_{motif}", knockout_delete(s, pattern), removed, removed > 0),
            edit(f"scattered_control_{motif}", scattered_deletion(s, removed, seed, key, tag, length=n), removed, removed > 0),
            edit(f"block_control_{motif}", block_deletion(s, removed, seed, key, tag, length=n), removed, removed > 0),
            edit(f"substitute_{motif}", knockout_substitute(s, pattern, seed, key, tag), removed, removed > 0),
        ]
    long_enough = n > TERMINUS_N + TERMINUS_C
    ends = F.lit(TERMINUS_N + TERMINUS_C)
    rows += [
        edit("termini_only", keep_termini(s), n - ends, long_enough),
        edit("core_only", keep_core(s), ends, long_enough),
        edit("random_matched", random_matched(s, seed, key), n),
    ]
    mutated = point_mutation(s, seed, key)
    rows.append(
        let(mutated, lambda m: edit("point_mutation", m["edited"], F.lit(1), m["position"] >= 0))
    )
    removed = [F.length(s).alias("_length"), *[matched_residues(s, p).alias(f"_removed_{m}") for m, p in motifs.items()]]
    kept = keep if keep is not None else df.columns
    return (
        df.select("*", *removed)
        .select(*kept, F.explode(F.filter(F.array(*rows), lambda e: e.isNotNull() & (e["edited"] != ""))).alias("e"))
        .select(*kept, "e.ablation", "e.edited", "e.n_changed")
    )
