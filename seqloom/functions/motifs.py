"""Regex motifs: counts, densities, spans and relative positions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from seqloom.functions.hashing import let

_OPEN, _BODY = "\u0001", "\u0002"


def motif_count(seq, pattern: str) -> Column:
    """Non-overlapping matches."""
    return F.regexp_count(seq, F.lit(pattern))


def motif_count_overlapping(seq, pattern: str) -> Column:
    """Start positions at which the pattern matches."""
    return F.regexp_count(seq, F.lit(f"(?={pattern})"))


def motif_density(seq, pattern: str) -> Column:
    """Matches per 100 residues; NULL for an empty sequence."""
    return F.lit(100.0) * motif_count(seq, pattern) / F.nullif(F.length(seq), F.lit(0))


def marked(seq, pattern: str, opening: str = _OPEN, body: str = _BODY) -> Column:
    """The sequence with each match overwritten by one opening mark and a run of body marks."""
    matches = F.regexp_extract_all(seq, F.lit(pattern), F.lit(0))
    gaps = F.split(seq, pattern, -1)
    pieces = F.zip_with(
        gaps,
        matches,
        lambda gap, match: F.when(match.isNull(), gap).otherwise(
            F.concat(gap, F.lit(opening), F.repeat(F.lit(body), F.length(match) - 1))
        ),
    )
    return F.array_join(pieces, "")


def motif_spans(seq, pattern: str) -> Column:
    """array<struct<start,end>> of the non-overlapping matches, 0-based, end exclusive: the starts are
    read off the marked sequence in one pass, however many there are."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def spans(matches: Column) -> Column:
        starts = F.filter(
            F.transform(F.split(marked(seq, pattern), ""), lambda c, i: F.when(c == _OPEN, i)),
            lambda i: i.isNotNull(),
        )
        return F.zip_with(
            starts, matches, lambda s, m: F.struct(s.cast("int").alias("start"), (s + F.length(m)).cast("int").alias("end"))
        )

    return let(
        F.regexp_extract_all(seq, F.lit(pattern), F.lit(0)),
        lambda m: F.when(F.size(m) == 0, empty).otherwise(spans(m)),
    )


def motif_positions(seq, pattern: str) -> Column:
    """Match midpoints as a fraction of the length."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    return F.when(F.length(seq) == 0, F.array().cast("array<double>")).otherwise(
        let(
            F.length(seq).cast("double"),
            lambda n: F.transform(motif_spans(seq, pattern), lambda s: (s["start"] + s["end"]) / F.lit(2.0) / n),
        )
    )
