"""Text lines from positioned glyphs, and the cutting of a run of lines into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqloom.fixed import AMBIGUOUS, RESIDUES
from seqloom.operators.splitters import running_sums

BLOCK = 1024


def glyph_lines(glyphs: DataFrame, groups: list[str], x_range: tuple[float, float] | None = None) -> DataFrame:
    """(groups..., line, text): glyphs of one rounded height, left to right. A group here is one
    printed line, so gathering it is bounded by the page width."""
    visible = glyphs.where(F.trim("text") != "")
    if x_range is not None:
        visible = visible.where((F.col("x0") >= x_range[0]) & (F.col("x0") < x_range[1]))
    return visible.groupBy(*groups, F.bround("top", 0).alias("line")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda g: g["text"]), "").alias("text")
    )


def residue_lines(lines: DataFrame) -> DataFrame:
    """Lines made of residue letters and ambiguity codes only, whatever their length."""
    return lines.where(F.rlike("text", F.lit(f"^[{RESIDUES}{AMBIGUOUS}]+$")))


def _spans(rows: DataFrame, document: str, order: list[str]) -> DataFrame:
    """Rows with `_start`, the sum of `_size` over the rows of their document before them. The sums run over ranges of
    the whole table, so a long document is spread over many tasks; what lies before its first row is taken off."""
    summed = running_sums(rows, [document, *order], "_size", "_global")
    firsts = summed.groupBy(document).agg(F.min("_global").alias("_first"))
    return summed.join(firsts, document).withColumn("_start", F.col("_global") - F.col("_first")).drop("_global", "_first")


def cut_lines(lines: DataFrame, expected: DataFrame, document: str, order: list[str]) -> DataFrame:
    """Cut each document's lines, read in order as one run of text, at the expected lengths.

    lines: (document, order..., text); expected: (document, position, id, length). Offsets come from
    prefix sums over ranges of lines; a line meets the sequences it overlaps on fixed blocks of offsets, so the run is
    never assembled as one string. A document whose total differs from the lengths is an error.
    """
    spans = _spans(lines.withColumn("_size", F.length("text")), document, order).select(
        document, "text", "_start", (F.col("_start") + F.col("_size")).alias("_end")
    )
    wanted = _spans(expected.select(document, "position", "id", "length").withColumn("_size", F.col("length")), document, ["position"]).select(
        document, "id", "length", F.col("_start").alias("_from"), (F.col("_start") + F.col("length")).alias("_stop")
    )

    def blocks(first, last):
        return F.explode(F.sequence(F.floor(first / BLOCK), F.floor((last - 1) / BLOCK))).alias("_block")

    left = spans.where(F.col("_end") > F.col("_start")).select("*", blocks(F.col("_start"), F.col("_end")))
    right = wanted.where(F.col("length") > 0).select("*", blocks(F.col("_from"), F.col("_stop")))
    low, high = F.greatest("_start", "_from"), F.least("_end", "_stop")
    pieces = (
        left.join(right, [document, "_block"])
        .where((low < high) & (F.floor(low / BLOCK) == F.col("_block")))
        .select(
            document, "id", "length", low.alias("_low"),
            F.substr("text", (low - F.col("_start") + 1).cast("int"), (high - low).cast("int")).alias("_piece"),
        )
    )
    cut = pieces.groupBy(document, "id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_low", "_piece"))), lambda p: p["_piece"]), "").alias(
            "sequence"
        )
    )
    held = lines.groupBy(document).agg(F.sum(F.length("text")).alias("_held"))
    needed = expected.groupBy(document).agg(F.sum("length").alias("_needed"))
    totals = held.join(needed, document, "full_outer").select(
        document,
        F.when(
            ~F.col("_held").eqNullSafe(F.col("_needed")),
            F.raise_error(F.format_string("document %s holds %s residues, its ids need %s", F.col(document).cast("string"), F.col("_held").cast("string"), F.col("_needed").cast("string"))),
        ).isNull().alias("_agree"),
    )
    # Every expected id has a row, one of length 0 too, and the totals of its document are compared before it is given out.
    return (
        expected.select(document, "id", "length").join(cut, [document, "id"], "left").join(totals, document).where("_agree")
        .select(document, "id", "length", F.coalesce("sequence", F.lit("")).alias("sequence"))
        .withColumn("complete", F.length("sequence") == F.col("length"))
    )
