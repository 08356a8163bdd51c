"""Literal motifs from a table, all found in one pass over each text by an Aho-Corasick automaton.

The automaton holds every motif of the table, so its work does not grow with their number. Tables of more than
MOST_LETTERS letters are searched part by part, each with an automaton of bounded size. Motifs with
repeats or classes are not literal; they stay regular expressions (see functions/motifs.py).
"""

from __future__ import annotations

from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Letters of the motifs in one automaton (some hundred bytes each).
MOST_LETTERS = 2_000_000
LITERAL = r"^[^\\.\[\](){}|?*+^$]+$"


def _parts(motifs: DataFrame, most_letters: int) -> list[list[tuple[str, str]]]:
    """Distinct literal motifs (motif_id, pattern) in parts of bounded size."""
    plain = motifs.where(F.rlike("pattern", F.lit(LITERAL))).select("motif_id", "pattern").distinct()
    letters = plain.agg(F.sum(F.length("pattern"))).first()[0] or 0
    n = max(1, -(-letters // most_letters))
    dealt = plain.withColumn("part", F.pmod(F.xxhash64("pattern"), F.lit(n)))
    return [[(r["motif_id"], r["pattern"]) for r in dealt.where(F.col("part") == k).orderBy("motif_id", "pattern").collect()] for k in range(n)]


def literal_matches(df: DataFrame, row_id: str, seq: str, motifs: DataFrame, most_letters: int = MOST_LETTERS) -> DataFrame:
    """(row id, motif_id, starts): 0-based starts of every match, overlapping ones too, of each motif that a text
    holds. A null text holds none; patterns that are not literal take no part."""
    kind = df.schema[row_id].dataType.simpleString()

    def search(part: list[tuple[str, str]]) -> DataFrame:
        def run(batches):
            automaton, names = ahocorasick.Automaton(), {}
            for motif, pattern in part:
                names.setdefault(pattern, []).append(motif)
            for pattern in names:
                automaton.add_word(pattern, pattern)
            automaton.make_automaton()
            for batch in batches:
                out = []
                for key, text in zip(batch[row_id], batch[seq]):
                    found: dict[str, list[int]] = {}
                    for end, pattern in automaton.iter(text or "") if names else ():
                        found.setdefault(pattern, []).append(end - len(pattern) + 1)
                    out += [(key, motif, starts) for pattern, starts in found.items() for motif in names[pattern]]
                yield pd.DataFrame(out, columns=[row_id, "motif_id", "starts"])

        return df.select(row_id, seq).mapInPandas(run, f"{row_id} {kind}, motif_id string, starts array<bigint>")

    return reduce(DataFrame.unionAll, [search(part) for part in _parts(motifs, most_letters)])
