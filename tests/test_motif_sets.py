"""Literal motifs of a table against a search for each of them; glyph runs of one long document."""

import random

from pyspark.sql import functions as F

from seqloom.operators.motif_sets import literal_matches
from seqloom.operators.splitters import running_sums
from seqloom.sources import glyphs


def test_matches_equal_a_search_for_each_motif(spark):
    draw = random.Random(3)
    texts = [(i, "".join(draw.choices("ACD", k=draw.randint(0, 60)))) for i in range(50)] + [(50, None), (51, "AAAA"), (51, "AAAA")]
    motifs = [(f"m{i}", "".join(draw.choices("ACD", k=draw.randint(1, 4)))) for i in range(40)] + [("same", "AA"), ("twice", "AA"), ("regex", "A+"), ("none", None)]
    df = spark.createDataFrame(texts, "id int, s string")
    table = spark.createDataFrame(motifs, "motif_id string, pattern string")
    wanted = sorted((i, m, [k for k in range(len(t)) if t.startswith(p, k)]) for i, t in texts for m, p in motifs if t and p and "+" not in p and p in t)
    for letters in (2_000_000, 9):
        assert sorted((r["id"], r["motif_id"], r["starts"]) for r in literal_matches(df, "id", "s", table, letters).collect()) == wanted
    assert literal_matches(df, "id", "s", table.where("motif_id = 'regex'")).count() == 0


def test_running_sums(spark):
    rows = [(i, i % 7) for i in range(500)]
    out = {r["i"]: r["before"] for r in running_sums(spark.createDataFrame(rows, "i int, n int").repartition(5), ["i"], "n", partitions=6).collect()}
    assert out == {i: sum(n for _, n in rows[:i]) for i in range(500)}


def test_one_long_document_is_cut_right(spark):
    draw = random.Random(4)
    text = "".join(draw.choices("ACDEFGH", k=60_000))
    lines = spark.createDataFrame([("d", i, text[i * 30 : i * 30 + 30]) for i in range(2000)] + [("e", 0, "GAGA")], "doc string, line int, text string")
    sizes = [draw.randint(0, 90) for _ in range(1200)]
    sizes.append(len(text) - sum(sizes))
    expected = spark.createDataFrame([("d", k, k, n) for k, n in enumerate(sizes)] + [("e", 0, 0, 4)], "doc string, position int, id int, length int")
    starts = [sum(sizes[:k]) for k in range(len(sizes))]
    out = {(r["doc"], r["id"]): r["sequence"] for r in glyphs.cut_lines(lines, expected, "doc", ["line"]).collect()}
    assert out == {("d", k): text[s : s + n] for k, (s, n) in enumerate(zip(starts, sizes))} | {("e", 0): "GAGA"}
