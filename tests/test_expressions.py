"""Column expressions: formats, parsing, scores, motifs, descriptors."""

import math
import random

import pytest
from pyspark.sql import functions as F

from seqloom.fixed import CANONICAL_MOTIFS, PROPERTIES, RESIDUES, TARGETS
from seqloom.functions import descriptors, motifs, prompts, residues, vectors
from seqloom.operators import baseline

# Two published sequences with their published weight, instability index and isoelectric point.
GOLDEN = [
    ("MNWSIRLALLGFVVLSTQTVFAVGQAATPWENSQLAEDFINSFLRFIGQSGAFSANQLDDMSSIGDTLKTAIEKMAQSRKSSKSKLQALNMAFASSMAEIAVAEQGGLSLEAKTNAIANALTSAFLETTGVINQQFVSEIKGLIYMIAQASSNEISGSSAAAGGGSGGGGYGGGGSGQGGYGQGAYASASAAVAYGSAPQGAGGPAPQGPSQQGPVSQGPYGPSAAAAAAATGGYGPGAGQQGPGAGQQGPGSGGQQGPGGQGPYGPGAAAAAAAVGGYGPGAGQQGPGSQGPSGPGGTQQGPGGQGPYGPG", 29754.17, 37.68, 4.88),
    ("MNWSIRLALFGFVVLSTQTVFAVGQAATPWENSQLAEDFINSFLRFIAQSGAFSPNQLDDMSSIGDTLKTAIEKMAQSRKSSKSKLQALNMAFASSMAEIAVAEQGGLSLEAKTNAIASALASAFLETTGVVNQQFVSEIKGLIYMIAQASSNEISGSASGSGGGSGGGGGGGGGYGPGSYASASVAAAYGSAPQGAGGPSPQGPSQQAPISQGPYGPGAAAAAAASGGYGPGAGQQGPSGGGQQGPGGAGQQGPGGQGPYVPSAAAAAAGGYGPGAGQ", 26864.21, 44.49, 4.88),
]


def one(spark, expression, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(expression.alias("x")).first()["x"]


def text(spark, expression, value):
    return one(spark, expression, t=("string", value))


def test_published_descriptors(spark):
    df = spark.createDataFrame(GOLDEN, "sequence string, mw double, ii double, pi double")
    for row in descriptors.with_descriptors(df, strict=True).collect():
        assert round(row["molecular_weight"], 2) == row["mw"]
        assert round(row["instability_index"], 2) == row["ii"]
        assert round(row["isoelectric_point"], 2) == row["pi"]
        assert sum(row[f"pct_{a}"] for a in "ACDEFGHIKLMNPQRSTVWY") == pytest.approx(100)


def test_descriptors_of_unusable_sequences(spark):
    df = spark.createDataFrame([("GAXB",), ("",)], "sequence string")
    assert [(r["status"], r["molecular_weight"], r["isoelectric_point"]) for r in descriptors.with_descriptors(df).collect()] == [
        ("non_standard", None, None)] * 2
    with pytest.raises(Exception, match="non-standard"):
        descriptors.with_descriptors(df, strict=True).collect()


def test_prompts(spark):
    v = ("array<double>", [0.327, 0.0625, 0.2125, 0.1, 0.2, 0.3, 1.0, 0.301])
    assert one(spark, prompts.inverse_prompt("v"), v=v) == "GenerateSilkContent<0.327,0.062,0.212,0.100,0.200,0.300,1.000,0.301>"
    assert text(spark, prompts.forward_prompt("t"), "GAGA") == "CalculateSilkContent<GAGA>"
    assert text(spark, prompts.task_of("t"), "CalculateSolubility<GA>") == "CalculateSolubility"
    assert text(spark, prompts.task_of("t"), "no task here") is None
    with pytest.raises(Exception, match="expected 8"):
        one(spark, prompts.format_vector("v"), v=("array<double>", [0.1, 0.2]))


def spoiled(answer: str, cells: list[str], foreign: str) -> list[str]:
    """Answers with one fault each: a bracket gone, the text cut short, a cell more or fewer, a foreign sign in a cell."""
    rng = random.Random(answer)
    out = [answer.replace("[", ""), answer.replace("]", ""), answer[: rng.randrange(len(answer))], foreign]
    if len(cells) > 1:
        at = rng.randrange(len(cells))
        out += [f"[{','.join(cells[:at] + cells[at + 1:])}]", f"[{','.join(cells[:at] + [cells[at]] + cells[at:])}]"]
    for at in {0, len(cells) // 2, len(cells) - 1}:
        out.append("[" + ",".join(c[:1] + foreign + c[1:] if i == at else c for i, c in enumerate(cells)) + "]")
    return out


def number_list(text: str):
    """What a plain reading of the first bracket gives: eight numbers or nothing."""
    inner = text.partition("[")[2].partition("]") if "[" in text else ("", "", "")
    try:
        numbers = [float(c) for c in inner[0].split(",")]
    except ValueError:
        return None
    return numbers if inner[1] and len(numbers) == 8 else None


@pytest.mark.parametrize("seed", range(6))
def test_spoiled_vectors(spark, seed):
    rng = random.Random(seed)
    cells = [f"{rng.random():.3f}" for _ in PROPERTIES]
    answer = f"[{','.join(cells)}]"
    assert text(spark, prompts.parse_vector("t"), answer) == number_list(answer)
    answers = spoiled(answer, cells, rng.choice("xQ;d"))
    rows = spark.createDataFrame(list(enumerate(answers)), "i int, t string").select("i", prompts.parse_vector("t").alias("v")).collect()
    assert {r["i"]: r["v"] for r in rows} == {i: number_list(a) for i, a in enumerate(answers)}
    assert any(r["v"] is None for r in rows)


@pytest.mark.parametrize("seed", range(4))
def test_spoiled_sequences(spark, seed):
    rng = random.Random(seed)
    whole = "".join(rng.choices(RESIDUES, k=12))
    answers = spoiled(f"[{whole}]", [whole], rng.choice("BZ7 -")) + [f"[{whole[:k]}]" for k in (0, 5)]

    def plain(t: str):
        inner, closed, _ = t.partition("[")[2].partition("]")
        body = inner.strip()
        return body if "[" in t and closed and body and not set(body) - set(RESIDUES) else None

    rows = spark.createDataFrame(list(enumerate(answers)), "i int, t string").select("i", prompts.parse_sequence("t").alias("s")).collect()
    assert {r["i"]: r["s"] for r in rows} == {i: plain(a) for i, a in enumerate(answers)}


def test_parsed_vectors(spark):
    assert text(spark, prompts.parse_vector("t"), "x [ 1, 2.5,,3e-1,+4,.5,6.,7,1_0 ] [9]") == [1.0, 2.5, 0.3, 4.0, 0.5, 6.0, 7.0, 10.0]
    special = text(spark, prompts.parse_vector("t"), "[nan,inf,-Infinity,0,0,0,0,0]")
    assert math.isnan(special[0]) and special[1:3] == [math.inf, -math.inf]


def test_parsed_sequences(spark):
    assert text(spark, prompts.parse_sequence("t"), "[ GAGA ] trailing [OTHER]") == "GAGA"
    assert text(spark, prompts.answer_status("t"), "[]") == "invalid_aa"
    assert text(spark, prompts.answer_status("t"), "GA]") == "unparseable"
    assert text(spark, prompts.parse_solubility("t"), "[0.75,x]") == 0.75
    assert text(spark, prompts.letters_before_answer("t"), "AB1c[x]") == 3


def test_scores(spark):
    both = lambda e, t, p: one(spark, e("t", "p"), t=("array<double>", t), p=("array<double>", p))
    assert both(vectors.r2_within, [0.5] * 8, [0.5] * 8) == 1.0
    assert both(vectors.r2_within, [0.5] * 8, [0.6] * 8) == 0.0
    a, b = TARGETS["F1"][0], TARGETS["S2"][0]
    mean = sum(a) / 8
    expected = 1 - sum((x - y) ** 2 for x, y in zip(a, b)) / sum((x - mean) ** 2 for x in a)
    assert both(vectors.r2_within, a, b) == pytest.approx(expected, abs=1e-12)
    assert both(vectors.r2_within, a, b) != both(vectors.r2_within, b, a)
    with pytest.raises(Exception, match="shape mismatch"):
        both(vectors.r2_within, a, b[:7])
    assert one(spark, vectors.rescale(F.col("x"), F.lit(2.0), F.lit(2.0)), x=("double", 5.0)) == 3.0


def test_motifs(spark):
    assert text(spark, motifs.motif_count("t", "A{4,}"), "AAAAAAAAAGG") == 1
    assert text(spark, motifs.motif_count("t", "AAAA"), "AAAAAAAAAGG") == 2
    assert text(spark, motifs.motif_count_overlapping("t", "AAAA"), "AAAAAAAAAGG") == 6
    assert text(spark, motifs.motif_positions("t", "GA"), "") == []
    assert text(spark, motifs.motif_positions("t", "CC"), "GAGA") == []


@pytest.mark.parametrize("seq", ["GAGAGAYYGGAGGAAAAAAGA", "PAPAPAPA" * 40, "AAAA", "YAAAAY", ""])
@pytest.mark.parametrize("pattern", ["PA", "A{4,}", "(?:GA){3,}"])
def test_spans_match_a_scan(spark, seq, pattern):
    import re

    spans = [(s["start"], s["end"]) for s in text(spark, motifs.motif_spans("t", pattern), seq)]
    assert spans == [m.span() for m in re.finditer(pattern, seq)]


def test_kmers(spark):
    assert text(spark, residues.kmer_set("t", 3), "AAAAC") == ["AAA", "AAC"]
    assert text(spark, residues.kmer_set("t", 3), "AC") == []
    assert text(spark, residues.residues_of("t"), "Straße, Xy-tHe 9") == "STRAEYTHE"
    assert len(residues.DIPEPTIDES) == 400 and set(CANONICAL_MOTIFS) == {"polyA", "GGX", "GPGXX", "GA", "QQ"}


def test_pairs_of_residues_are_counted_in_their_row(spark):
    rows = [(0, "ACACA"), (1, "AXA"), (2, ""), (3, None), (4, "A"), (5, "ÄAA\nAA"), (6, "YY")]
    df = spark.createDataFrame(rows, "id int, s string").repartition(1)
    got = {r["id"]: dict(zip(residues.DIPEPTIDES, r["n"])) for r in df.select("id", baseline.pair_counts("s").alias("n")).collect()}
    for i, text in rows:
        text = text or ""
        assert got[i] == {d: sum(text[k : k + 2] == d for k in range(len(text) - 1)) for d in residues.DIPEPTIDES}
